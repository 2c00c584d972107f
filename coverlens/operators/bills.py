"""Bill text to a structured purchase record, in native column expressions only.

The work is staged over several projections so that the lower-cased text, the
lines and the captures of the patterns are computed once per row.
"""
from pyspark.sql import Column, DataFrame, functions as F

from coverlens import fixed_values as V
from coverlens.functions.answers import empty_answer, parse_answer
from coverlens.functions.dates import day, strict_iso_date
from coverlens.functions.text import (after_words, contains_any, first_case, first_word_of, non_blank_lines, sql_text,
                                      strip, title_case, unicode_pattern)

BILL_FIELDS = ["image_type", "product_name", "brand", "category", "retailer", "purchase_date", "price_paid",
               "serial_no", "warranty_months", "is_food_receipt", "detected_issue", "is_claimable_verdict",
               "verdict_reason", "indian_consumer_tip"]


def choose_text(ocr, filename, caption) -> Column:
    """OCR text when there is enough of it, else file name and caption."""
    fallback = F.lower(F.concat(F.coalesce(filename, F.lit("")), F.lit(" "), F.coalesce(caption, F.lit(""))))
    return F.when(F.length(ocr) > V.OCR_MIN_CHARS, ocr).otherwise(fallback)


def keyword_brand(lower: str) -> Column:
    """(brand, category) of the first of the brand keywords in the named lower-case column."""
    def pair(b, c):
        return f"named_struct('brand', {sql_text(b)}, 'category', {sql_text(c)})"
    known = first_case([(f"contains({lower}, {sql_text(k)})", pair(b, c)) for k, b, c in V.BRAND_KEYWORDS])
    return F.coalesce(known, F.expr(pair(V.UNKNOWN_BRAND, V.GENERAL_CATEGORY)))


def item_line(lines) -> Column:
    """The line after the first header line that is followed by a usable item."""
    def usable(x, i):
        return ((i > 0) & contains_any(F.get(lines, i - 1)["low"], V.ITEM_HEADER_WORDS) & (F.length(x["line"]) > 3)
                & ~contains_any(x["low"], V.NOT_AN_ITEM_WORDS) & ~x["line"].rlike(unicode_pattern(r"^\d+$")))
    return F.get(F.filter(lines, usable), F.lit(0))["line"]


def shop_line(lines) -> Column:
    """First of the top six lines that can be a shop name.

    A line is looked at only if those above it cannot be one, and by its patterns only if its words allow it.
    """
    def plausible(line, low):
        kept = strip(F.regexp_replace(line, r"[^a-zA-Z0-9\s\x1c-\x1f\x85\p{Z}]", ""))
        digits = F.regexp_replace(line, "[^0-9]", "")  # all of them are kept
        return (~low.isin(V.BILL_TITLE_LINES) & (F.length(line) >= 4)
                & ~contains_any(low, V.RETAILER_NOISE_WORDS) & ~contains_any(low, V.RETAILER_PLACE_WORDS)
                & ((F.length(line) < 8) | (F.length(digits) < 8)) & (F.length(kept) >= 4))
    top = [F.get(lines, F.lit(i)) for i in range(6)]
    return F.coalesce(*[F.when(plausible(x["line"], x["low"]), x["line"]) for x in top])


def excluded_numbers(lower) -> Column:
    """Order, invoice, phone and table numbers: never a price."""
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(unicode_pattern(after_words(V.REFERENCE_WORDS, V.REFERENCE_NUMBER_PATTERN))), F.lit(1)))


def price_candidates(found, excluded) -> Column:
    """Distinct numbers that can be a price. The largest allowed value also limits the digits to six.

    The excluded numbers are taken off as a whole array: inside a lambda the
    optimizer would move their pattern into the loop over the numbers.
    """
    low, high = (str(n) for n in V.PIN_CODE_RANGE)
    texts = F.array_except(F.transform(found, lambda p: F.translate(p, ",", "")), excluded)
    prices = F.filter(texts, lambda t: ~((F.length(t) == len(low)) & t.between(low, high)))
    values = F.transform(prices, lambda t: t.try_cast("double"))
    return F.filter(values, lambda v: (v >= V.PRICE_MIN) & (v <= V.PRICE_MAX))


def bill_parts(df: DataFrame, text_col: str, caption_col: str | None, as_of) -> DataFrame:
    """All columns of the bill record next to the input columns, prefixed ``b_``.

    Every pattern runs once per row: captures come first, as columns of their
    own, and what is derived from them refers to those columns. Patterns that
    ignore case run on the lower-cased text. Captures are '' without a match.
    """
    c = F.col

    def capture(source, pattern, group=1, flags=""):
        return F.regexp_extract(source, flags + unicode_pattern(pattern), group)

    def capture_with(word, pattern):
        """A plain search for the word is far cheaper than the pattern it is part of."""
        return F.when(c("b_lower").contains(word), capture("b_lower", pattern)).otherwise("")

    ocr = F.coalesce(c(text_col), F.lit(""))
    caption = F.coalesce(c(caption_col), F.lit("")) if caption_col else F.lit("")
    df = df.withColumn("b_text", strip(F.concat(ocr, F.lit("\n"), caption))).withColumn("b_lines", non_blank_lines(ocr))
    df = df.withColumn("b_lower", F.lower("b_text"))
    df = df.withColumns({
        "b_known": keyword_brand("b_lower"),
        "b_iphone": capture_with("iphone", V.IPHONE_PATTERN),
        "b_galaxy": capture_with("galaxy", V.GALAXY_PATTERN),
        "b_airdopes": capture_with("airdopes", V.AIRDOPES_PATTERN),
        "b_grooming": contains_any("b_lower", V.GROOMING_WORDS),
        "b_is_food_receipt": contains_any("b_lower", V.FOOD_WORDS),
        "b_excluded": excluded_numbers(c("b_lower")),
        "b_numbers": F.regexp_extract_all("b_text", F.lit(unicode_pattern(V.PRICE_PATTERN)), F.lit(1)),
        "b_total": F.when(contains_any("b_lower", V.TOTAL_WORDS),
                          strip(F.translate(capture("b_lower", after_words(V.TOTAL_WORDS, V.TOTAL_PATTERN)), ", ", ""))).otherwise(""),
        "b_years": capture_with("year", V.YEARS_PATTERN),
        "b_labelled": capture("b_text", after_words(V.SERIAL_WORDS, V.LABELLED_SERIAL_PATTERN), flags="(?iu)"),
        # NULL and not '' without a date: a failed cast of a text costs as much as a pattern
        "b_dmy": F.split(F.nullif(capture("b_text", V.DAY_MONTH_YEAR_PATTERN, 0), F.lit("")), "[-/.]"),
    })
    is_iphone, is_galaxy, is_airdopes = (c(f"b_{m}") != "" for m in ("iphone", "galaxy", "airdopes"))
    storage = F.nullif(F.upper(F.replace(capture("b_lower", V.STORAGE_PATTERN), F.lit(" "), F.lit(""))), F.lit(""))
    colour = F.nullif(title_case(capture("b_lower", "(" + "|".join(V.IPHONE_COLOURS) + ")")), F.lit(""))

    def by_model(apple, samsung, boat, other):
        return F.when(is_iphone, apple).when(is_galaxy, samsung).when(is_airdopes, boat).otherwise(other)
    df = df.withColumns({
        "b_details": F.when(is_iphone, F.array_join(F.array(storage, colour), ", ")),
        "b_brand0": by_model("Apple", "Samsung", "boAt", c("b_known.brand")),
        "b_category0": by_model("Smartphone", "Smartphone", "Wearable",
                                F.when(c("b_grooming"), "Personal Care").otherwise(c("b_known.category"))),
        "b_candidates": price_candidates(c("b_numbers"), c("b_excluded")),
        "b_stated": F.when(c("b_total").rlike(r"^[0-9]+(\.[0-9]{2})?$"), c("b_total").try_cast("double")),
        "b_day": F.get("b_dmy", F.lit(0)).try_cast("int"), "b_month": F.get("b_dmy", F.lit(1)).try_cast("int"),
        "b_year": F.get("b_dmy", F.lit(2)).try_cast("int"),
    })
    known_brand = c("b_brand0") != V.UNKNOWN_BRAND

    def branded(text):
        return F.when(known_brand, F.concat("b_brand0", F.lit(" " + text)))
    kit = F.coalesce(branded("Trimmer / Grooming Kit"), F.lit("Trimmer / Grooming Kit"))
    details = F.when(c("b_details") != "", F.concat(F.lit(" ("), "b_details", F.lit(")"))).otherwise("")
    named_shop = first_word_of("b_lower", V.RETAILER_WORDS)
    burger_shop = F.when(c("b_is_food_receipt") & contains_any("b_lower", V.BURGER_SHOP_WORDS), F.lit(V.BURGER_SHOP))
    plausible = (c("b_day") <= 31) & (c("b_month") <= 12) & c("b_year").between(2000, 2030)
    iso = F.nullif(F.translate(capture("b_text", V.ISO_DATE_PATTERN, 0), "/.", "--"), F.lit(""))
    df = df.withColumns({
        "b_name0": by_model(
            F.concat(F.lit("Apple "), title_case("b_iphone"), details),
            F.concat(F.lit("Samsung "), strip(title_case("b_galaxy"))),
            F.concat(F.lit("boAt "), title_case("b_airdopes")),
            F.when(c("b_grooming"), kit)
            .otherwise(F.coalesce(item_line(c("b_lines")), branded("Device"), F.lit(V.DEFAULT_PRODUCT)))),
        "b_shop": F.coalesce(named_shop, burger_shop, shop_line(c("b_lines")), F.lit(V.DEFAULT_RETAILER)),
        "b_purchase_date": F.coalesce(
            F.when(plausible, F.format_string("%d-%02d-%02d", "b_year", "b_month", "b_day")), iso,
            F.date_format(day(as_of), "yyyy-MM-dd")),
    })
    food_only = c("b_is_food_receipt") & (c("b_name0") == V.DEFAULT_PRODUCT)
    months = F.when(c("b_is_food_receipt"), 0).when(c("b_years") != "", c("b_years").try_cast("int") * 12)
    for phrase, n in V.MONTH_PHRASES:
        months = months.when(c("b_lower").contains(phrase), n)
    total = F.when(c("b_stated").between(V.TOTAL_MIN, V.PRICE_MAX), c("b_stated"))
    return df.withColumns({
        "b_product_name": F.when(food_only, V.FOOD_PRODUCT).otherwise(c("b_name0")),
        "b_brand": F.when(food_only, V.FOOD_BRAND).otherwise(c("b_brand0")),
        "b_category": F.when(food_only, V.FOOD_CATEGORY).otherwise(c("b_category0")),
        "b_retailer": F.when(c("b_shop") == V.DEFAULT_RETAILER, F.coalesce(branded("Retail Store"), "b_shop"))
        .otherwise(c("b_shop")),
        "b_price_paid": F.when(F.size("b_candidates") > 0, F.coalesce(total, F.array_max("b_candidates"))),
        "b_serial_no": F.coalesce(F.nullif("b_labelled", F.lit("")),
                                  F.nullif(capture("b_text", V.BARE_IMEI_PATTERN), F.lit(""))),
        "b_warranty_months": months.when(contains_any("b_lower", V.LONG_COVER_WORDS), V.LONG_COVER_MONTHS)
        .otherwise(V.DEFAULT_WARRANTY_MONTHS),
        "b_detected_issue": F.lit(None).cast("string"),
        **{f"b_{n}": F.lit(v) for n, v in V.BILL_CONSTANTS.items()},
    })


def extract_bill(df: DataFrame, text_col: str, caption_col: str | None, as_of, fields=BILL_FIELDS) -> DataFrame:
    """Adds the record, or some of its fields, as one struct column ``bill``.

    The optimizer keeps the struct whole; fields that are not named are not computed.
    """
    keep = df.columns
    parts = bill_parts(df, text_col, caption_col, as_of)
    return parts.select(*keep, F.struct(*[F.col(f"b_{f}").alias(f) for f in fields]).alias("bill"))


def typed_answer(answer) -> Column:
    """A model answer with the types of a bill record; unreadable numbers become NULL."""
    months = answer["warranty_months"].try_cast("double").try_cast("int")
    typed = {"price_paid": answer["price_paid"].try_cast("double"), "warranty_months": months,
             "is_food_receipt": F.lit(False)}
    return F.when(answer.isNotNull(), F.struct(*[typed.get(f, answer[f] if f != "is_food_receipt" else None).alias(f)
                                                 for f in BILL_FIELDS]))


def engine_rank(model, selected: str, fallbacks: list[str]) -> Column:
    """Place of a model in the order of trial: the selected one, then the others once each; NULL for strangers."""
    order = list(dict.fromkeys([selected, *fallbacks]))
    place = F.array_position(F.array(*[F.lit(m) for m in order]), model)
    return F.when(place > 0, (place - 1).cast("int"))


def first_acceptable(answers: DataFrame, key: str = "bill_id", rank: str = "engine_rank",
                     text_col: str = "answer", model: str | None = None) -> DataFrame:
    """Per bill the answer of the first engine that gave an acceptable one.

    ``model`` names the place of a model within its engine, where engines try
    several. Such an engine answers with the first of its models that gives an
    object with any field, acceptable or not; if it is not, the next engine is
    asked and not the next model. Models without a place are never asked.

    An aggregate and not a window: many answers to one bill are reduced on the
    map side before anything is shuffled. What is not acceptable gets no rank,
    which the aggregate skips; a filter in its place would parse every text a
    second time.
    """
    parsed = answers.withColumn("_a", parse_answer(text_col))
    if model:
        spoken = F.when(F.col("_a").isNotNull() & ~empty_answer(text_col), F.col(model))
        parsed = parsed.groupBy(key, rank).agg(F.min_by("_a", spoken).alias("_a"), F.min(spoken).alias("chosen_model"))
    usable = F.when(F.col("_a.image_type").isin(V.ACCEPTED_IMAGE_TYPES), F.col(rank))
    chosen = ["chosen_model"] if model else []
    ranked = parsed.select(key, usable.alias("_rank"), typed_answer(F.col("_a")).alias("_bill"), *chosen)
    best = ranked.groupBy(key).agg(F.min_by("_bill", "_rank").alias("model_bill"), F.min("_rank").alias("chosen_engine"),
                                   *[F.min_by(c, "_rank").alias(c) for c in chosen])
    return best.where(F.col("chosen_engine").isNotNull())


def bill_defaults(df: DataFrame, bill_col: str, as_of) -> DataFrame:
    """Record fields with their defaults as product columns."""
    b = F.col(bill_col)

    def text(f):
        return F.coalesce(F.nullif(b[f], F.lit("")), F.lit(V.INTAKE_DEFAULTS[f]))
    return df.withColumns({
        "product_name": text("product_name"), "brand": text("brand"), "category": text("category"),
        "purchase_platform": text("retailer"),
        "warranty_months": F.coalesce(b["warranty_months"], F.lit(V.DEFAULT_WARRANTY_MONTHS)),
        "serial_no": b["serial_no"], "price_paid": b["price_paid"],
        "is_food_receipt": F.coalesce(b["is_food_receipt"], F.lit(False)),
        "purchase_date": F.coalesce(strict_iso_date(b["purchase_date"]), day(as_of)),
    })
