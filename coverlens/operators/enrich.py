"""Enrichment with brand, policy, cover and guide tables.

Substring rules are unrolled into one expression per row, which gives the key
of the first matching entry; the texts then come from an equi join with a
broadcast table of fixed size. No row is ever compared by a join condition
other than equality.
"""
from pyspark.sql import Column, DataFrame, functions as F

from coverlens import fixed_values as V
from coverlens.functions.dates import day, days_left, expiry_date
from coverlens.functions.text import as_col, first_case, first_word_of, or_default, sql_text, strip
from coverlens.operators.hot_keys import spread_join
from coverlens.sources.dims import dim

_SUPPORT_KEYS = [r[0] for r in V.BRAND_SUPPORT]
_POLICY_KEYS = [r[0] for r in V.BRAND_POLICIES]


def support_key(brand: str) -> Column:
    """First directory key that contains the brand or is contained in it; takes a trimmed lower-case column.

    An empty brand is contained in every key and so gives the first one.
    """
    return first_case([(f"contains({brand}, {sql_text(k)}) OR contains({sql_text(k)}, {brand})", sql_text(k))
                       for k in _SUPPORT_KEYS])


def mentioned_key(text: str) -> Column:
    """First directory key that occurs in the text; takes a lower-case column."""
    return first_word_of(text, [(k, k) for k in _SUPPORT_KEYS])


def policy_key(brand: str, text: str) -> Column:
    """First policy key in the brand or in the text; takes lower-case columns."""
    return first_case([(f"contains({brand}, {sql_text(k)}) OR contains({text}, {sql_text(k)})", sql_text(k))
                       for k in _POLICY_KEYS])


def _low(c):
    return F.lower(F.coalesce(as_col(c), F.lit("")))


def _support(spark, prefix):
    d = dim(spark, "brand_support").drop("ord")
    return F.broadcast(d.select(*[F.col(c).alias(prefix + c) for c in d.columns]))


def with_brand_support(df: DataFrame, brand_col: str = "brand", prefix: str = "support_") -> DataFrame:
    return (df.withColumn("_brand", strip(F.lower(brand_col))).withColumn(f"{prefix}key", support_key("_brand")).drop("_brand")
            .join(_support(df.sparkSession, prefix), f"{prefix}key", "left"))


def with_mentioned_brand(df: DataFrame, text_col: str, prefix: str = "mentioned_") -> DataFrame:
    return (df.withColumn("_text", F.lower(text_col)).withColumn(f"{prefix}key", mentioned_key("_text")).drop("_text")
            .join(_support(df.sparkSession, prefix), f"{prefix}key", "left"))


def brand_card(df: DataFrame, key_col: str = "brand_key") -> DataFrame:
    """Directory card of an exact key; unknown keys keep their row without a card."""
    card = dim(df.sparkSession, "brand_support").drop("ord").withColumnRenamed("key", key_col)
    return (df.join(F.broadcast(card), key_col, "left")
            .withColumn("found", F.col("name").isNotNull())
            .withColumn("whatsapp", F.when(F.col("found"), or_default("whatsapp", V.NO_WHATSAPP))))


def with_policy_note(df: DataFrame, brand_col: str, text_col: str) -> DataFrame:
    notes = dim(df.sparkSession, "brand_policy").select(F.col("key").alias("policy_key"),
                                                        F.col("note").alias("brand_policy_note"))
    return (df.withColumns({"_brand": strip(_low(brand_col)), "_text": _low(text_col)})
            .withColumn("policy_key", policy_key("_brand", "_text")).drop("_brand", "_text")
            .join(F.broadcast(notes), "policy_key", "left"))


def normal_category(c) -> Column:
    """Category name as the cover table spells it."""
    return F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "_")


def component_coverage(products: DataFrame, as_of) -> DataFrame:
    """One row per product and component cover of its category, with its own expiry.

    A product whose category has no component cover keeps one row without a component.
    """
    cover = dim(products.sparkSession, "component_coverage").select(
        F.col("category").alias("_category"), "component", F.col("months").alias("component_months"),
        F.col("note").alias("component_note"))
    return (products.withColumn("_category", normal_category("category"))
            .join(F.broadcast(cover), "_category", "left").drop("_category")
            .withColumn("component_expiry", expiry_date("purchase_date", "component_months"))
            .withColumn("is_covered", day(as_of) <= F.col("component_expiry")))


def guide_key(platform: str) -> Column:
    """Guide of the shop named in a lower-case column; the last guide is the general one."""
    named = first_word_of(platform, [(k.split("_")[0], k) for k, _ in V.BILL_GUIDES[:-1]])
    return F.coalesce(named, F.lit(V.BILL_GUIDES[-1][0]))


def with_recovery_guide(df: DataFrame, platform_col: str = "purchase_platform") -> DataFrame:
    """Lost-bill guide of the shop; shops without their own get the general one."""
    guides = dim(df.sparkSession, "bill_guide").select(F.col("key").alias("guide_key"),
                                                       F.col("text").alias("guide_text"))
    return (df.withColumn("_shop", F.lower(platform_col)).withColumn("guide_key", guide_key("_shop")).drop("_shop")
            .join(F.broadcast(guides), "guide_key"))


def with_language(df: DataFrame, users: DataFrame, spread_on: list[str], hot_rows: int = 2_000_000) -> DataFrame:
    """Language of each row's user, English when unknown or empty."""
    langs = users.select("user_id", F.col("language").alias("_language"))
    return (spread_join(df, langs, "user_id", spread_on, "left", hot_rows)
            .withColumn("user_lang", or_default("_language", "en")).drop("_language"))


def offer_context(actions: DataFrame, products: DataFrame, as_of, spread_on: list[str]) -> DataFrame:
    """Product name and days left for an offer; a product that is gone gets neutral values."""
    known = products.select("product_id", F.col("product_name").alias("_name"),
                            days_left("expiry_date", as_of).alias("_days"))
    return (spread_join(actions, known, "product_id", spread_on, "left")
            .withColumn("offer_name", F.coalesce("_name", F.lit(V.OFFER_DEFAULT_NAME)))
            .withColumn("offer_days", F.coalesce("_days", F.lit(0))).drop("_name", "_days"))


def claim_dossier(products: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """The labelled fields of a service-center dossier, with their fallbacks."""
    from coverlens.functions.dates import format_day
    from coverlens.operators.lifecycle import dossier_status

    names = users.select("user_id", "first_name", "last_name")
    df = dossier_status(spread_join(products, names, "user_id", ["product_id"]), as_of)
    full_name = strip(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))))
    unnamed = F.lit(V.DOSSIER_NOT_SPECIFIED)
    return df.select(
        "product_id", "product_name",
        F.concat("brand", F.lit(" ("), "category", F.lit(")")).alias("brand_and_category"),
        or_default("model_no", unnamed).alias("model_no"),
        or_default("serial_no", unnamed).alias("serial_no"),
        or_default("purchase_platform", V.DOSSIER_PLATFORM).alias("purchase_platform"),
        format_day("purchase_date").alias("purchase_date"),
        F.concat(F.col("warranty_months").cast("string"), F.lit(" Months")).alias("warranty_coverage"),
        format_day("expiry_date").alias("expiry_date"),
        F.col("dossier_status").alias("current_status"),
        or_default(full_name, V.DOSSIER_CUSTOMER).alias("customer_name"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.nullif(F.col("notes"), F.lit("")).alias("notes"))
