"""Views over the test tables that look like the stored tables of the domain.

Each view exists twice: here with the DataFrame API, and in ``fixture_sql`` as
SQL for the comparison engine. No view filters rows by id; lists are indexed by
a remainder only to give every row a value.
"""
import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from coverlens import fixed_values as V
from coverlens.functions.dates import expiry_date
from coverlens.functions.text import sql_text
from coverlens.operators.sessions import with_files
from coverlens.sources.tables import classify_files

AS_OF = datetime.date(2000, 1, 1)
BILL_AS_OF = datetime.date(2026, 1, 1)
BILL_SHIFT_DAYS = 9131

BRANDS = ["Apple", "Samsung", "LG", "Sony", "Xiaomi", "OnePlus", "Dell", "HP", "Lenovo", "boAt", "Noise", "Whirlpool",
          "Godrej", "Havells", "Philips", "ASUS", "Realme", "Voltas", "Unknown Brand", ""]
CATEGORIES = {"STANDARD": "smartphone", "PROMO": "laptop", "SMALL": "earbuds", "LARGE": "refrigerator",
              "ECONOMY": "washing_machine", "MEDIUM": "air_conditioner"}
PLATFORMS = ["Amazon", "Flipkart", "Croma", "Reliance Digital", "Official Store", "Offline Store", None]
MONTHS = [0, 6, 12, 24, 36, 60]
COVER_PHRASES = ["1 year warranty", "2 years", "10 years", "6 months", "13 months", "compressor", "burger", "",
                 "кафе бургер", "15 years"]
CAPTIONS = [None, "", "my new phone", "screen crack", "pani gir gaya", "Claim karna hai"]
ISSUES = ["my oneplus 9 screen has a green vertical line after update",
          "my boat airdopes left earbud is dead not charging",
          "voltas split ac cooling not working",
          "phone fell down and display glass shattered",
          "samsung phone green line and cracked",
          "Pink Line on old nokia, screen cracked",
          "laptop me PANI chala gaya",
          "charger jal gaya, spark from socket",
          "motherboard dead, won't turn on",
          "left side speaker awaz nahi",
          "fridge thanda nahi kar raha",
          "bill kho gaya, no bill for hp printer",
          "microwave stopped",
          None]
ISSUE_CATEGORIES = ["Smartphone", "Wearable", "Home Appliance", None]
MESSAGES = ["/start", "/claim my phone", "/Vault@some_bot", "/lang", "/alert30",
            "📸 Upload Store Bill", "🔍 क्या यह क्लेम होगा?", "🧾 Lost Bill Recovery Guide", "🎧 ब्रांड सपोर्ट डायरेक्टरी",
            "lead:OneAssist:12", "lead:Cashify:0", "lead:UrbanCompany:x", "view_prod:77", "extend_warn:41",
            "dir_brand:lg", "hello there", "set_lang:hi", "set_lang:en"]
MODELS = ["vision-small", "vision-large", "vision-free", "other"]
MODEL_ORDER = ("vision-large", ["vision-free", "vision-large", "vision-small", "vision-free"])
ANSWERS = ['{"image_type": "INVOICE", "product_name": "Dell XPS", "brand": "Dell", "price_paid": 1200.5, "warranty_months": 24, "purchase_date": "2025-3-09"}',
           '```json\n{"image_type": "PRODUCT_LABEL", "product_name": "LG TV", "brand": "", "price_paid": "799", "serial_no": "LG123"}\n```',
           'Here you go: {"image_type": "DEFECT_ISSUE", "detected_issue": "cracked corner", "purchase_date": null} hope it helps',
           '{"image_type": "INVOICE", "product_name": ', None,
           '{"image_type": "OTHER", "product_name": "cat"}']
EDIT_FIELDS = ["name", "retailer", "date", "warranty", "serial", "price"]
EDIT_VALUES = ["Sony WH-1000 <xm5>", "Corner Shop & Co", "2023-11-05", "18", "SN 00#7/9-A", "Rs 12,500.00",
               "  LG TV ", "yesterday", "31-02-2024", "eighteen", "", "n/a"]
TYPED_MONTHS = ["6", "24", "custom", " 18 ", "-3", "", "12 months", "60", "99999999999"]
PICKS = ["Smartphone", "Laptop", "TV & Audio", "Home Appliance", "Wearable"]
FILE_SUFFIXES = [".jpg", ".JPEG", ".png", ".pdf", ".webp", "", ".gif", ".tar.gz"]
FILES = 200  # every table of documents has as many
ADMINS = "7, 42,abc, 0 ,99 9,"
LEAD_CODES = {"OneAssist": "CODE1", "Onsitego": "CODE2", "Cashify": "CODE3"}
NEW_USER_SHIFT = 20  # moves the ids of the event log, so that some are above the known ones
LIMIT_MAX, LIMIT_SECONDS = 3, 6 * 3600
ARRIVAL_US = 1_800_000_000_000_000  # the moment at which a backlog of requests arrives
IDLE_SECONDS = 12 * 3600
BACKFILL = (datetime.date(1999, 12, 1), datetime.date(2000, 1, 31))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(spark, sf, name):
    """A table for heavy work on each row: test files of one row group are dealt out, at every size alike."""
    return table(spark, sf, name).repartition(spark.sparkContext.defaultParallelism)


def pick(values, n):
    """The value at the remainder of ``n``, a column or its name."""
    n = F.col(n) if isinstance(n, str) else n
    listed = ", ".join("null" if v is None else sql_text(v) if isinstance(v, str) else str(v) for v in values)
    return F.element_at(F.expr(f"array({listed})"), (n % len(values) + 1).cast("int"))


def events(spark, sf):
    """Events with ts as an instant; the files hold it without a zone."""
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def v_users(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("user_id"), F.col("c_name").alias("first_name"), F.lit(None).cast("string").alias("last_name"),
        F.when(c % 4 == 0, "hi").when(c % 4 != 1, "en").alias("language"))


def v_products(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    o = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(part, "p_partkey")
    key = F.col("o_orderkey")
    category = F
    for kind, name in CATEGORIES.items():
        category = category.when(F.col("p_type") == kind, F.lit(name))
    months = pick(MONTHS, F.col("p_partkey"))
    day = F.col("o_orderdate").cast("date")
    return o.select(
        key.alias("product_id"), F.col("o_custkey").alias("user_id"), F.col("p_name").alias("product_name"),
        pick(BRANDS, F.col("p_partkey")).alias("brand"), category.alias("category"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("M"), F.col("p_size").cast("string"))).alias("model_no"),
        F.when(key % 5 != 0, F.concat(F.lit("SN"), F.lpad(key.cast("string"), 12, "0"))).alias("serial_no"),
        pick(PLATFORMS, key).alias("purchase_platform"), day.alias("purchase_date"),
        months.alias("warranty_months"), expiry_date(day, months).alias("expiry_date"),
        F.col("o_totalprice").alias("price_paid"), F.col("o_orderpriority").alias("notes"),
        F.col("o_orderstatus").alias("order_status"))


def v_reminder_log(spark, sf):
    return milestones_reached(v_products(spark, sf))


def milestones_reached(products):
    """Milestones reached up to AS_OF by products of finished orders."""
    days = F.explode(F.array(*[F.lit(n) for n in V.REMINDER_DAYS]))
    return (products.where(F.col("order_status") == "F").select("product_id", "expiry_date", days.alias("n"))
            .where(F.date_sub("expiry_date", F.col("n")) <= F.lit(AS_OF))
            .select("product_id", F.when(F.col("n") == 0, "expired")
                    .otherwise(F.concat(F.col("n").cast("string"), F.lit("_day"))).alias("reminder_type")))


def v_bill_text(spark, sf):
    """Bill texts, dealt by their key: what joins them by it needs no shuffle of the texts.

    Reading a text costs far more than its bytes tell, so there are some tasks for each core, which are not merged by size.
    """
    p = v_products(spark, sf).repartition(8 * spark.sparkContext.defaultParallelism, "product_id")
    key = F.col("product_id")
    shown = F.date_add("purchase_date", BILL_SHIFT_DAYS)
    when = F.concat(F.lit("Date: "), F.when(key % 3 == 0, F.date_format(shown, "dd-MM-yyyy"))
                    .when(key % 3 == 1, F.date_format(shown, "d/M/yyyy")).otherwise(F.date_format(shown, "yyyy-MM-dd")))
    k9 = key % 9
    item = (F.when(k9 == 0, "Apple iPhone 15 Pro Max 256 GB Natural Titanium").when(k9 == 1, "iphone 13 mini 128gb")
            .when(k9 == 2, "Samsung Galaxy S22 Ultra").when(k9 == 3, "boAt Airdopes 141 Black")
            .when(k9 == 4, F.concat("brand", F.lit(" Trimmer"))).otherwise(F.concat("brand", F.lit(" "), "product_name")))
    serial = (F.when(F.col("serial_no").isNotNull(), F.concat(F.lit("S/N: "), "serial_no"))
              .when(key % 2 == 0, F.concat(F.lit("35"), F.lpad(key.cast("string"), 13, "0"))).otherwise("S/N:"))
    whole = F.floor("price_paid")
    paid = (F.when(key % 4 == 0, F.concat(F.lit("Grand Total: "), whole.cast("string")))
            .when(key % 4 == 1, F.concat(F.lit("Amount Payable = "), whole.cast("string"), F.lit(".50")))
            .when(key % 4 == 2, F.concat(F.lit("Paid "), F.format_number(whole, 0)))
            .otherwise(F.concat(F.lit("Итого "), whole.cast("string"))))
    text = F.concat_ws("\n", F.lit("TAX INVOICE"), F.coalesce("purchase_platform", F.lit("Ph 98765 43210")), when,
                       F.lit("Particulars"), item, serial, F.concat(F.lit("Order # "), key.cast("string")),
                       pick(COVER_PHRASES, key), paid)
    return p.select(key.alias("bill_id"), "user_id", text.alias("text"), pick(CAPTIONS, F.col("user_id")).alias("caption"))


def v_issue_text(spark, sf):
    e = F.col("event_id")
    return dealt(spark, sf, "events").select(
        "event_id", "user_id", pick(ISSUES, e).alias("issue"), pick(BRANDS, F.col("user_id")).alias("brand"),
        pick(ISSUE_CATEGORIES, e).alias("category"),
        F.when(e % 11 != 0, (e % 800).cast("int")).alias("days_since_purchase"))


def v_messages(spark, sf):
    return events(spark, sf).select("event_id", "user_id", "ts", pick(MESSAGES, F.col("event_id")).alias("text"))


def v_model_json(spark, sf):
    e = F.col("event_id")
    return dealt(spark, sf, "events").select(F.floor(e / 3).alias("bill_id"), (e % 3).cast("int").alias("engine_rank"),
                                             pick(ANSWERS, F.floor(e / 2)).alias("answer"))


def v_session_events(spark, sf):
    e, t = F.col("event_id"), F.col("event_type")
    kind = (F.when(t == "signup", "photo").when(t == "purchase", "confirm").when(t == "error", "cancel")
            .otherwise("edit"))
    field = F.when(t == "view", pick(EDIT_FIELDS, e)).when(t == "click", "category")
    value = F.when(t == "view", pick(EDIT_VALUES, F.floor(e / 5))).when(t == "click", pick(PICKS, e))
    months = pick(MONTHS, e)
    bill = F.struct(
        F.concat(F.lit("Item "), e.cast("string")).alias("product_name"), pick(BRANDS, e).alias("brand"),
        F.lit("General").alias("category"), pick(PLATFORMS, e).alias("purchase_platform"),
        F.date_sub(F.to_date("ts"), F.pmod(e, F.lit(700)).cast("int")).alias("purchase_date"),
        months.alias("warranty_months"), F.lit(None).cast("string").alias("serial_no"), F.col("value").alias("price_paid"))
    file_id = F.when(kind == "photo", F.concat(F.lit("f"), F.pmod(e, F.lit(FILES)).cast("string")))
    photos = events(spark, sf).select("user_id", "ts", "event_id", kind.alias("kind"), field.alias("field"),
                                      value.alias("value"), F.when(kind == "photo", bill).alias("bill"), file_id.alias("file_id"))
    files = classify_files(v_files(spark, sf)).withColumn("file_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    return with_files(photos, files)


def v_files(spark, sf):
    """Uploaded files, one per document: size from its length, suffix by turns."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("doc_id"), F.concat(F.lit("/in/"), F.col("source"), F.lit("/f"), d.cast("string"),
                                    pick(FILE_SUFFIXES, d)).alias("path"),
        F.when(d % 13 != 0, F.col("n_chars") * 2000).alias("length"), (d % 4 == 0).alias("is_photo"))
