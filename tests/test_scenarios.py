"""Whole answers for known questions and bills."""
import datetime

from pyspark.sql import Row, functions as F

from coverlens.operators.bills import choose_text, extract_bill
from coverlens.operators.claims import claim_answer, diagnose_claims
from coverlens.operators.users import cascade_delete
from coverlens.schemas import PRODUCTS, REMINDER_LOGS, USERS
from coverlens.session import work_dir
from coverlens.sources import sinks, tables
from coverlens.sources.dims import dim

ISSUES = "issue string, brand string, category string, days_since_purchase int"


def diagnose(spark, *rows):
    out = diagnose_claims(spark.createDataFrame(list(rows), ISSUES)).collect()
    return {r["issue"]: r for r in out}


def test_known_questions(spark):
    got = diagnose(
        spark,
        ("my oneplus 9 screen has a green vertical line after update", "OnePlus", None, None),
        ("my boat airdopes left earbud is dead not charging", "boAt", "Wearable", None),
        ("voltas split ac cooling not working", "Voltas", "Home Appliance", 500),
        ("phone fell down and display glass shattered", "Samsung", None, None))
    line, bud, ac, glass = (next(r for k, r in got.items() if w in k) for w in ("oneplus", "earbud", "voltas", "glass"))
    assert line["diagnosis"]["verdict"] == "CLAIMABLE" and "OnePlus" in line["diagnosis"]["brand_policy_note"]
    assert bud["diagnosis"]["verdict"] == "CLAIMABLE" and "replacement" in bud["diagnosis"]["explanation"].lower()
    assert ac["diagnosis"]["verdict"] == "CLAIMABLE" and "compressor" in ac["diagnosis"]["explanation"].lower()
    assert glass["diagnosis"]["verdict"] == "NOT_CLAIMABLE"
    assert len(line["diagnosis"]["action_steps"]) == 3


def test_ladder_edges(spark):
    got = diagnose(
        spark,
        ("green line and cracked", "samsung", None, None),
        ("green line and cracked screen", "nokia", None, None),
        ("microwave", None, None, None),
        ("odd noise at night", None, None, 365), ("odd noise at noon", None, None, 366), ("odd noise", None, None, None))
    assert got["green line and cracked"]["rule_id"] == 1
    assert got["green line and cracked screen"]["rule_id"] == 6
    assert got["microwave"]["rule_id"] == 4
    verdicts = [got[k]["diagnosis"]["verdict"] for k in ("odd noise at night", "odd noise at noon", "odd noise")]
    assert verdicts == ["CLAIMABLE", "CONDITIONAL", "CLAIMABLE"]
    assert got["odd noise at noon"]["diagnosis"]["verdict_title"].startswith("Likely Covered")


def test_missing_issue_and_mentioned_brand(spark):
    out = claim_answer(spark.createDataFrame([(1, None), (2, "Whirlpool and LG fridge")], "id int, issue string"))
    by_id = {r["id"]: r for r in out.collect()}
    assert by_id[1]["rule_id"] == 6 and by_id[1]["mentioned_key"] is None
    assert by_id[2]["mentioned_key"] == "lg"


def test_guides(spark):
    keys = {r["key"] for r in dim(spark, "bill_guide").collect()}
    assert {"amazon", "flipkart", "croma", "reliance_digital"} <= keys


def test_bill_from_file_name_and_caption(spark):
    df = spark.createDataFrame([("", "invoice_iphone15_amazon.jpg", "Bought on Amazon for 79900 on 2024-06-15")],
                               "ocr string, filename string, caption string")
    df = df.withColumn("text", choose_text(F.col("ocr"), F.col("filename"), F.col("caption")))
    b = extract_bill(df, "text", "caption", datetime.date(2026, 1, 1)).first()["bill"]
    assert (b["brand"], b["retailer"], b["purchase_date"]) == ("Apple", "Amazon India", "2024-06-15")
    assert (b["product_name"], b["price_paid"], b["warranty_months"]) == ("Apple Iphone15", 79900.0, 12)


def test_save_and_delete(spark):
    """A product is stored with a key and defaults; deleting its user takes it away."""
    folder = work_dir(spark, "vault")
    done = spark.createDataFrame(
        [Row(user_id=999999999, confirmed_id=1, confirmed_at=datetime.datetime(2024, 5, 1, 10),
             product_name="Apple iPhone 15", category=None, brand="Apple", purchase_platform="",
             purchase_date=None, warranty_months=None, serial_no="F2LN80V00D9", price_paid=79900.0)],
        "user_id long, confirmed_id long, confirmed_at timestamp, product_name string, category string, brand string, "
        "purchase_platform string, purchase_date date, warranty_months int, serial_no string, price_paid double")
    sinks.append_products(done, f"{folder}/product_warranties")
    products = tables.read_table(spark, folder, "product_warranties")
    row = products.first()
    assert row["product_id"] is not None and row["purchase_platform"] == "Local Store" and row["category"] == "General"
    assert row["expiry_date"] == datetime.date(2025, 5, 1) and row["price_paid"] == 79900.0
    users = spark.createDataFrame([(999999999,)], "user_id long").select("user_id")
    left = cascade_delete({"products": products, "users": users,
                           "reminder_logs": spark.createDataFrame([(1, row["product_id"], "7_day", None)], REMINDER_LOGS)},
                          user_ids=users)
    assert left["products"].count() == left["users"].count() == left["reminder_logs"].count() == 0
    assert PRODUCTS["user_id"].dataType == USERS["user_id"].dataType
