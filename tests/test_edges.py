"""Edge rows of single rules."""
import datetime
import html
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from coverlens import fixed_values as V
from coverlens.functions import answers, dates, files, text
from coverlens.operators import bills, enrich, lifecycle, messages
from coverlens.sources import tables

D = datetime.date
AS_OF = D(2026, 1, 1)


def column(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {dtype}")
    return [r[1] for r in df.select("i", expr(F.col("c")).alias("o")).orderBy("i").collect()]


def test_expiry(spark):
    months = [0, 3, 6, 12, 24, 36, 60, 120]
    days = column(spark, months, lambda c: F.datediff(dates.expiry_date(F.lit(D(2024, 1, 31)), c), F.lit(D(2024, 1, 31))), "int")
    assert days == [0, 91, 182, 365, 730, 1095, 1826, 3652]


def test_statuses(spark):
    rows = [(D(2026, 1, 1) + datetime.timedelta(days=n), 12) for n in (16, 15, 0, -1)] + [(D(2026, 3, 1), 0)]
    df = spark.createDataFrame(rows, "expiry_date date, warranty_months int")
    df = lifecycle.card_status(lifecycle.dossier_status(lifecycle.vault_status(df, AS_OF), AS_OF), AS_OF)
    got = {r["expiry_date"]: r for r in lifecycle.with_remaining(df, AS_OF).collect()}
    at = [got[r[0]] for r in rows]
    assert [r["status_icon"] for r in at[:4]] == ["🟢", "🟡", "🟡", "🔴"]
    assert [r["dossier_status"].split(" ")[0] for r in at[:4]] == ["ACTIVE", "ACTIVE", "EXPIRES", "EXPIRED"]
    assert [r["card_icon"] for r in at] == ["🟢", "🟢", "🟣", "🟣", "⚪"]
    assert at[2]["days_remaining"] == 0 and at[2]["is_expired"] is False and at[3]["is_expired"] is True


def test_milestones(spark):
    days = [31, 30, 14, 0, -1]
    df = spark.createDataFrame([(n, AS_OF + datetime.timedelta(days=n)) for n in days], "n int, expiry_date date")
    got = {r["n"]: r["reminder_type"] for r in lifecycle.milestones(df, AS_OF).collect()}
    assert got == {30: "30_day", 0: "expired"}


def test_backfill_against_brute_force(spark):
    first, last = D(2026, 1, 1), D(2026, 2, 15)
    df = spark.createDataFrame([(i, D(2025, 12, 20) + datetime.timedelta(days=i)) for i in range(100)],
                               "product_id long, expiry_date date")
    got = sorted((r["product_id"], r["as_of"], r["reminder_type"])
                 for r in lifecycle.milestones_between(df, first, last).collect())
    brute = sorted((i, d, "expired" if n == 0 else f"{n}_day")
                   for i in range(100) for n in (30, 15, 7, 1, 0)
                   for d in [D(2025, 12, 20) + datetime.timedelta(days=i - n)] if first <= d <= last)
    assert got == brute


def test_support_key(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(["", "a", "Samsung India", "Voltas", None, " LG "])], "i int, brand string")
    got = [r["support_key"] for r in enrich.with_brand_support(df).orderBy("i").collect()]
    assert got == ["apple", "apple", "samsung", None, None, "lg"]


BILL_CASES = [
    ("Date 31-02-2024", dict(purchase_date="2024-02-31")),
    ("on 45-01-2024 and 2023-05-06", dict(purchase_date="2023-05-06")),
    ("no date", dict(purchase_date="2026-01-01")),
    ("7.3.2021", dict(purchase_date="2021-03-07")),
    ("Grand Total: ₹ 1,500 year 2024", dict(price_paid=2024.0)),
    ("Total 1500\n2 years", dict(price_paid=1500.0, warranty_months=24)),
    ("Paid 79,900", dict(price_paid=900.0)),
    ("Total 150", dict(price_paid=None)),
    ("Rs1500", dict(price_paid=None)),
    ("Total 1500\n", dict(price_paid=1500.0)),
    ("order 4321 item 999", dict(price_paid=999.0)),
    ("pin 110086 price 450", dict(price_paid=450.0)),
    ("price 110086.00", dict(price_paid=110086.0)),
    ("ИТОГО 700 из 900", dict(price_paid=700.0)),
    ("10 years", dict(warranty_months=120)), ("15 years", dict(warranty_months=60)),
    ("20 years", dict(warranty_months=12)), ("18 months", dict(warranty_months=12)),
    ("13 months", dict(warranty_months=3)), ("16 months", dict(warranty_months=6)),
    ("motor", dict(warranty_months=120)), ("motorola", dict(warranty_months=120, brand="Motorola")),
    ("hot coffee 10 years", dict(warranty_months=0, product_name="Food & Dining / Retail Receipt", category="Other")),
    ("galaxy s22ultra box\nnext", dict(product_name="Samsung Galaxy S22Ultra Box\nNext", brand="Samsung")),
    ("iPhone 15 pro max 256 GB deep purple", dict(product_name="Apple Iphone 15 Pro Max (256GB, Deep Purple)")),
    ("boat airdopes 141pro", dict(product_name="boAt Airdopes 141Pro", category="Wearable")),
    ("philips shaver", dict(product_name="Philips Trimmer / Grooming Kit", category="Personal Care")),
    ("shaver", dict(product_name="Trimmer / Grooming Kit", brand="Unknown Brand")),
    ("Description\n12345\nItem name\nSony Bravia", dict(product_name="Sony Bravia")),
    ("Description\n1 year warranty card", dict(product_name="Electronic Device")),
    ("dell store", dict(product_name="Dell Device", retailer="dell store")),
    ("hp", dict(product_name="HP Device", retailer="HP Retail Store")),
    ("TAX INVOICE\n98765 43210\nGround floor\nSharma & Sons", dict(retailer="Sharma & Sons")),
    ("vijay sales mumbai", dict(retailer="Vijay Sales")),
    ("бархан", dict(retailer="Burger Shop (Бархан)", is_food_receipt=True)),
    ("S/N: ABCDE12345678901234", dict(serial_no="ABCDE1234567890123")),
    ("imei - 351234567890123", dict(serial_no="351234567890123")),
    ("box 861234567890123 end", dict(serial_no="861234567890123")),
    ("box x861234567890123", dict(serial_no=None)),
]


def test_bill_edges(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BILL_CASES)], "i int, text string")
    out = {r["i"]: r["bill"] for r in bills.extract_bill(df, "text", None, AS_OF).collect()}
    bad = [(t, k, out[i][k], v) for i, (t, want) in enumerate(BILL_CASES) for k, v in want.items() if out[i][k] != v]
    assert not bad


def test_impossible_day_falls_back(spark):
    got = column(spark, ["2024-02-31", "2024-5-6", "2024-05-06T10", "n/a", None], dates.strict_iso_date)
    assert got == [None, D(2024, 5, 6), D(2024, 5, 6), None, None]


def test_item_header_uses_text_not_caption(spark):
    df = spark.createDataFrame([("Total 500", "Description\nSony Bravia")], "text string, caption string")
    assert bills.extract_bill(df, "text", "caption", AS_OF).first()["bill"]["product_name"] == "Sony Device"


def test_answers(spark):
    good = '{"image_type": "INVOICE", "brand": "LG", "price_paid": "12"}'
    texts = [good, "```json\n" + good + "\n```", "see " + good + " ok", '{"brand": ', "[" + good + "]", "", None,
             good + " and " + good, "{'brand': 'LG'}", '{"brand": "a", "brand": "b"}', '{"brand": {"x": 1}}']
    got = column(spark, texts, answers.parse_answer)
    assert [g is not None for g in got] == [True, True, True, False, False, False, False, False, False, True, True]
    assert all(g["brand"] == "LG" and g["price_paid"] == "12" for g in got[:3])
    assert got[9]["brand"] == "b"


def test_engines_and_their_models(spark):
    """The first model that says anything speaks for its engine; the next engine is asked if that is not acceptable."""
    invoice, other = '{"image_type": "INVOICE", "product_name": "%s"}', '{"image_type": "OTHER"}'
    rows = [(1, 0, 0, other), (1, 0, 1, invoice % "never asked"), (1, 1, 0, invoice % "second engine"),
            (2, 0, 0, "{ }"), (2, 0, 1, "no object"), (2, 0, 2, invoice % "third model"), (2, 1, 0, invoice % "second engine"),
            (3, 0, 0, '{"note": 1}'), (3, 0, 1, invoice % "never asked"),
            (4, 0, None, invoice % "no place"), (4, 1, 0, None)]
    answers_of = spark.createDataFrame(rows, "bill_id int, engine_rank int, place int, answer string")
    got = bills.first_acceptable(answers_of, model="place").select("bill_id", "chosen_engine", "chosen_model", "model_bill.product_name")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, "second engine"), (2, 0, 2, "third model")]


def test_dates_prices_months(spark):
    typed = ["today", " Yesterday ", "2024-12-29", "29-12-2024", "29/12/2024", "29.12.2024", "31-02-2024", "soon"]
    assert column(spark, typed, lambda c: dates.parse_human_date(c, AS_OF)) == [
        AS_OF, D(2025, 12, 31)] + [D(2024, 12, 29)] * 4 + [None, None]
    assert column(spark, typed, lambda c: dates.parse_human_date(c, AS_OF, V.ENTRY_DATE_FORMATS))[4:6] == [None, None]
    assert column(spark, ["Rs 12,500.50", "1.2.3", "free", "5."], text.parse_price) == [12500.5, None, None, 5.0]
    assert column(spark, ["18", " 6 ", "custom", "-3"], text.parse_months) == [18, 6, 12, -3]
    assert column(spark, ["18", " 6 ", "custom", "-3"], lambda c: text.parse_months(c, strict=True)) == [18, 6, None, None]


def test_format_price(spark):
    assert column(spark, [0.0, None, 1234.5], text.format_price, "double") == ["Recorded", "Recorded", "₹1,234.50"]


def test_redaction(spark):
    got = column(spark, ["tel 9876543210 a.b@c.in x1234567890", None, "é1234567890 1234567890", "मि1234567890"], text.redact_pii)
    assert got == ["tel [REDACTED] [EMAIL_REDACTED] x1234567890", "", "é1234567890 [REDACTED]", "मि[REDACTED]"]


def test_sanitizers(spark):
    assert column(spark, ["  <b>'x'</b>  "], text.sanitize_text) == ["&lt;b&gt;&#x27;x&#x27;&lt;/b&gt;"]
    assert column(spark, ["SN 00#7/9-A " + "z" * 40], text.sanitize_serial) == [("SN 007" + "9-A " + "z" * 40)[:30]]


def test_leads(spark):
    df = spark.createDataFrame([("lead:OneAssist:12",), ("lead:Cashify:0",), ("lead:UrbanCompany:x",), ("lead:Onsitego",)], "text string")
    out = {r["provider"]: r for r in messages.to_leads(messages.parse_action(df), {"Cashify": "Z"}).collect()}
    assert (out["OneAssist"]["service_type"], out["OneAssist"]["product_id"]) == ("extended_warranty", 12)
    assert (out["Cashify"]["service_type"], out["Cashify"]["product_id"]) == ("cashify", None)
    assert (out["UrbanCompany"]["service_type"], out["UrbanCompany"]["product_id"]) == ("urbancompany", None)
    assert out["Cashify"]["referral_url"].endswith("=Z") and out["UrbanCompany"]["referral_url"] is None
    assert out["Onsitego"]["product_id"] is None


def test_files(spark, tmp_path):
    cap = V.MAX_UPLOAD_BYTES
    df = spark.createDataFrame([("a/b.PDF", cap, False), ("a/c.png", cap + 1, False), ("a/d", None, False), ("a/e", cap + 1, True)],
                               "path string, length long, is_photo boolean")
    out = {r["path"]: r for r in tables.classify_files(df).collect()}
    assert [out[p]["accepted"] for p in ("a/b.PDF", "a/c.png", "a/d", "a/e")] == [True, False, True, True]
    assert [out[p]["extension"] for p in ("a/b.PDF", "a/d", "a/e")] == ["pdf", "pdf", "jpg"]
    (tmp_path / "x.webp").write_bytes(b"12345")
    got = tables.read_bill_files(spark, str(tmp_path)).first()
    assert (got["length"], got["extension"], got["mime_type"], got["accepted"]) == (5, "webp", "image/webp", True)
    assert tables.read_bill_files(spark, str(tmp_path), photos=r"/x\.").first()["extension"] == "jpg"
    assert column(spark, ["x.pdf", "x.gif", "x", ".png"], lambda c: files.mime_type(c, "model")) == [
        "image/jpeg", "image/gif", "image/jpeg", "image/jpeg"]


SAMPLES = st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF), max_size=40), min_size=60, max_size=60)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(SAMPLES)
def test_text_helpers_like_python(spark, samples):
    samples = [s.replace("\x00", "") for s in samples] + ["o'neil s22ultra", " \x1fa ", "<a & 'b'>" * 30]
    assert column(spark, samples, text.strip) == [s.strip() for s in samples]
    assert column(spark, samples, text.sanitize_text) == [html.escape(s.strip())[:200] for s in samples]
    masked = [re.sub(V.EMAIL_PATTERN, V.EMAIL_MASK, re.sub(V.LONG_NUMBER_PATTERN, V.LONG_NUMBER_MASK, s)) for s in samples]
    assert column(spark, samples, text.redact_pii) == masked
    plain = [s for s in samples if s.isascii()]
    if plain:
        assert column(spark, plain, text.title_case) == [s.title() for s in plain]
        words = [s.split()[0] if s.split() else None for s in plain]
        assert column(spark, plain, text.first_word) == words


@pytest.mark.parametrize("label, route", [("/START@bot now", "start"), ("/started", "unhandled"), ("x /start", "unhandled"),
                                          ("🌐 Language (English/हिंदी)", "language"), ("💎 Pro Vault Membership", "pro_plan"),
                                          ("edit_field:name", "registration"), ("start_claim_check", "claim_check"),
                                          ("start_claim_checks", "unhandled"), ("pro_upgrade_x", "protection_offers")])
def test_routes(spark, label, route):
    df = spark.createDataFrame([(label,)], "text string")
    assert messages.route_messages(df).first()["route"] == route
