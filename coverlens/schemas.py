"""Declared schemas of the four stored tables and of the nested records."""
from pyspark.sql import types as T


def _struct(**fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_S, _L, _I, _D, _TS, _F = (T.StringType(), T.LongType(), T.IntegerType(), T.DateType(),
                           T.TimestampType(), T.DoubleType())

USERS = _struct(user_id=_L, username=_S, first_name=_S, last_name=_S, phone=_S, language=_S,
                plan_tier=_S, vault_limit=_I, created_at=_TS)

PRODUCTS = _struct(id=_L, user_id=_L, product_name=_S, category=_S, brand=_S, model_no=_S,
                   serial_no=_S, purchase_platform=_S, purchase_date=_D, warranty_months=_I,
                   expiry_date=_D, price_paid=_F, room_location=_S, return_window_days=_I,
                   invoice_file_id=_S, invoice_file_type=_S, local_invoice_path=_S, notes=_S,
                   status=_S, created_at=_TS)

REMINDER_LOGS = _struct(id=_L, product_id=_L, reminder_type=_S, sent_at=_TS)

LEADS = _struct(id=_L, user_id=_L, product_id=_L, service_type=_S, provider=_S, status=_S,
                contact_phone=_S, created_at=_TS)

TABLES = {"users": USERS, "product_warranties": PRODUCTS, "reminder_logs": REMINDER_LOGS,
          "lead_requests": LEADS}

# A model answer is read as strings only: a number written in quotes must not
# be lost, and one odd field must not void the whole record.
ANSWER_FIELDS = ["image_type", "product_name", "brand", "category", "retailer", "purchase_date",
                 "price_paid", "serial_no", "warranty_months", "detected_issue",
                 "is_claimable_verdict", "verdict_reason", "indian_consumer_tip"]
ANSWER = T.StructType([T.StructField(f, _S, True) for f in ANSWER_FIELDS])

EVENTS = T.StructType([
    T.StructField("event_id", _L), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", _L), T.StructField("event_type", _S),
    T.StructField("value", _F), T.StructField("props", _S)])
