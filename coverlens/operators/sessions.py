"""Registration sessions: photo, edits, confirm or cancel, folded per user.

A new photo or a fresh start writes every field, an edit writes one, so the
state at any moment is the latest write of each field since the session began.
The session of an event is a running value, computed per (user, hour) with a
carry over the hours; the fields are then aggregated per session, reduced on
the map side. No task ever holds all events of one user.
"""
from pyspark.sql import DataFrame, functions as F

from coverlens import fixed_values as V
from coverlens.functions.dates import parse_human_date
from coverlens.functions.text import (first_word, parse_months, parse_price, sanitize_serial, sanitize_text, strip)
from coverlens.operators.hot_keys import running_last

FIELDS = {"product_name": "string", "brand": "string", "category": "string", "purchase_platform": "string",
          "purchase_date": "date", "warranty_months": "int", "serial_no": "string", "price_paid": "double"}
#: The bill file that a photo or document brings along; a photo writes all three at once, an entry by hand none.
FILE_FIELDS = {"invoice_file_id": "string", "invoice_file_type": "string", "local_invoice_path": "string"}
FIELDS |= FILE_FIELDS
STARTS, ENDS = ["photo", "add"], ["confirm", "cancel"]
PHOTO_SCHEMA = "struct<" + ", ".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">"


def with_files(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events whose bill refers to its file: (file_id, path, is_photo, accepted) as checked at intake.

    The file of an event is named by ``file_id``. A rejected or unknown file gives no reference, whole or in part.
    Most events name none and take no part in the join: as NULL keys they would all be sorted by one task.
    """
    known = files.where("accepted").select(F.col("file_id").alias("_file"), F.col("path").alias("_path"),
                                           F.when(F.col("is_photo"), "photo").otherwise("document").alias("_type"))
    named = events.where(F.col("file_id").isNotNull()).join(known, F.col("file_id") == F.col("_file"), "left")
    found = named.unionByName(events.where(F.col("file_id").isNull()), allowMissingColumns=True)
    bill = F.col("bill")
    for name, value in zip(FILE_FIELDS, ("_file", "_type", "_path")):
        bill = bill.withField(name, F.col(value))
    return found.withColumn("bill", F.when(F.col("bill").isNotNull(), bill)).drop("file_id", "_file", "_path", "_type")


def field_writes(events: DataFrame) -> DataFrame:
    """One column ``w_<field>`` per field: a struct when the event writes it, NULL when it does not.

    The struct lets a written NULL (a skipped serial number) differ from no
    write. Unreadable dates, months and prices write nothing.
    """
    starts = F.col("kind").isin(STARTS)
    value = F.coalesce("value", F.lit(""))

    def edit(field):
        return (F.col("kind") == "edit") & (F.col("field") == field)

    def skip(field):
        return (F.col("kind") == "skip") & (F.col("field") == field)
    today = F.to_date("ts")
    typed_day = parse_human_date(value, today)
    typed_months = parse_months(value, strict=True)
    typed_price = parse_price(value)
    brand = sanitize_text(first_word(value), V.SHORT_TEXT_MAX_CHARS)
    edits = {
        "product_name": [(edit("name"), sanitize_text(value, V.TEXT_MAX_CHARS))],
        "brand": [(edit("name") & (strip(value) != ""), brand)],
        "category": [(edit("category"), F.col("value"))],
        "purchase_platform": [(edit("retailer"), sanitize_text(value, V.SHORT_TEXT_MAX_CHARS)),
                              (edit("platform"), F.col("value"))],
        "purchase_date": [(edit("date") & typed_day.isNotNull(), typed_day)],
        "warranty_months": [(edit("warranty") & typed_months.isNotNull(), typed_months),
                            (edit("warranty_preset"), parse_months(value))],
        "serial_no": [(edit("serial"), sanitize_serial(value)), (skip("serial"), F.lit(None))],
        "price_paid": [(edit("price") & typed_price.isNotNull(), typed_price), (skip("price"), F.lit(None))],
    }
    out = {}
    for name, dtype in FIELDS.items():
        def written(v):
            return F.struct(v.cast(dtype).alias("v"))
        w = F.when(starts, written(F.col(f"bill.{name}")))
        for cond, v in edits.get(name, []):
            w = w.when(cond, written(v))
        out[f"w_{name}"] = w
    return events.withColumns(out)


def confirmed_registrations(events: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """State of each session at its confirmation: (user_id, ts, event_id, kind, field, value, bill) folded.

    With ``idle_seconds`` a session also ends where its user's next event comes later than that. The time of the event
    before is a running value like the others.

    Only two values run over a user's events: which session began last, and
    whether one is open. Events outside a session are dropped there; the rest
    are grouped by session, where the latest write of each field counts.
    Nothing follows a confirmation in its session, so all writes precede it.
    """
    staged = events.withColumn("_hour", F.date_trunc("hour", "ts"))
    starts = F.col("kind").isin(STARTS)
    over = F.col("kind").isin(ENDS)
    alive = F.lit(True)
    if idle_seconds is not None:
        staged = running_last(staged, keys=["user_id"], buckets=["_hour"], order=["ts", "event_id"], values={}, previous={"_before": F.col("ts")})
        idle = F.coalesce(F.unix_micros("ts") - F.unix_micros("_before") > int(idle_seconds * 1_000_000), F.lit(False))
        over, alive = over | idle, ~idle
    is_open = F.when(starts, True).when(over, False)
    placed = running_last(staged, keys=["user_id"], buckets=["_hour"], order=["ts", "event_id"],
                          values={"_session": F.when(starts, F.struct("event_id", "ts"))}, previous={"was_open": is_open})
    inside = field_writes(placed.where(starts | (F.col("was_open") & alive)))
    at = F.struct("ts", "event_id")
    latest = [F.max_by(f"w_{n}", F.when(F.col(f"w_{n}").isNotNull(), at)).alias(f"s_{n}") for n in FIELDS]
    done = inside.groupBy("user_id", "_session").agg(F.max(F.when(F.col("kind") == "confirm", at)).alias("_done"), *latest)
    return done.where(F.col("_done").isNotNull()).select(
        "user_id", F.col("_session.event_id").alias("session_id"), F.col("_done.event_id").alias("confirmed_id"), F.col("_done.ts").alias("confirmed_at"),
        *[F.col(f"s_{n}.v").alias(n) for n in FIELDS])
