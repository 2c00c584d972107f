"""Reminders with delivery receipts: handed over, then delivered or failed; only what was delivered is logged.

The outbox holds one row per attempt, in a folder per day of reminding, and so do the receipts. A receipt names its attempt
and says whether it arrived. A run for a day

1. logs the attempts of that day that a receipt calls delivered,
2. hands over what is due by the log and has no attempt, and once more what has failed attempts only.

An attempt without a receipt is on its way and is not repeated. A reminder that failed is in no log; it is due again while
its milestone matches, that is on the same day only. Rows are keyed by (product, reminder, attempt), so a run that stopped
half-way is completed by the next one and a run that is repeated changes nothing. Several receipts of one attempt count as
delivered if one is. A day's run reads that day's folders of outbox and receipts, whatever the age of the store.
"""
import datetime

from pyspark.sql import DataFrame, functions as F

from coverlens.operators.lifecycle import milestones, render_reminder, unsent
from coverlens.sources.sinks import _append_new, stored

KEYS = ["product_id", "reminder_type"]
ATTEMPT = [*KEYS, "attempt"]
OUTBOX = ("product_id long, user_id long, reminder_type string, attempt int, days_left int, is_urgent boolean, message string, as_of date")
RECEIPTS = "product_id long, reminder_type string, attempt int, delivered boolean, received_at timestamp, as_of date"
LOG = "id long, product_id long, reminder_type string, sent_at timestamp"
HANDED_OVER, DELIVERED, FAILED = "handed_over", "delivered", "failed"


def append_receipts(receipts: DataFrame, directory: str) -> None:
    """Stores receipts; one that comes again, word for word, adds nothing."""
    _append_new(receipts.select("product_id", "reminder_type", "attempt", "delivered", "received_at", "as_of"), directory,
                [*ATTEMPT, "delivered", "received_at"], day="as_of")


def _day(spark, schema, directory, as_of):
    found = stored(spark, schema, directory)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.where(F.col("as_of") == F.lit(as_of))


def attempt_states(outbox: DataFrame, receipts: DataFrame) -> DataFrame:
    """Attempts with `state` and, once delivered, `delivered_at`. A receipt of an attempt that never was changes nothing."""
    told = receipts.groupBy(*ATTEMPT).agg(F.max("delivered").alias("_told"), F.min(F.when(F.col("delivered"), F.col("received_at"))).alias("delivered_at"))
    state = F.when(F.col("_told"), DELIVERED).when(~F.col("_told"), FAILED).otherwise(HANDED_OVER)
    return outbox.join(told, ATTEMPT, "left").withColumn("state", state).drop("_told")


def day_states(spark, as_of: datetime.date, outbox_dir: str, receipts_dir: str) -> DataFrame:
    return attempt_states(_day(spark, OUTBOX, outbox_dir, as_of), _day(spark, RECEIPTS, receipts_dir, as_of))


def log_delivered(spark, as_of: datetime.date, outbox_dir: str, receipts_dir: str, log_dir: str) -> None:
    """Logs the delivered reminders of a day, each once, at the time of its first good receipt."""
    done = day_states(spark, as_of, outbox_dir, receipts_dir).where(F.col("state") == DELIVERED)
    rows = done.groupBy(*KEYS).agg(F.min("delivered_at").alias("sent_at")).select(F.xxhash64(*KEYS).alias("id"), *KEYS, "sent_at")
    _append_new(rows, log_dir, KEYS)


def next_attempts(due: DataFrame, states: DataFrame) -> DataFrame:
    """Due reminders to hand over now, with the number of the attempt: none is on its way or delivered."""
    tried = states.groupBy(*KEYS).agg(F.max("attempt").alias("_last"), F.max(F.col("state") != FAILED).alias("_waits"))
    return (due.join(tried, KEYS, "left").where(~F.coalesce("_waits", F.lit(False)))
            .withColumn("attempt", (F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last", "_waits"))


def run_daily(products: DataFrame, as_of: datetime.date, outbox_dir: str, receipts_dir: str, log_dir: str) -> None:
    """One run for a day; any number of runs a day, with more receipts each time."""
    spark = products.sparkSession
    log_delivered(spark, as_of, outbox_dir, receipts_dir, log_dir)
    due = milestones(products, as_of)
    log = stored(spark, LOG, log_dir)
    due = due if log is None else unsent(due, log)
    out = render_reminder(next_attempts(due, day_states(spark, as_of, outbox_dir, receipts_dir)))
    _append_new(out.select("product_id", "user_id", "reminder_type", "attempt", "days_left", "is_urgent", "message", "as_of"), outbox_dir, ATTEMPT,
                day="as_of")
