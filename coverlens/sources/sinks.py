"""Appending sinks. Keys come from the data, so a retried batch adds nothing new."""
import functools
import operator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from coverlens import fixed_values as V
from coverlens.functions.dates import expiry_date
from coverlens.functions.text import or_default
from coverlens.operators.lifecycle import unsent
from coverlens.schemas import LEADS, PRODUCTS
from coverlens.session import materialize


def conform(df: DataFrame, schema) -> DataFrame:
    """The columns of a schema in order; missing ones become NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def product_rows(confirmed: DataFrame) -> DataFrame:
    """Confirmed registrations as product rows with defaults filled.

    Needs user_id, confirmed_at and confirmed_id (the confirming event); the
    row id is a hash of these, the same on every attempt.
    """
    df = confirmed
    for name, value in V.SAVE_DEFAULTS.items():
        df = df.withColumn(name, or_default(name, value) if name in V.EMPTY_IS_MISSING else F.coalesce(name, F.lit(value)))
    df = (df.withColumn("warranty_months", F.coalesce("warranty_months", F.lit(V.DEFAULT_WARRANTY_MONTHS)))
          .withColumn("purchase_date", F.coalesce("purchase_date", F.to_date("confirmed_at")))
          .withColumn("expiry_date", expiry_date("purchase_date", "warranty_months"))
          .withColumn("id", F.xxhash64("user_id", "confirmed_id", "confirmed_at"))
          .withColumn("return_window_days", F.lit(V.DEFAULT_RETURN_WINDOW_DAYS))
          .withColumn("status", F.lit("active"))
          .withColumn("created_at", F.col("confirmed_at")))
    return conform(df, PRODUCTS)


#: Parts of a stored table. A key belongs to one part; an append meets only parts that may hold its keys.
PARTS = 64


def _parts_of(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("key_part").distinct().collect())  # at most PARTS


def _append_new(rows: DataFrame, directory: str, keys: list[str], day: str | None = None) -> None:
    """Append rows whose key is not stored yet, once each; a NULL in a key is a value like others.

    The table lies in folders by a hash of the key (within folders by ``day``, if that is given; it then belongs to the key).
    `_keys` in it holds the hashes of the stored keys alone, in folders likewise: a small filter that tells which of the new
    keys may be stored. Of the hashes only the parts are read that new keys fall into, and of the table only the parts in
    which one of them was found. Hashes are written before rows: a run that stops between the two leaves keys that may be
    stored but are not, and the next one, as it looks at the rows too, adds them.
    """
    spark, schema = rows.sparkSession, rows.schema
    folders = ([day] if day else []) + ["key_part"]
    keys = list(dict.fromkeys([*keys, *folders[:-1]]))
    h = F.xxhash64(F.lit("key"), *keys)
    new = materialize(rows.dropDuplicates(keys).withColumn("_h", h).withColumn("key_part", F.pmod(h, F.lit(PARTS)).cast("int")), "append")
    touched = _parts_of(new)
    if not touched:
        if stored(spark, schema, directory) is None:
            rows.limit(0).write.mode("append").parquet(directory)
        return
    days = [r[0] for r in new.select(day).distinct().collect()] if day else []  # the days of one batch

    def within(df, parts):
        df = df.where(F.col("key_part").isin(parts))
        return df.where(F.col(day).isin(days)) if day else df

    known = stored(spark, ", ".join(["_h long", *([f"{day} {schema[day].dataType.simpleString()}"] if day else [])]), f"{directory}/_keys")
    met = []
    if known is not None:
        met = _parts_of(new.join(within(known, touched).select("_h").distinct(), "_h", "left_semi"))
    if met:
        old = within(stored(spark, schema, directory), met).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
        same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        new = materialize(new.join(old, same, "left_anti"), "append")
    for df, target in ((new.select("_h", *folders), f"{directory}/_keys"), (new.drop("_h"), directory)):
        df.hint("rebalance", *folders).write.mode("append").partitionBy(*folders).parquet(target)


def stored(spark, schema, directory: str) -> DataFrame | None:
    """A stored table; none if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(directory)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def not_logged(due: DataFrame, log_dir: str) -> DataFrame:
    """Due reminders that the stored log does not hold."""
    log = stored(due.sparkSession, "product_id long, reminder_type string", log_dir)
    return due if log is None else unsent(due, log)


def append_products(confirmed: DataFrame, directory: str) -> None:
    # The hash alone could meet another product's at very large counts; with owner and time it cannot.
    _append_new(product_rows(confirmed), directory, ["id", "user_id", "created_at"])


def append_leads(leads: DataFrame, directory: str) -> None:
    _append_new(conform(leads, LEADS), directory, ["id"])


def emit_reminders(due: DataFrame, outbox_dir: str, log_dir: str) -> None:
    """Write due reminders to the outbox, then log what the outbox holds.

    The log is filled from the outbox and not from the plan of ``due``: what
    was never handed over is never logged, and a run that stops between the
    two writes is completed by the next one.
    """
    spark = due.sparkSession
    keys = ["product_id", "reminder_type"]
    _append_new(due, outbox_dir, keys)
    handed_over = spark.read.schema(due.schema).parquet(outbox_dir)
    log = handed_over.select(
        F.xxhash64(*keys).alias("id"), *keys, F.col("as_of").cast("timestamp").alias("sent_at"))
    _append_new(log, log_dir, keys)
