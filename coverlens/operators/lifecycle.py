"""Warranty lifecycle: expiry, statuses, reminders due, vault summary and catalog."""
import datetime

from pyspark.sql import DataFrame, Window, functions as F

from coverlens import fixed_values as V
from coverlens.functions.dates import day, days_left, expiry_date, format_day
from coverlens.functions.text import as_col
from coverlens.operators.hot_keys import running_totals


def with_expiry(df: DataFrame) -> DataFrame:
    return df.withColumn("expiry_date", expiry_date("purchase_date", "warranty_months"))


def with_remaining(df: DataFrame, as_of) -> DataFrame:
    """Days left and expiry flag; on its last day a product is still covered."""
    return (df.withColumn("days_remaining", days_left("expiry_date", as_of))
            .withColumn("is_expired", day(as_of) > F.col("expiry_date")))


def _days_text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def vault_status(df: DataFrame, as_of) -> DataFrame:
    d = days_left("expiry_date", as_of)
    soon, over = d <= V.EXPIRING_SOON_DAYS, d < 0
    return (df.withColumn("status_icon", F.when(over, V.ICON_RED).when(soon, V.ICON_YELLOW).otherwise(V.ICON_GREEN))
            .withColumn("status_note",
                        F.when(over, _days_text("Expired ", F.abs(d), "d ago"))
                        .when(soon, _days_text(d, "d left (Expiring soon!)"))
                        .otherwise(_days_text(d, "d left"))))


def dossier_status(df: DataFrame, as_of) -> DataFrame:
    d = days_left("expiry_date", as_of)
    return df.withColumn("dossier_status",
                         F.when(d > 0, _days_text("ACTIVE (", d, " days remaining)"))
                         .when(d == 0, F.lit("EXPIRES TODAY"))
                         .otherwise(_days_text("EXPIRED (", F.abs(d), " days ago)")))


def card_status(df: DataFrame, as_of) -> DataFrame:
    """Status on the scan card; here the last day already counts as expired."""
    d = days_left("expiry_date", as_of)
    none = F.col("warranty_months") == 0
    return (df.withColumn("card_icon", F.when(none, V.ICON_WHITE).when(d > 0, V.ICON_GREEN).otherwise(V.ICON_PURPLE))
            .withColumn("card_text", F.when(none, F.lit(V.NO_WARRANTY_TEXT))
                        .when(d > 0, _days_text("*", d, " Days Remaining*"))
                        .otherwise(_days_text("*Expired (", F.abs(d), " days ago)*"))))


def milestone_tag(days):
    return F.when(days == 0, F.lit("expired")).otherwise(F.concat(days.cast("string"), F.lit("_day")))


def milestones(products: DataFrame, as_of: datetime.date) -> DataFrame:
    """Products that reach a reminder day on ``as_of``.

    The rule is written on expiry_date itself so that it reaches the scan.
    """
    due_dates = [as_of + datetime.timedelta(days=n) for n in V.REMINDER_DAYS]
    df = products.where(F.col("expiry_date").isin(due_dates))
    left = days_left("expiry_date", as_of)
    return (df.withColumn("days_left", left).withColumn("reminder_type", milestone_tag(left))
            .withColumn("as_of", day(as_of)))


def milestones_between(products: DataFrame, first: datetime.date, last: datetime.date) -> DataFrame:
    """Reminders of a range of days: one row per product and milestone in it."""
    reach = last + datetime.timedelta(days=max(V.REMINDER_DAYS))
    df = products.where(F.col("expiry_date").between(first, reach))
    days = F.explode(F.array(*[F.lit(n) for n in V.REMINDER_DAYS]))
    df = df.withColumn("days_left", days).withColumn("as_of", F.date_sub("expiry_date", F.col("days_left")))
    return df.where(F.col("as_of").between(first, last)).withColumn("reminder_type", milestone_tag(F.col("days_left")))


def unsent(due: DataFrame, log: DataFrame) -> DataFrame:
    """Due reminders without a log entry of the same product and type.

    The log is reduced to its distinct keys first: repeated entries of one
    product collapse on the map side instead of meeting in one task.
    """
    keys = ["product_id", "reminder_type"]
    return due.join(log.select(*keys).distinct(), keys, "left_anti")


def due_reminders(products: DataFrame, log: DataFrame, as_of: datetime.date) -> DataFrame:
    return unsent(milestones(products, as_of), log)


def render_reminder(due: DataFrame) -> DataFrame:
    urgent = F.col("days_left") <= V.URGENT_DAYS
    head = F.when(urgent, V.URGENT_HEAD).otherwise(V.NORMAL_HEAD)
    when = F.when(F.col("days_left") > 0, _days_text("in *", F.col("days_left"), " days*")).otherwise("*TODAY*")
    text = F.concat(head, F.lit("\n\nYour *"), F.col("product_name"), F.lit("* warranty expires "), when, F.lit(" ("),
                    format_day("expiry_date"), F.lit(")!\n\n" + V.REMINDER_TAIL))
    return due.withColumn("is_urgent", urgent).withColumn("message", text)


def vault_summary(products: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Products and active warranties of every user; users without any get zeros."""
    counts = products.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(day(as_of) <= F.col("expiry_date")).alias("active"))
    return (users.select("user_id").join(counts, "user_id", "left")
            .select("user_id", F.coalesce("total", F.lit(0)).alias("total"),
                    F.coalesce("active", F.lit(0)).alias("active"))
            .withColumn("is_empty", F.col("total") == 0))


def id_bucket(product_id, steps: int = 1000):
    """A slice of the ids that follows their order: each is about 1/``steps`` of its ids wide.

    So there are at most a hundred thousand of them, and hashed ids, which are spread over 64 bits, as well as dense ones fall
    into many, of which none holds more than a small share of an owner's products.
    """
    x = as_col(product_id).cast("double")
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * steps)


def vault_catalog(products: DataFrame, as_of, steps: int = 1000) -> DataFrame:
    """Products of each user numbered by expiry, with status.

    Numbering is split by (user, day, slice of ids): one owner may hold a third
    of all products and is still numbered by many tasks.
    """
    cut = products.withColumn("_block", id_bucket("product_id", steps))
    ranked = running_totals(cut, keys=["user_id"], buckets=["expiry_date", "_block"], order=["product_id"],
                            sums={"position": F.lit(1)})
    return vault_status(ranked.drop("_block"), as_of)


def next_expiring(products: DataFrame, k: int = 1) -> DataFrame:
    """The k soonest expiring products of each user.

    The rank filter lets Spark cut each user's rows to k before the shuffle.
    """
    w = Window.partitionBy("user_id").orderBy("expiry_date", "product_id")
    return products.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
