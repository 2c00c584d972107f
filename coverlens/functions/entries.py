"""Typed dates and months: values of the readable ones, reasons and replies for the others."""
from pyspark.sql import Column, DataFrame, functions as F

from coverlens import fixed_values as V
from coverlens.functions.dates import parse_human_date, shaped_like_date
from coverlens.functions.text import parse_months, strip, unicode_pattern

DATE, MONTHS = "date", "months"


def date_reason(c) -> Column:
    """Why a typed date is not one: nothing typed, no known form, or no such day; NULL for a readable form."""
    return F.when(F.coalesce(strip(c), F.lit("")) == "", "blank").when(~shaped_like_date(c), "unknown form").otherwise("no such day")


def months_reason(c) -> Column:
    text = F.coalesce(strip(c), F.lit(""))
    return (F.when(text == "", "blank").when(text.rlike(unicode_pattern(r"^-\d+$")), "negative")
            .when(text.rlike("^[0-9]+$"), "too large").otherwise("no whole number"))


def read_entries(entries: DataFrame, as_of) -> DataFrame:
    """Entries (field, typed) with `day` or `months`, and, for those that cannot be read, `reason` and `reply`.

    One pass over the entries. A field of another name is rejected as such. Exactly the rows without a reason have a value.
    """
    is_date, is_months = (F.coalesce(F.col("field") == f, F.lit(False)) for f in (DATE, MONTHS))
    day = F.when(is_date, parse_human_date("typed", as_of))
    months = F.when(is_months, parse_months("typed", strict=True))
    df = entries.withColumns({"day": day, "months": months})
    reason = (F.when(F.col("day").isNotNull() | F.col("months").isNotNull(), F.lit(None)).when(is_date, date_reason("typed"))
              .when(is_months, months_reason("typed")).otherwise("unknown field"))
    reply = F.when(is_date, V.DATE_REPLY).when(is_months, V.MONTHS_REPLY)
    return df.withColumn("reason", reason).withColumn("reply", F.when(F.col("reason").isNotNull(), reply))


def write_split(entries: DataFrame, as_of, directory: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): both written in one pass, in folders of their own, and read back. Together they are the input."""
    read = read_entries(entries, as_of).withColumn("accepted", F.col("reason").isNull())
    read.write.partitionBy("accepted").parquet(directory)
    stored = entries.sparkSession.read.schema(read.schema).parquet(directory)
    return (stored.where("accepted").drop("accepted", "reason", "reply"),
            stored.where("not accepted").drop("accepted", "day", "months"))
