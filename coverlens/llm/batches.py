"""How many texts go to a Python worker at once."""

#: Rows of an Arrow batch. Spark's own 10 000 rows of long texts take a worker, and the executor that fills the batch, hundreds of megabytes.
ROWS = 1_000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark, rows=ROWS):
    """Lets the session send at most `rows` rows at once; a smaller setting stays."""
    now = int(spark.conf.get(_SETTING))
    if now <= 0 or now > rows:
        spark.conf.set(_SETTING, str(rows))
