"""Work on keys that may hold a large part of all rows.

``running_totals`` and ``running_last`` give the result of a window over a whole
key, but no task ever sees a whole key: rows are grouped by (key, bucket), and
what earlier buckets contribute is computed on one row per (key, bucket).
Buckets must follow the order of the rows; use a day or another slice of time,
so that the number of buckets of a key is bounded by the calendar.

``spread_join`` is an equi join in which frequent keys are split over many tasks.
"""
from pyspark.sql import DataFrame, Window, functions as F


def _cut(df, keys, buckets):
    """Adds ``_at``, the (key, bucket) of a row as one struct.

    Windows, sums and the join back all go by this one column and so share
    one partitioning. A struct also lets a NULL key meet itself in the join.
    """
    return df.withColumn("_at", F.struct(*keys, *buckets))


def _inside(order, end):
    return Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)


def _before(keys, buckets):
    return (Window.partitionBy(*[F.col(f"_at.{k}") for k in keys]).orderBy(*[F.col(f"_at.{b}") for b in buckets])
            .rowsBetween(Window.unboundedPreceding, -1))


def _clean(df, names):
    return df.drop("_at", *[f"{p}{n}" for n in names for p in ("_v_", "_i_", "_c_")])


def running_totals(df: DataFrame, keys, buckets, order, sums: dict) -> DataFrame:
    """Running sums per key, the current row included."""
    names = list(sums)
    staged = _cut(df, keys, buckets).withColumns({f"_v_{n}": F.coalesce(e.cast("bigint"), F.lit(0)) for n, e in sums.items()})
    totals = staged.groupBy("_at").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = _before(keys, buckets)
    carry = totals.select("_at", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in names])
    inside = _inside(order, Window.currentRow)
    out = staged.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in names}).join(carry, "_at", "left")
    return _clean(out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_c_{n}") for n in names}), names)


def running_last(df: DataFrame, keys, buckets, order, values: dict, previous: dict | None = None) -> DataFrame:
    """Latest non-NULL value per key in order, the current row included.

    ``previous`` names values of which the current row is left out.
    """
    previous = previous or {}
    every = {**values, **previous}
    names = list(every)
    staged = _cut(df, keys, buckets).withColumns({f"_v_{n}": e for n, e in every.items()})
    at = F.struct(*order)
    totals = staged.groupBy("_at").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in names])
    before = _before(keys, buckets)
    carry = totals.select("_at", *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in names])
    upto, earlier = _inside(order, Window.currentRow), _inside(order, -1)
    inside = staged.withColumns({
        f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(earlier if n in previous else upto) for n in names})
    out = inside.join(carry, "_at", "left")
    return _clean(out.withColumns({n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in names}), names)


def spread_join(fact: DataFrame, dim: DataFrame, key: str, spread_on: list[str], how: str = "inner",
                hot_rows: int = 2_000_000) -> DataFrame:
    """Join facts to a table with unique keys; keys with many facts are split into slices of about ``hot_rows`` facts.

    Keys are counted on the key column alone, reduced on the map side. A key of
    n facts gets ceil(n / hot_rows) slices, so a slice does not grow with its
    key; the key's row in ``dim`` is repeated once per slice. The list of keys
    with more than one slice has at most (facts / hot_rows) rows; the planner
    decides how to join it. A NULL key matches nothing and is split likewise.
    The slice is a hash of ``spread_on``, so a task that is run again puts its
    rows where the first run put them.
    """
    hot = (fact.groupBy(F.col(key).alias("_hot")).count()
           .select("_hot", F.ceil(F.col("count") / hot_rows).cast("int").alias("_slices")).where("_slices > 1"))
    left = (fact.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left")
            .withColumn("_slice", F.pmod(F.xxhash64(*spread_on), F.coalesce("_slices", F.lit(1))).cast("int"))
            .drop("_hot", "_slices"))
    right = (dim.join(hot, F.col(key) == F.col("_hot"), "left")
             .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
             .drop("_hot", "_slices"))
    return left.join(right, [key, "_slice"], how).drop("_slice")
