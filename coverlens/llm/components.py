"""Connected components of a graph given as edges, by alternating large and small stars."""
from pyspark.sql import functions as F

from coverlens.session import materialize

MOST_ROUNDS = 40


def _state(edges):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges, name="components"):
    """edges: (a, b) in any order, repeated or not. Returns (node, component) for every node that has an edge to another.

    component is the smallest node of the component. Each round points every node at smaller nodes only, so it halves the
    way to the smallest one; all steps are aggregates with map-side reduction and equi joins, and no node's neighbours are
    ever gathered. Every round is written to the shared folder, so that a lost executor costs one round at most.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), name)
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
