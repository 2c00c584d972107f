"""Hot keys, folds and plans: same results as the plain form, without its bottleneck."""
import datetime
import random

import pytest
from pyspark.sql import Window, functions as F

from checks import fixtures as X
from coverlens import fixed_values as V
from coverlens.operators import hot_keys, lifecycle, limits
from coverlens.operators.bills import extract_bill
from coverlens.operators.claims import claim_answer
from coverlens.operators.enrich import claim_dossier, with_brand_support
from coverlens.operators.users import only_admins
from coverlens.plans.reminders import reminders_due


def skewed(spark, n=3000):
    """A third of all rows belong to user 1, and most of those to one day."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("product_id"), F.when(i % 3 == 0, 1).when(i % 50 == 1, None).otherwise(i % 97).alias("user_id"),
        F.date_add(F.lit(datetime.date(2026, 1, 1)), F.when(i % 9 == 0, 5).otherwise(i % 40).cast("int")).alias("expiry_date"),
        (i * 7 % 13).alias("v"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("steps", [1, 50, 1000])
@pytest.mark.parametrize("hashed", [False, True])
def test_catalog_positions(spark, steps, hashed):
    df = skewed(spark)
    if hashed:  # ids as the sinks write them
        df = df.withColumn("product_id", F.xxhash64("product_id"))
    got = lifecycle.vault_catalog(df, X.AS_OF, steps=steps).select("product_id", "position")
    w = Window.partitionBy("user_id").orderBy("expiry_date", "product_id")
    assert rows(got) == rows(df.select("product_id", F.row_number().over(w).cast("bigint").alias("position")))


def test_slices_of_ids_are_bounded_in_number_and_size(spark):
    """Dense and hashed ids of one owner: the order of slices is the order of ids, there are many slices and none is large."""
    n = 200_000
    for ids in (F.col("id"), F.col("id") + 10 ** 12, F.xxhash64("id"), -F.col("id") * 977):
        df = spark.range(n).select(ids.alias("product_id")).withColumn("b", lifecycle.id_bucket("product_id"))
        per = df.groupBy("b").agg(F.count("*").alias("n"), F.min("product_id").alias("lo"), F.max("product_id").alias("hi"))
        found = per.orderBy("b").collect()
        assert all(a.hi < b.lo for a, b in zip(found, found[1:])) and len(found) < 100_000
    hashed = spark.range(n).select(lifecycle.id_bucket(F.xxhash64("id")).alias("b")).groupBy("b").count().agg(F.max("count"), F.count("*")).first()
    assert hashed[0] < n / 500 and hashed[1] < n / 10


def test_running_last(spark):
    df = skewed(spark).withColumn("x", F.when(F.col("v") > 9, F.col("v"))).withColumn("b", F.col("expiry_date"))
    got = hot_keys.running_last(df, ["user_id"], ["b"], ["expiry_date", "product_id"], {"here": F.col("x")}, {"prior": F.col("x")})
    w = Window.partitionBy("user_id").orderBy("expiry_date", "product_id")
    want = df.select("product_id", F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("here"),
                     F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prior"))
    assert rows(got.select("product_id", "here", "prior")) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, how):
    fact = skewed(spark)
    dim = spark.range(60).select(F.col("id").alias("user_id"), F.concat(F.lit("u"), "id").alias("name"))
    got = hot_keys.spread_join(fact, dim, "user_id", ["product_id"], how, hot_rows=100)
    want = fact.join(dim, "user_id", how)
    columns = [c for c in ("product_id", "name") if c in want.columns]
    assert rows(got.select(columns)) == rows(want.select(columns))


def test_spread_join_splits_the_hot_key(spark):
    fact = skewed(spark)
    n = fact.where("user_id = 1").count()
    dim = spark.range(60).select(F.col("id").alias("user_id"))
    joined = hot_keys.spread_join(fact, dim, "user_id", ["product_id"], hot_rows=100)
    assert joined.count() == fact.join(dim, "user_id").count()
    slices = -(-n // 100)  # as many as the key's rows ask for, whatever their number
    rows_of = fact.where("user_id = 1").select(F.pmod(F.xxhash64("product_id"), F.lit(slices)).alias("s")).groupBy("s").count()
    assert rows_of.count() == slices and rows_of.agg(F.max("count")).first()[0] < 200


def test_rate_counts(spark):
    base = datetime.datetime(2026, 1, 1)
    random.seed(3)
    events = [(i, i % 3, base + datetime.timedelta(seconds=random.randrange(900))) for i in range(600)]
    df = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp")
    got = {r["event_id"]: r["requests_in_window"] for r in limits.request_rate(df, 60).collect()}
    for i, u, t in events:
        assert got[i] == sum(1 for _, v, s in events if v == u and t - datetime.timedelta(seconds=60) < s <= t)


def brute_limiter(events, most, seconds):
    kept, out = {}, {}
    for i, u, t in sorted(events, key=lambda e: (e[2], e[0])):
        k = [s for s in kept.get(u, []) if s > t - datetime.timedelta(seconds=seconds)]
        out[i] = len(k) < most
        kept[u] = k + [t] if out[i] else k
    return out


@pytest.mark.parametrize("most, block_rows, span", [(3, 500_000, 4000), (3, 40, 700), (10, 60, 500), (1, 25, 900)])
def test_limiter_against_brute_force(spark, most, block_rows, span):
    """User 0 sends two thirds of all requests and is over the limit for long stretches."""
    base = datetime.datetime(2026, 1, 1)
    random.seed(most * 1000 + block_rows)
    events = [(i, 0 if i % 3 else random.randrange(1, 6), base + datetime.timedelta(seconds=random.randrange(span)))
              for i in range(400)]
    df = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp")
    got = {r["event_id"]: r["accepted"] for r in limits.allow_requests(df, most, 60, block_rows).collect()}
    assert got == brute_limiter(events, most, 60)


@pytest.mark.parametrize("even", [False, True])
def test_limiter_blocks_at_once(spark, monkeypatch, even):
    """One user over the limit in twenty blocks: irregular requests take few rounds, requests at even distances one a block."""
    folds = []
    fold_blocks = limits._fold_blocks
    monkeypatch.setattr(limits, "_fold_blocks", lambda *given: folds.append(1) or fold_blocks(*given))
    base = datetime.datetime(2026, 1, 1)
    random.seed(8)
    at = [7.0 * i for i in range(400)] if even else sorted(random.uniform(0, 6000) for _ in range(1200))
    events = [(i, 0, base + datetime.timedelta(seconds=t)) for i, t in enumerate(at)]
    df = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp")
    got = {r["event_id"]: r["accepted"] for r in limits.allow_requests(df, 3, 30, 40 if even else 60).collect()}
    assert got == brute_limiter(events, 3, 30)
    assert len(folds) <= (10 if even else 6)


def test_limiter_edge(spark):
    """The eleventh request exactly one window after the first is accepted."""
    base = datetime.datetime(2026, 1, 1)
    times = [base + datetime.timedelta(milliseconds=100 * i) for i in range(10)] + [base + datetime.timedelta(seconds=60)]
    df = spark.createDataFrame([(i, 7, t) for i, t in enumerate(times)], "event_id long, user_id long, ts timestamp")
    assert limits.allow_requests(df).where("accepted").count() == 11


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_milestones_reach_the_scan(spark, sf, tmp_path):
    X.v_products(spark, sf).write.parquet(str(tmp_path / "p"))
    p = plan(lifecycle.milestones(spark.read.parquet(str(tmp_path / "p")), X.AS_OF))
    assert "In(expiry_date" in p and "Exchange" not in p
    assert "In(user_id" in plan(only_admins(spark.read.parquet(f"{sf}/events.parquet"), X.ADMINS))


def test_due_is_an_anti_join(spark, sf):
    p = plan(reminders_due(X.v_products(spark, sf), X.v_reminder_log(spark, sf), X.AS_OF))
    assert "LeftAnti" in p


def test_row_work_neither_shuffles_nor_leaves_the_jvm(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bills = extract_bill(docs, "text", None, X.AS_OF)
    answers = claim_answer(docs.withColumnRenamed("text", "issue"))
    brands = with_brand_support(docs.withColumnRenamed("source", "brand"))
    for df in (bills, answers, brands):
        p = plan(df)
        assert "hashpartitioning" not in p and "Python" not in p and "NestedLoop" not in p and "Cartesian" not in p


def test_only_bounded_sides_are_broadcast(spark, sf, monkeypatch):
    """With automatic broadcasting off, what is still broadcast are lookup tables and the list of hot keys."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(claim_dossier(X.v_products(spark, sf), X.v_users(spark, sf), X.AS_OF))
        assert p.count("SortMergeJoin") >= 1 and "_hot" in p
        assert "Broadcast" not in plan(lifecycle.vault_summary(X.v_products(spark, sf), X.v_users(spark, sf), X.AS_OF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_catalog_moves_rows_once(spark, tmp_path):
    """Without broadcasts the rows are shuffled once; the join back reuses their partitioning."""
    skewed(spark).withColumn("wide", F.lit("x")).write.parquet(str(tmp_path / "p"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(lifecycle.vault_catalog(spark.read.parquet(str(tmp_path / "p")), X.AS_OF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in p and p.count("Exchange hashpartitioning") == 4


def test_top_one_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(lifecycle.next_expiring(skewed(spark)))


def test_bill_fields_that_are_not_asked_for_are_not_computed(spark, sf):
    """F10 to F12: the struct of a bill is kept whole, so a few fields of it cost as much as all."""
    from checks.registry import QUERIES
    from coverlens.functions.text import unicode_pattern
    price = unicode_pattern(V.PRICE_PATTERN)
    for name, needed in (("B1_bill_record", True), ("B2_B5_product_name", False), ("B11_food", False)):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert (price in plan) is needed, name


def test_events_without_a_file_do_not_meet_in_one_task(spark, monkeypatch):
    """F7 to F9: NULL keys of a sorted join would all go to one partition."""
    from coverlens.operators.sessions import FILE_FIELDS, with_files
    bill = F.struct(*[F.lit(None).cast("string").alias(n) for n in FILE_FIELDS])
    has = F.col("id") % 100 == 0
    events = spark.range(20_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, bill).alias("bill"),
                                        F.when(has, F.concat(F.lit("f"), (F.col("id") % 900).cast("string"))).alias("file_id"))
    files = spark.range(0, 900, 100).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_id"), F.lit("/in/x").alias("path"),
                                            (F.col("id") % 200 == 0).alias("is_photo"), (F.col("id") != 300).alias("accepted"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_files(events, files)
        most = max(r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect())
        found = {r["event_id"]: r["bill"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 10_000
    assert len(found) == 20_000 and found[1] is None and found[5]["invoice_file_id"] is None
    assert tuple(found[200]) == ("f200", "photo", "/in/x") and tuple(found[100])[1] == "document" and found[300]["invoice_file_id"] is None


def test_bill_texts_are_dealt_for_the_intake(spark, sf):
    """Texts are read by several tasks a core, however few bytes they have, after the join with the answers too."""
    from checks.registry import QUERIES
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert QUERIES["E1_intake"](spark, sf).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
