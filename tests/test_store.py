"""Appends by key, delivery receipts, versions of a store, rejected entries, sessions that are left."""
import datetime
import glob

import pytest
from pyspark.sql import functions as F

from checks import fixtures as X
from coverlens.functions import entries
from coverlens.operators import sessions
from coverlens.plans import store_changes
from coverlens.session import work_dir
from coverlens.sources import delivery, sinks, snapshots, tables
from coverlens.streaming.ordered import rocksdb_state
from coverlens.streaming.sessions import stream_registrations

ROW = "id long, owner long, note string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def append(spark, folder, data, keys=("id", "owner")):
    sinks._append_new(spark.createDataFrame(data, ROW), folder, list(keys))


def test_append_adds_each_key_once(spark, tmp_path):
    folder = f"{tmp_path}/t"
    data = [(1, 1, "a"), (2, None, "b"), (None, None, "c"), (2, None, "b"), (None, 3, "d")]
    for _ in range(3):
        append(spark, folder, data)
    append(spark, folder, [])
    append(spark, folder, [(1, 1, "other"), (4, 1, "e")])
    got = rows(sinks.stored(spark, ROW, folder).select("id", "owner", "note"))
    assert got == sorted({*data, (4, 1, "e")}, key=str)


def test_append_of_nothing_makes_an_empty_table(spark, tmp_path):
    append(spark, f"{tmp_path}/t", [])
    assert sinks.stored(spark, ROW, f"{tmp_path}/t").count() == 0
    append(spark, f"{tmp_path}/t", [(1, 1, "a")])
    assert sinks.stored(spark, ROW, f"{tmp_path}/t").count() == 1


def test_append_completes_a_run_that_stopped_after_the_hashes(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/t"
    append(spark, folder, [(1, 1, "a")])
    half = f"{tmp_path}/half"
    append(spark, half, [(2, 2, "b")])
    spark.read.parquet(f"{half}/_keys").write.mode("append").partitionBy("key_part").parquet(f"{folder}/_keys")
    append(spark, folder, [(1, 1, "a"), (2, 2, "b")])
    assert rows(sinks.stored(spark, ROW, folder).select("id")) == [(1,), (2,)]


def test_append_reads_only_parts_that_may_hold_its_keys(spark, tmp_path):
    """All parts but those of the appended keys are made unreadable, hashes and rows."""
    folder = f"{tmp_path}/t"
    append(spark, folder, [(i, i, "x") for i in range(2000)])
    assert len(glob.glob(f"{folder}/key_part=*")) == sinks.PARTS

    def spoil(root, spared):
        for path in glob.glob(f"{root}/key_part=*/*.parquet"):
            if int(path.split("key_part=")[1].split("/")[0]) not in spared:
                with open(path, "wb") as f:
                    f.write(b"unreadable")

    def part(*key):
        frame = spark.createDataFrame([key], "id long, owner long")
        return frame.select(F.pmod(F.xxhash64(F.lit("key"), "id", "owner"), F.lit(sinks.PARTS)).alias("p")).first()[0]

    old, new = part(7, 7), part(10_000, 10_000)
    spoil(f"{folder}/_keys", {old, new})
    spoil(folder, {old})  # of the rows, only the part of the key that is stored already
    append(spark, folder, [(7, 7, "again"), (10_000, 10_000, "new")])
    read = spark.read.schema(ROW).option("ignoreCorruptFiles", "true").parquet(folder)
    assert rows(read.where("id = 10000").select("note")) == [("new",)] and rows(read.where("id = 7").select("note")) == [("x",)]


DAY = datetime.date(2026, 1, 1)


def product(i, left, user=1):
    return (i, user, f"TV {i}", DAY + datetime.timedelta(days=left))


def receipt(i, attempt, good, kind="7_day", minute=0):
    return (i, kind, attempt, good, datetime.datetime(2026, 1, 1, 9, minute), DAY)


def test_receipts(spark, tmp_path):
    outbox, told, log = (f"{tmp_path}/{n}" for n in ("outbox", "told", "log"))
    products = spark.createDataFrame([product(i, 7) for i in range(5)] + [product(9, 8), product(10, 3)], "product_id long, user_id long, product_name string, expiry_date date")

    def run(day=DAY):
        delivery.run_daily(products, day, outbox, told, log)
        return {(r.product_id, r.attempt): r.state for r in delivery.day_states(spark, day, outbox, told).collect()}

    def tell(*receipts):
        delivery.append_receipts(spark.createDataFrame(receipts, delivery.RECEIPTS), told)

    def logged():
        return sorted(r.product_id for r in sinks.stored(spark, delivery.LOG, log).collect())

    assert run() == run() == {(i, 1): "handed_over" for i in range(5)} and logged() == []
    tell(receipt(0, 1, True), receipt(1, 1, False), receipt(2, 1, False), receipt(2, 1, True, minute=5), receipt(77, 1, True), receipt(3, 2, True))
    tell(receipt(0, 1, True))
    want = {(0, 1): "delivered", (1, 1): "failed", (1, 2): "handed_over", (2, 1): "delivered", (3, 1): "handed_over", (4, 1): "handed_over"}
    assert run() == run() == want and logged() == [0, 2]
    tell(receipt(1, 2, False), receipt(4, 1, True))
    assert run()[1, 3] == "handed_over" and logged() == [0, 2, 4]
    # the next day another product is due; what failed is not due any more
    assert run(DAY + datetime.timedelta(days=1)) == {(9, 1): "handed_over"} and logged() == [0, 2, 4]
    at = {r.product_id: r.sent_at for r in sinks.stored(spark, delivery.LOG, log).collect()}
    assert at[2] == datetime.datetime(2026, 1, 1, 9, 5)


def store_of(spark, folder):
    store = snapshots.Store(spark, folder, {"t": ["id"], "other": ["id"]}, parts=8)
    store.commit({"t": spark.createDataFrame([(i, i, "old") for i in range(100)], ROW), "other": spark.createDataFrame([], ROW)})
    return store


def test_versions(spark, tmp_path):
    store = store_of(spark, f"{tmp_path}/s")
    assert store.read("other").count() == 0 and store.version() == 1
    changed = spark.createDataFrame([(3, 3, "new"), (200, 1, "new")], ROW)
    parts = store.touched("t", changed)
    before = store._manifest(1)[0]["t"]
    rest = store.read("t", parts=parts).join(changed.select("id"), "id", "left_anti")
    assert store.commit({"t": (rest.unionByName(changed), parts)}) == 2
    after = store._manifest(2)[0]["t"]
    assert {p for p in before if before[p] != after[p]} == set(parts) and len(parts) <= 2
    assert store.read("t", 1).where("note = 'new'").count() == 0 and store.read("t", 1).count() == 100
    assert rows(store.read("t").where("note = 'new'").select("id")) == [(200,), (3,)] and store.read("t").count() == 101


def test_a_run_that_stops_changes_nothing(spark, tmp_path):
    store = store_of(spark, f"{tmp_path}/s")
    fails = store.read("t").withColumn("note", F.when(F.col("id") == 50, F.raise_error(F.lit("stop"))).otherwise("new"))
    with pytest.raises(Exception, match="stop"):
        store.commit({"t": fails})
    assert store.version() == 1 and store.read("t").where("note = 'old'").count() == 100
    with pytest.raises(ValueError):
        store.commit({"t": (spark.createDataFrame([(i, 0, "x") for i in range(50)], ROW), [0])})
    assert store.commit({"t": store.read("t").withColumn("note", F.lit("new"))}) == 2
    with pytest.raises(snapshots.Conflict):
        store.commit({"t": store.read("t", 1)}, base=1)
    assert store.read("t").where("note = 'new'").count() == 100 and store.read("t").count() == 100


def test_deletes_from_a_store(spark, tmp_path):
    store = store_changes.open_store(spark, f"{tmp_path}/s", parts=4)
    store.commit({"users": spark.createDataFrame([(u,) for u in range(4)], "user_id long"),
                  "products": spark.createDataFrame([(p, p % 4) for p in range(40)], "product_id long, user_id long"),
                  "reminder_logs": spark.createDataFrame([(p, "7_day") for p in range(40)], "product_id long, reminder_type string")})
    one = store_changes.delete(store, spark.createDataFrame([(5,), (777,)], "product_id int"))
    assert one == 2 and store.read("products").count() == 39 and store.read("reminder_logs").count() == 39 and store.read("users").count() == 4
    store_changes.delete(store, user_ids=spark.createDataFrame([(2,)], "user_id long"))
    assert store.read("products").count() == 29 and store.read("reminder_logs").where("product_id % 4 = 2").isEmpty() and store.read("users").count() == 3
    assert store_changes.delete(store, user_ids=spark.createDataFrame([], "user_id long")) == 3


def test_rejected_entries(spark, tmp_path):
    typed = [("date", "2025-02-30"), ("date", "2025-02-28"), ("date", None), ("date", " "), ("date", "soon"), ("date", "TODAY"), ("date", "31/12/2024"),
             ("months", "12"), ("months", "-1"), ("months", "1.5"), ("months", None), ("months", "9" * 30), ("months", " 7 "), ("price", "5"), (None, "5")]
    given = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(typed)], "entry_id long, field string, typed string")
    accepted, rejected = entries.write_split(given, DAY, f"{tmp_path}/e")
    assert sorted(r.entry_id for r in accepted.collect()) == [1, 5, 6, 7, 12]
    reasons = {r.entry_id: r.reason for r in rejected.collect()}
    assert reasons == {0: "no such day", 2: "blank", 3: "blank", 4: "unknown form", 8: "negative", 9: "no whole number", 10: "blank", 11: "too large",
                       13: "unknown field", 14: "unknown field"}
    assert rejected.where("field in ('date', 'months') and reply is null").isEmpty()


def test_users_who_leave_a_session_leave_no_state(spark):
    """Hundred users send a photo and nothing more; when time has passed the limit, no state is left."""
    start = datetime.datetime(2026, 1, 1)
    kinds = spark.createDataFrame([], f"user_id long, ts timestamp, event_id long, kind string, field string, value string, bill {sessions.PHOTO_SCHEMA}")
    folder, out = work_dir(spark, "in"), work_dir(spark, "out")

    def write(users, minutes, kind, first_id):
        data = [(u, start + datetime.timedelta(minutes=minutes), first_id + u, kind, None, None, None) for u in users]
        spark.createDataFrame(data, kinds.schema).coalesce(1).write.mode("append").parquet(folder)

    write(range(100), 0, "photo", 0)
    write([5], 20, "confirm", 1000)  # within the limit
    write([6], 50, "confirm", 2000)  # too late
    for minutes in (200, 400, 600):
        write([-1], minutes, "edit", 5000 + minutes)
    stream = tables.read_messages_stream(spark, folder, kinds.schema, max_files=1)
    with rocksdb_state(spark):
        query = (stream_registrations(stream, "1 minute", idle_seconds=1800).writeStream.format("parquet").outputMode("append").option("path", out)
                 .option("checkpointLocation", work_dir(spark, "cp")).trigger(availableNow=True).start())
        query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) >= 100 and kept[-1] <= 8, kept  # what waits of the last event
    assert rows(spark.read.parquet(out).select("user_id", "confirmed_id")) == [(5, 1005)]
    done = sessions.confirmed_registrations(spark.read.schema(kinds.schema).parquet(folder), 1800)
    assert rows(done.select("user_id", "confirmed_id")) == [(5, 1005)]


def test_rejected_files_give_no_reference(spark):
    """A photo and a document of the same size over the limit, an accepted document, an unknown file, an event without a bill."""
    files = tables.classify_files(spark.createDataFrame([("a", "/in/a.jpg", 20 << 20, True), ("b", "/in/b.pdf", 20 << 20, False), ("c", "/in/c.pdf", 9, False)],
                                                        "file_id string, path string, length long, is_photo boolean"))
    bill = ("TV", None, None, None, None, None, None, None, "stale", "stale", "stale")
    given = spark.createDataFrame([(i, f, None if f is None else bill) for i, f in enumerate(["a", "b", "c", "x", None])],
                                  f"event_id long, file_id string, bill {sessions.PHOTO_SCHEMA}")
    got = {r.event_id: r.bill and tuple(r.bill[n] for n in sessions.FILE_FIELDS) for r in sessions.with_files(given, files).collect()}
    assert got == {0: ("a", "photo", "/in/a.jpg"), 1: (None,) * 3, 2: ("c", "document", "/in/c.pdf"), 3: (None,) * 3, 4: None}


def test_first_seen_in_state_is_forgotten(spark):
    from coverlens.streaming.first_seen import stream_first_seen
    from tests.test_streams import finish, newest_first
    start = datetime.datetime(2026, 1, 1)
    data = [(u, start + datetime.timedelta(hours=h), 100 * h + u) for u, hours in ((1, (5, 0, 9)), (2, (3, 30)), (3, (40,))) for h in hours]
    got = finish(spark, stream_first_seen(newest_first(spark, spark.createDataFrame(data, "user_id long, ts timestamp, event_id long")), 10 * 3600, "40 days"))
    assert rows(got.where("user_id >= 0").select("user_id", "event_id")) == sorted([(1, 1), (2, 302), (2, 3002), (3, 4003)], key=str)


def test_idle_sessions_out_of_order(spark, sf):
    from tests.test_streams import finish, newest_first
    events = X.v_session_events(spark, sf)
    got = finish(spark, stream_registrations(newest_first(spark, events), "40 days", X.IDLE_SECONDS))
    want = sessions.confirmed_registrations(events, X.IDLE_SECONDS)
    assert rows(got.select(want.columns)) == rows(want) and 0 < got.count() < sessions.confirmed_registrations(events).count()


def test_deletes_do_not_derive_the_products_again(spark, sf, monkeypatch):
    """The keys to delete come from the products as written once, not from the joins behind them."""
    from checks import registry
    read = []
    delete = registry.store_changes.delete
    monkeypatch.setattr(registry.store_changes, "delete", lambda store, p, u: read.append(p.inputFiles()) or delete(store, p, u))
    assert registry.QUERIES["C9_store_delete"](spark, sf).count() > 0
    assert len(read) == 2 and all(read) and not any("lineitem" in f for files in read for f in files)
