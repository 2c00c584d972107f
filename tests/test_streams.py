"""Streams against their batch forms, with files that arrive out of order."""
import datetime
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from checks import fixtures as X
from coverlens.operators import limits, sessions
from coverlens.session import work_dir
from coverlens.sources import sinks, tables
from coverlens.streaming.limiter import stream_allow_on_arrival, stream_allow_requests
from coverlens.streaming.ordered import OrderedFold, only_with_data, rocksdb_state
from coverlens.streaming.sessions import stream_registrations
from coverlens.streaming.tables import append_stream, stream_leads, stream_users


def newest_first(spark, df, parts=3):
    """One file per part of the time range, the newest first, and a last row that closes the stream."""
    folder = work_dir(spark, "in")
    lo, hi = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = (hi - lo) // parts + 1
    for i in reversed(range(parts)):
        part = F.floor((F.unix_micros("ts") - lo) / step)
        df.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    last = {"user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long"), "ts": F.lit("2100-01-01").cast("timestamp")}
    end = spark.range(1).select(*[last.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema])
    end.write.mode("append").parquet(folder)
    return tables.read_messages_stream(spark, folder, df.schema, max_files=1)


def finish(spark, out):
    folder = work_dir(spark, "out")
    with rocksdb_state(spark):
        append_stream(out, folder, work_dir(spark, "cp")).awaitTermination()
    return spark.read.schema(out.schema).parquet(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_limiter_out_of_order(spark, sf):
    events = X.events(spark, sf).select("user_id", "ts", "event_id")
    got = finish(spark, stream_allow_requests(newest_first(spark, events), 2, 6 * 3600, "40 days"))
    want = limits.allow_requests(events, 2, 6 * 3600)
    columns = ["user_id", "event_id", "ts", "accepted"]
    assert rows(got.select(columns)) == rows(want.select(columns))
    assert got.where("not accepted").count() > 0


def test_sessions_out_of_order(spark, sf):
    events = X.v_session_events(spark, sf)
    got = finish(spark, stream_registrations(newest_first(spark, events), "40 days"))
    want = sessions.confirmed_registrations(events)
    assert rows(got.select(want.columns)) == rows(want) and got.count() > 0


def test_late_events_are_given_out(spark, sf):
    """Files of the time range, the newest first, and a delay of an hour: what is on time and what is late are all events."""
    events = X.events(spark, sf).select("user_id", "ts", "event_id")
    got = finish(spark, stream_allow_requests(newest_first(spark, events), 2, 6 * 3600, "1 hour", with_late=True)).where("user_id >= 0")
    assert rows(got.select(events.columns)) == rows(events)
    late, on_time = got.where("late"), got.where("not late")
    assert 0 < late.count() < events.count() and late.where("accepted is not null").isEmpty() and on_time.where("accepted is null").isEmpty()
    want = limits.allow_requests(events.join(on_time.select("event_id"), "event_id", "left_semi"), 2, 6 * 3600)
    columns = ["user_id", "event_id", "ts", "accepted"]
    assert rows(on_time.select(columns)) == rows(want.select(columns))


def test_late_session_events_are_given_out(spark, sf):
    events = X.v_session_events(spark, sf)
    got = finish(spark, stream_registrations(newest_first(spark, events), "1 hour", with_late=True)).where("user_id >= 0")
    late = got.where("late")
    assert late.count() > 0 and late.where("product_name is not null or session_id is not null").isEmpty()
    on_time = events.join(late.select(F.col("confirmed_id").alias("event_id")), "event_id", "left_anti")
    want = sessions.confirmed_registrations(on_time)
    assert rows(got.where("not late").select(want.columns)) == rows(want) and on_time.count() + late.count() == events.count()


SESSION = f"user_id long, ts timestamp, event_id long, kind string, field string, value string, bill {sessions.PHOTO_SCHEMA}"
PHOTO = ("TV", "LG", "TV & Audio", "Croma", datetime.date(2025, 1, 1), 24, "SN1", 500.0, "f1", "photo", "/in/f1.jpg")


def events(spark, *steps, gap=60):
    start = datetime.datetime(2026, 1, 1)
    data = [(1, start + datetime.timedelta(seconds=gap * i), i, kind, field, value, PHOTO if kind == "photo" else None)
            for i, (kind, field, value) in enumerate(steps)]
    return spark.createDataFrame(data, SESSION)


def confirmed(spark, *steps):
    return [r.asDict() for r in sessions.confirmed_registrations(events(spark, *steps)).orderBy("confirmed_id").collect()]


def test_session_rules(spark):
    out = confirmed(
        spark, ("edit", "name", "lost"), ("confirm", None, None),           # no session yet
        ("photo", None, None), ("edit", "name", "Sony <x> TV"), ("edit", "date", "31-02-2024"),
        ("edit", "warranty", "36"), ("edit", "warranty", "soon"), ("skip", "serial", None), ("edit", "price", "n/a"),
        ("confirm", None, None), ("confirm", None, None),                     # the second has no session
        ("photo", None, None), ("cancel", None, None), ("confirm", None, None),
        ("add", None, None), ("edit", "platform", "Amazon"), ("edit", "date", "yesterday"), ("confirm", None, None))
    assert len(out) == 2
    first, second = out
    assert (first["product_name"], first["brand"], first["warranty_months"]) == ("Sony &lt;x&gt; TV", "Sony", 36)
    assert (first["serial_no"], first["price_paid"], first["purchase_date"]) == (None, 500.0, datetime.date(2025, 1, 1))
    assert (second["product_name"], second["purchase_platform"], second["purchase_date"]) == (
        None, "Amazon", datetime.date(2025, 12, 31))


def test_idle_sessions_are_forgotten(spark):
    df = events(spark, ("photo", None, None), ("confirm", None, None), ("photo", None, None), ("edit", "name", "A B"),
                ("confirm", None, None), gap=400)
    assert finish(spark, stream_registrations(newest_first(spark, df, 1), idle_seconds=300)).count() == 0
    assert finish(spark, stream_registrations(newest_first(spark, df, 1), idle_seconds=500)).count() == 2


def test_first_sight_is_kept_over_runs(spark, sf):
    seen = X.events(spark, sf).select("user_id", "ts", "event_id")
    folder, source = work_dir(spark, "users"), work_dir(spark, "in")
    cp = work_dir(spark, "cp")
    half = F.lit("2024-01-15").cast("timestamp")
    for part in (F.col("ts") < half, F.col("ts") >= half):
        seen.where(part).write.mode("append").parquet(source)
        stream_users(tables.read_messages_stream(spark, source, seen.schema), folder, cp).awaitTermination()
    got = spark.read.parquet(folder).select("user_id", "created_at")
    assert rows(got) == rows(seen.groupBy("user_id").agg(F.min("ts")))


def test_leads_stream_again_adds_nothing(spark, sf):
    source, folder = work_dir(spark, "in"), work_dir(spark, "leads")
    X.v_messages(spark, sf).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):  # a new checkpoint each time: everything is read again
        stream_leads(tables.read_messages_stream(spark, source, schema), X.LEAD_CODES, folder, work_dir(spark, "cp")).awaitTermination()
    out = spark.read.parquet(folder)
    assert out.count() == out.select("id").distinct().count() > 0


def test_reminders_resume_after_a_stop(spark, sf):
    """Outbox written, log not: the next run completes the log and sends nothing again."""
    from coverlens.plans.reminders import reminders_due
    products, none = X.v_products(spark, sf), spark.createDataFrame([], "product_id long, reminder_type string")
    outbox, log = work_dir(spark, "outbox"), work_dir(spark, "log")
    due = reminders_due(products, none, X.AS_OF)
    due.write.parquet(outbox)
    sinks.emit_reminders(due, outbox, log)
    assert spark.read.parquet(outbox).count() == spark.read.parquet(log).count() == due.count() > 0


def test_limiter_on_arrival(spark, tmp_path):
    """Requests in three files, seen one after another at times of a given clock; the times they carry run backwards."""
    clock = tmp_path / "clock"
    moments = [1_000_000, 40_000_000, 61_000_000]  # the third leaves the first's requests behind, by exactly one window
    base = datetime.datetime(2026, 1, 1)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "user_id long, ts timestamp, event_id long"
    path = str(clock)

    def read_clock():
        with open(path) as f:
            return int(f.read())

    want, kept = {}, {}
    for n, now in enumerate(moments):
        users = [0, 0, 1, 0, None] if n != 1 else [0, 1, 1, 1, None]
        batch = [(u, base - datetime.timedelta(hours=n, seconds=-i), 10 * n + i) for i, u in enumerate(users)]
        for user, _, event_id in batch:
            kept[user] = [t for t in kept.get(user, []) if t > now - 60_000_000]
            want[event_id] = (now, len(kept[user]) < 3)
            kept[user] += [now] if want[event_id][1] else []
        clock.write_text(str(now))
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = tables.read_messages_stream(spark, folder, spark.read.parquet(folder).schema)
        with rocksdb_state(spark), only_with_data(spark):
            append_stream(stream_allow_on_arrival(stream, 3, 60, read_clock), out, checkpoint).awaitTermination()
    got = {r.event_id: (r.us, r.accepted) for r in spark.read.parquet(out).select("event_id", F.unix_micros("arrived_at").alias("us"), "accepted").collect()}
    assert got == want and not all(a for _, a in want.values())


def test_limiter_on_arrival_forgets(spark, tmp_path):
    """State of users who do not come back is cleared when the window has passed on the clock of the stream."""
    base = datetime.datetime(2026, 1, 1)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    left = []
    for users in ([1, 2, 3], [9], [9]):
        time.sleep(0.5)
        spark.createDataFrame([(u, base, u) for u in users], "user_id long, ts timestamp, event_id long").write.mode("append").parquet(folder)
        stream = tables.read_messages_stream(spark, folder, spark.read.parquet(folder).schema)
        with rocksdb_state(spark), only_with_data(spark):
            query = append_stream(stream_allow_on_arrival(stream, 3, 0.1), out, checkpoint)
            query.awaitTermination()
        left.append(sum(o["numRowsTotal"] for p in query.recentProgress[-1:] for o in p["stateOperators"]))
    assert spark.read.parquet(out).where("accepted").count() == 5
    assert left[-1] < left[0]


class _Counted:
    """State and timers of one key in memory; counts the calls, each of which is a message to the JVM in a stream."""

    def __init__(self):
        self.map, self.value, self.timers, self.calls = {}, None, set(), 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        counted = self

        class Value:
            def exists(self):
                counted.calls += 1
                return counted.value is not None

            def get(self):
                counted.calls += 1
                return counted.value

            def update(self, value):
                counted.calls += 1
                counted.value = value

            def clear(self):
                counted.calls += 1
                counted.value = None
        return Value()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]

    def keys(self):
        self.calls += 1
        return iter(list(self.map))


class _Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


class _Seen(OrderedFold):
    state_schema, columns = "n long, us long, event_id long", ["user_id", "us", "event_id", "payload"]

    def fold(self, state, rows):
        return (len(rows) + (state[0] if state else 0), *rows[-1][:2]), [tuple(r) for r in rows]


def _folded(page_rows, batches):
    """Rows given out for batches of (watermark, rows), and the calls of state and timers."""
    handle, fold = _Counted(), _Seen()
    fold.page_rows = page_rows
    fold.init(handle)
    out, passed = [], 0
    for watermark, rows in batches:
        parts = [pd.DataFrame(rows[i:i + 40], columns=["us", "event_id", "payload"]) for i in range(0, len(rows), 40)]
        list(fold.handleInputRows((7,), iter(parts), _Times(passed)))
        passed = watermark
        for ms in sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(ms)
            for found in fold.handleExpiredTimer((7,), _Times(watermark), _Times(ms)):
                out += [tuple(r)[1:] for r in found.itertuples(index=False)]
    return out, handle


def test_waiting_events_cost_few_calls():
    """State is read and written by pages of events; a value and a timer for each event took a million events over an hour."""
    rnd = random.Random(1)
    rows = [(rnd.randrange(10 ** 12), i, "") for i in range(5000)]
    out, handle = _folded(1000, [(2 * 10 ** 9, rows)])
    assert out == sorted(rows) and handle.value[0] == 5000 and not handle.map
    assert handle.calls < len(rows) / 4


def test_pages_are_folded_in_order():
    """Pages that overlap, split at a watermark, and begin with the same event; nothing is lost or given out twice."""
    rnd = random.Random(2)
    batches, given = [], []
    for n in range(6):
        rows = [(n * 10 ** 7 + rnd.randrange(3 * 10 ** 7), rnd.randrange(50), "") for _ in range(200)] + [((n + 2) * 10 ** 7, 1, "")] * 3
        batches.append((n * 10 ** 4, rows))
        given += rows
    out, handle = _folded(7, [*batches, (10 ** 9, [])])
    assert out == sorted(given) and not handle.map and not handle.timers
