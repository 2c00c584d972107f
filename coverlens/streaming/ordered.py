"""Keyed state that sees events in event-time order, however they arrive.

Events wait in state until the watermark has passed them and are then folded in
(time, id) order. State per key is what still waits plus the fold's own state.

An event behind the watermark comes too late to be folded in order. It is not dropped: it leaves at once as a row with
`late` set and nothing but its key, id and time, so that rows on time and late rows are all events.
"""
import bisect
import contextlib
import itertools
import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _setting(spark, key, value):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def rocksdb_state(spark):
    """Runs the streams started inside on the RocksDB state store."""
    return _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def only_with_data(spark):
    """Streams started inside run no batch without data: one with processing-time timers would else not end when all is read."""
    return _setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false")


def _in_order(row):
    return row[:2]


class OrderedFold(StatefulProcessor):
    """Subclasses give ``state_schema``, ``columns`` and ``fold(state, rows)``.

    ``fold`` gets the state tuple (or None) and rows (us, event_id, payload) in
    order and returns the new state (None to clear it) and output rows. It may be
    called several times for the rows of one batch, each time with a part of them.

    ``forget_at`` gives the time in microseconds after which a state is of no use any more (None: it stays). A timer then
    clears it, whether the key has further events or not.

    Each call of state or timers is a message to the JVM, so events wait in pages: the events of a key that arrive together
    are sorted and cut into pages of ``page_rows``, and a page has one value and one timer, at its first event. What fires
    folds all that is due by the watermark. Pages are read in the order of their first events, and of each as much is folded
    as comes before the next one, so that only pages that overlap are held at once.
    """
    state_schema: str
    columns: list
    id_column = "event_id"  # where a late event's id goes
    with_late = False
    slot_ms = 1000  # events become due by slots of this length
    page_rows = 1000

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, event_id long, n long", "rows string")
        self.state = handle.getValueState("state", self.state_schema)

    def forget_at(self, state):
        return None

    def slot_end(self, us):
        return (us // 1000 // self.slot_ms + 1) * self.slot_ms

    def put_aside(self, rows):
        """Lets rows, which are in order, wait. Pages that begin with the same event are told apart by a number."""
        for i in range(0, len(rows), self.page_rows):
            us, event_id, _ = rows[i]
            n = 0
            while self.waiting.containsKey((us, event_id, n)):
                n += 1
            self.waiting.updateValue((us, event_id, n), (json.dumps(rows[i:i + self.page_rows]),))
            self.handle.registerTimer(self.slot_end(us))

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            arrived, late = [], []
            for us, event_id, payload in zip(pdf["us"], pdf["event_id"], pdf["payload"]):
                us, event_id = int(us), int(event_id)
                if self.slot_end(us) <= passed:  # its slot has been folded
                    late.append((event_id, us))
                else:
                    arrived.append([us, event_id, payload])
            self.put_aside(sorted(arrived, key=_in_order))
            if late and self.with_late:
                known = [{"user_id": key[0], self.id_column: event_id, "us": us, "late": True} for event_id, us in late]
                columns = [*self.columns, "late"]
                yield pd.DataFrame({c: pd.Series([row.get(c) for row in known], dtype=object) for c in columns})

    def due(self, passed):
        """Takes what is due out of the waiting pages and gives it in order, part by part."""
        pages = sorted(p for p in self.waiting.keys() if self.slot_end(p[0]) <= passed)
        rest = []
        for page, following in itertools.zip_longest(pages, pages[1:]):
            rest = sorted(rest + json.loads(self.waiting.getValue(page)[0]), key=_in_order)
            self.waiting.removeKey(page)
            if following:
                n = bisect.bisect_left(rest, list(following[:2]), key=_in_order)
            else:
                n = bisect.bisect_right(rest, passed, key=lambda r: self.slot_end(r[0]))
            if n:
                yield rest[:n]
            rest = rest[n:]
        self.put_aside(rest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        old = self.state.get() if self.state.exists() else None
        state = old
        for rows in self.due(passed):
            state, out = self.fold(state, rows)
            if out:
                found = pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)
                if self.with_late:
                    found["late"] = False
                yield found
        end = None if state is None else self.forget_at(state)
        # The timer is set a slot later than the state's end: all events up to the end have then been folded.
        if end is not None and self.slot_end(end) + self.slot_ms <= passed:
            state = None
        elif end is not None and state != old:
            self.handle.registerTimer(self.slot_end(end) + self.slot_ms)
        if state is not None and state != old:
            self.state.update(state)
        elif state is None and old is not None:
            self.state.clear()

    def close(self):
        pass


def fold_in_order(events: DataFrame, payload, processor, schema: str, delay: str, with_late: bool = False) -> DataFrame:
    """Runs an OrderedFold per user over a stream of (user_id, ts, event_id, ...).

    ``with_late`` adds a column ``late`` and a row per event that came too late; else such events are dropped. The time goes
    in as a number, as Spark itself drops late rows where it sees the column of the watermark.
    """
    processor.with_late = with_late
    schema = f"{schema}, late boolean" if with_late else schema
    slim = (events.withWatermark("ts", delay)
            .select("user_id", F.unix_micros("ts").alias("us"), "event_id", payload.alias("payload")))
    return slim.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")
