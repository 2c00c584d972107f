"""Request limiter on a stream, with the same decisions as the batch form."""
import collections
import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from coverlens import fixed_values as V
from coverlens.operators.limits import admit
from coverlens.streaming.ordered import OrderedFold, fold_in_order


class _Limiter(OrderedFold):
    state_schema = "kept string"
    columns = ["user_id", "event_id", "us", "accepted"]

    def __init__(self, max_requests, seconds):
        self.max_requests, self.width = max_requests, int(round(seconds * 1_000_000))

    def fold(self, state, rows):
        kept = collections.deque(json.loads(state[0]) if state else [])
        out = [(event_id, us, admit(kept, us, self.max_requests, self.width)) for us, event_id, _ in rows]
        return (json.dumps(list(kept)),), out


def stream_allow_requests(events: DataFrame, max_requests: int = V.LIMITER_MAX_REQUESTS,
                          seconds: float = V.LIMITER_WINDOW_SECONDS, delay: str = "10 minutes", with_late: bool = False) -> DataFrame:
    """Decisions in event-time order. Requests more than ``delay`` behind the newest get none: ``with_late`` gives them out with
    ``late`` set and without a decision, else they are dropped."""
    out = fold_in_order(events, F.lit(""), _Limiter(max_requests, seconds),
                        "user_id long, event_id long, us long, accepted boolean", delay, with_late)
    return out.select("user_id", "event_id", F.timestamp_micros("us").alias("ts"), "accepted", *(["late"] if with_late else []))


class _OnArrival(StatefulProcessor):
    """State: accepted times in the window, at most ``max_requests``. A timer clears them when the window has passed."""

    def __init__(self, max_requests, seconds, clock):
        self.max_requests, self.width, self.clock = max_requests, int(round(seconds * 1_000_000)), clock

    def init(self, handle):
        self.handle = handle
        self.kept = handle.getValueState("kept", "us array<long>")

    def now(self, timers):
        return int(self.clock()) if self.clock else timers.getCurrentProcessingTimeInMs() * 1000

    def wait(self, timers, us):
        """One timer, ``us`` from now on the clock of the stream."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + -(-us // 1000))

    def handleInputRows(self, key, rows, timerValues):
        now = self.now(timerValues)
        kept = collections.deque(self.kept.get()[0] if self.kept.exists() else [])
        seen = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        accepted = [admit(kept, now, self.max_requests, self.width) for _ in range(len(seen))]
        if kept:
            self.kept.update((list(kept),))
            self.wait(timerValues, kept[-1] + self.width - now)
        yield pd.DataFrame({"user_id": key[0], "event_id": seen["event_id"], "us": seen["us"], "arrived_us": now, "accepted": accepted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        left = self.kept.get()[0][-1] + self.width - self.now(timerValues) if self.kept.exists() else 0
        if left > 0:  # the given clock goes slower than that of the stream
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + -(-left // 1000))
        else:
            self.kept.clear()
        yield pd.DataFrame({c: pd.Series([], dtype=t) for c, t in
                            {"user_id": "int64", "event_id": "int64", "us": "int64", "arrived_us": "int64", "accepted": "bool"}.items()})

    def close(self):
        pass


def stream_allow_on_arrival(events: DataFrame, max_requests: int = V.LIMITER_MAX_REQUESTS,
                            seconds: float = V.LIMITER_WINDOW_SECONDS, clock=None) -> DataFrame:
    """Decisions at the time a request is seen, whatever time it carries; none waits for a watermark and none is late.

    The requests of a micro-batch arrive together, in the order of their (ts, event_id). ``clock`` gives the time in
    microseconds in place of the processing time. It is called in the workers and must not go back; a batch that is
    repeated after a failure is decided at the time it is repeated. NULL as a user is a user, a NULL time comes last.

    The order of one user's requests in one batch is their own; all of them go through one task, so a source that reads
    a long backlog should be told how much to take at once (``maxFilesPerTrigger``). A stream that is to end when all is
    read is started inside ``ordered.only_with_data``.
    """
    slim = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    out = slim.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_OnArrival(max_requests, seconds, clock),
        outputStructType="user_id long, event_id long, us long, arrived_us long, accepted boolean",
        outputMode="append", timeMode="ProcessingTime")
    return out.select("user_id", "event_id", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("arrived_us").alias("arrived_at"), "accepted")
