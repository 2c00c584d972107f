"""Registration sessions on a stream: state per user, one row out per confirmation."""
import json

from pyspark.sql import DataFrame, functions as F

from coverlens.operators.sessions import ENDS, FIELDS, STARTS, field_writes
from coverlens.streaming.ordered import OrderedFold, fold_in_order


class _Sessions(OrderedFold):
    state_schema = "session string, touched long"
    columns = ["user_id", "confirmed_id", "us", "record"]
    id_column = "confirmed_id"

    def __init__(self, idle_seconds=None):
        self.idle_us = None if idle_seconds is None else int(idle_seconds * 1_000_000)

    def forget_at(self, state):
        return None if self.idle_us is None else state[1] + self.idle_us

    def fold(self, state, rows):
        session, touched, out = (json.loads(state[0]), state[1], []) if state else (None, None, [])
        for us, event_id, payload in rows:
            event = json.loads(payload)
            if self.idle_us is not None and session is not None and us - touched > self.idle_us:
                session = None
            if event["kind"] in STARTS:
                session = {"session_id": event_id}
            if session is not None:
                touched = us
                session.update({f: event[f"w_{f}"].get("v") for f in FIELDS if f"w_{f}" in event})
                if event["kind"] == "confirm":
                    out.append((event_id, us, json.dumps(session)))
                if event["kind"] in ENDS:
                    session = None
        return (None if session is None else (json.dumps(session), touched)), out


def stream_registrations(events: DataFrame, delay: str = "10 minutes", idle_seconds: float | None = None,
                         with_late: bool = False) -> DataFrame:
    """Confirmed registrations; a session without activity for ``idle_seconds`` is forgotten.

    An event-time timer clears it from the state, so that users who leave in the middle of a session leave nothing behind.
    ``with_late`` adds a row per event that came too late, with ``late`` set, its id as confirmed_id and its time, and no fields.
    """
    writes = field_writes(events)
    payload = F.to_json(F.struct("kind", *[f"w_{f}" for f in FIELDS]))
    out = fold_in_order(writes, payload, _Sessions(idle_seconds),
                        "user_id long, confirmed_id long, us long, record string", delay, with_late)
    record = F.from_json("record", ", ".join(["session_id long"] + [f"{n} {t}" for n, t in FIELDS.items()]))
    return (out.withColumn("r", record)
            .select("user_id", "r.session_id", "confirmed_id", F.timestamp_micros("us").alias("confirmed_at"),
                    *[f"r.{n}" for n in FIELDS], *(["late"] if with_late else [])))
