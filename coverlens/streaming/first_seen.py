"""First sight of users in the state of a stream, with an expiry."""
from pyspark.sql import DataFrame, functions as F

from coverlens import fixed_values as V
from coverlens.streaming.ordered import OrderedFold, fold_in_order


class _FirstSeen(OrderedFold):
    state_schema = "last long"
    columns = ["user_id", "event_id", "us"]

    def __init__(self, expiry_seconds):
        self.expiry_us = int(expiry_seconds * 1_000_000)

    def forget_at(self, state):
        return state[0] + self.expiry_us

    def fold(self, state, rows):
        out, last = [], None if state is None else state[0]
        for us, event_id, _ in rows:
            if last is None or us - last > self.expiry_us:
                out.append((event_id, us))
            last = us
        return (last,), out


def stream_first_seen(seen: DataFrame, expiry_seconds: float, delay: str = "10 minutes", with_late: bool = False) -> DataFrame:
    """New users, earliest event first. State is one number per user seen within the expiry, after which a user counts as new again.

    The form of ``stream_users`` for streams whose users come back soon or never: it keeps and reads no table of all users.
    """
    out = fold_in_order(seen, F.lit(""), _FirstSeen(expiry_seconds), "user_id long, event_id long, us long", delay, with_late)
    return out.select("user_id", "event_id", F.lit("en").alias("language"), F.lit("free").alias("plan_tier"),
                      F.lit(V.DEFAULT_VAULT_LIMIT).alias("vault_limit"), F.timestamp_micros("us").alias("created_at"), *(["late"] if with_late else []))
