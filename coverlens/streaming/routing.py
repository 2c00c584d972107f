"""Message routes counted per tumbling window on a stream."""
from pyspark.sql import DataFrame, functions as F

from coverlens.operators.messages import route_messages


def stream_route_counts(messages: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Closed windows only; partial counts keep a frequent route off a single task."""
    return (route_messages(messages).withWatermark("ts", delay)
            .groupBy(F.window("ts", window).alias("w"), "route").agg(F.count("*").alias("messages"))
            .select(F.col("w.start").alias("window_start"), "route", "messages"))
