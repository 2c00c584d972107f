"""Streams into tables: new users, due reminders, leads, and a plain append."""
import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from coverlens.operators.lifecycle import milestones, render_reminder
from coverlens.operators.messages import parse_action, to_leads
from coverlens.operators.users import upsert_users
from coverlens.plans.reminders import OUTBOX_COLUMNS
from coverlens.sources.sinks import _append_new, append_leads, emit_reminders, not_logged


def _each_batch(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(lambda df, _: write(df)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_stream(stream: DataFrame, directory: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").outputMode("append").option("path", directory)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_users(seen: DataFrame, directory: str, checkpoint: str) -> StreamingQuery:
    """One row per user ever seen, written at first sight; exact for all time, not only within a watermark."""
    def write(batch):
        nobody = batch.select("user_id").limit(0)
        _append_new(upsert_users(nobody, batch), directory, ["user_id"])
    return _each_batch(seen, write, checkpoint)


def stream_reminders(products: DataFrame, as_of: datetime.date, outbox_dir: str, log_dir: str,
                     checkpoint: str) -> StreamingQuery:
    """Reminders of newly arriving products for a day, but those the log holds; a batch that is retried sends nothing twice."""
    def write(batch):
        due = not_logged(milestones(batch, as_of), log_dir)
        emit_reminders(render_reminder(due).select(*OUTBOX_COLUMNS), outbox_dir, log_dir)
    return _each_batch(products, write, checkpoint)


def stream_leads(messages: DataFrame, codes: dict, directory: str, checkpoint: str) -> StreamingQuery:
    def write(batch):
        from pyspark.sql import functions as F
        leads = to_leads(parse_action(batch), codes).withColumn("id", F.col("event_id")).withColumn("created_at", F.col("ts"))
        append_leads(leads, directory)
    return _each_batch(messages, write, checkpoint)
