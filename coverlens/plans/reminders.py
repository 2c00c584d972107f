"""Daily reminders: due on a day, not sent yet, rendered, handed over, logged."""
import datetime

from pyspark.sql import DataFrame

from coverlens.operators.lifecycle import due_reminders, milestones_between, render_reminder, unsent
from coverlens.sources.sinks import emit_reminders

OUTBOX_COLUMNS = ["product_id", "user_id", "reminder_type", "as_of", "days_left", "is_urgent", "message"]


def reminders_due(products: DataFrame, log: DataFrame, as_of: datetime.date) -> DataFrame:
    return render_reminder(due_reminders(products, log, as_of)).select(*OUTBOX_COLUMNS)


def reminders_backfill(products: DataFrame, log: DataFrame, first: datetime.date, last: datetime.date) -> DataFrame:
    """What a run on every day of the range would have sent, in one pass."""
    return render_reminder(unsent(milestones_between(products, first, last), log)).select(*OUTBOX_COLUMNS)


def run_daily(products: DataFrame, log: DataFrame, as_of: datetime.date, outbox_dir: str, log_dir: str) -> None:
    """One day's job; running it again for the same day sends nothing twice."""
    emit_reminders(reminders_due(products, log, as_of), outbox_dir, log_dir)
