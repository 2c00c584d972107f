"""Date rules. Nothing here reads the clock: the day of reference is an argument."""
import datetime
import functools
import operator

from pyspark.sql import Column, functions as F

from coverlens import fixed_values as V
from coverlens.functions.text import as_col, strip


def day(d) -> Column:
    """A date literal from a date, an ISO string or a column."""
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = datetime.date.fromisoformat(d)
    return F.lit(d)


def expiry_date(purchase_date, months) -> Column:
    """Months of 30.4375 days, cut to whole days; not calendar months."""
    days = (as_col(months) * F.lit(V.DAYS_PER_MONTH)).cast("int")
    return F.date_add(as_col(purchase_date), days)


def days_left(expiry, as_of) -> Column:
    return F.datediff(as_col(expiry), day(as_of))


def format_day(c) -> Column:
    return F.date_format(as_col(c), "dd MMM yyyy")


def strict_iso_date(c) -> Column:
    """First ten characters as year-month-day, NULL when that is no real date."""
    head = F.substring(as_col(c), 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(head, "yyyy-M-d"))


_SHAPES = {"yyyy-M-d": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "d-M-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
           "d/M/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d.M.yyyy": r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"}


def shaped_like_date(c, formats=None) -> Column:
    """Whether a text has one of the forms of parse_human_date, real day or not."""
    text = F.lower(strip(c))
    shapes = [text.rlike(_SHAPES[f]) for f in (formats or V.EDIT_DATE_FORMATS)]
    return F.coalesce(functools.reduce(operator.or_, shapes, text.isin(*V.TODAY_WORDS, *V.YESTERDAY_WORDS)), F.lit(False))


def parse_human_date(c, as_of, formats=None) -> Column:
    """today / now / yesterday or one of the formats; NULL for anything else."""
    text = F.lower(strip(c))
    parsed = [F.when(text.rlike(_SHAPES[f]), F.try_to_date(text, f)) for f in (formats or V.EDIT_DATE_FORMATS)]
    return F.coalesce(F.when(text.isin(V.TODAY_WORDS), day(as_of)),
                      F.when(text.isin(V.YESTERDAY_WORDS), F.date_sub(day(as_of), 1)),
                      *parsed)
