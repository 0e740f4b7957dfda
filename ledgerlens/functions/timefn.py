"""Time helpers.

All stored timestamps are UTC wall-clock values without zone
(``timestamp_ntz``). Reports use the fixed ``PST`` offset of the source
queries: in PostgreSQL ``AT TIME ZONE 'PST'`` is the abbreviation UTC-08:00 with
no daylight saving, whereas Spark and DuckDB resolve ``'PST'`` to
America/Los_Angeles. So the shift is written as plain interval arithmetic and no
zone name is ever passed to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.util import as_col

# Fixed value: hours between UTC and the PostgreSQL 'PST' abbreviation.
PST_OFFSET_HOURS = 8


def _offset():
    return F.make_dt_interval(hours=F.lit(PST_OFFSET_HOURS))


def as_of_lit(as_of: str) -> Column:
    """The reporting instant (UTC, no zone) that replaces ``NOW()``."""
    return F.lit(as_of).cast("timestamp_ntz")


def to_pst(ts) -> Column:
    """``ts AT TIME ZONE 'PST'`` for a UTC timestamp."""
    return as_col(ts).cast("timestamp_ntz") - _offset()


def date_to_pst(ts) -> Column:
    """``DATE(ts) AT TIME ZONE 'PST'``: midnight UTC of the date, shifted."""
    return F.to_date(as_col(ts)).cast("timestamp_ntz") - _offset()


def month_start(ts) -> Column:
    """``DATE_TRUNC('month', ts)`` kept as ``timestamp_ntz``.

    Truncating through a date keeps the session zone out of the result.
    """
    return F.trunc(F.to_date(as_col(ts)), "month").cast("timestamp_ntz")


def _day_time_key(ts: Column) -> Column:
    # Position inside the month, to compare (day, time-of-day) lexically.
    return (F.dayofmonth(ts) * F.lit(86400) + F.hour(ts) * F.lit(3600)
            + F.minute(ts) * F.lit(60) + F.date_part(F.lit("SECOND"), ts))


def age_parts(later, earlier) -> tuple[Column, Column]:
    """Years and months of PostgreSQL ``AGE(later, earlier)``.

    For ``later >= earlier``: whole months between the two, minus one when the
    (day, time) of ``later`` is before that of ``earlier``; years are the whole
    twelves, months the rest. For ``later < earlier`` both parts are the
    negated parts of the swapped call. Unlike ``months_between`` this calls
    2021-01-31 -> 2021-02-28 zero months (28 days), as PostgreSQL does.
    """
    a = as_col(later).cast("timestamp_ntz")
    b = as_col(earlier).cast("timestamp_ntz")
    forward = a >= b
    hi = F.when(forward, a).otherwise(b)
    lo = F.when(forward, b).otherwise(a)
    borrow = F.when(_day_time_key(hi) < _day_time_key(lo), F.lit(1)).otherwise(F.lit(0))
    total = ((F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo) - borrow)
    sign = F.when(forward, F.lit(1)).otherwise(F.lit(-1))
    years = sign * F.floor(total / 12).cast("int")
    months = sign * (total % 12)
    return years.cast("int"), months.cast("int")


def age_intervals(later, earlier) -> tuple[Column, Column]:
    """PostgreSQL ``AGE(later, earlier)`` as two interval columns that can be
    stored: years and months (``INTERVAL YEAR TO MONTH``), and days and time of
    day (``INTERVAL DAY TO SECOND``). NULL where either side is.

    The day part counts from the earlier instant's day; where it would be
    negative, a month is taken and its days are those of the earlier instant's
    month, as PostgreSQL does. An ``earlier`` after ``later`` negates both.
    """
    a = as_col(later).cast("timestamp_ntz")
    b = as_col(earlier).cast("timestamp_ntz")
    hi, lo = F.greatest(a, b), F.least(a, b)

    def micros(ts: Column) -> Column:
        seconds = F.hour(ts) * F.lit(3600) + F.minute(ts) * F.lit(60)
        return seconds.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")

    time = micros(hi) - micros(lo)
    early = time < 0
    time = F.when(early, time + 86_400_000_000).otherwise(time)
    days = F.dayofmonth(hi) - F.dayofmonth(lo) - F.when(early, 1).otherwise(0)
    borrow = days < 0
    days = F.when(borrow, days + F.dayofmonth(F.last_day(lo.cast("date")))).otherwise(days)
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo) - F.when(borrow, 1).otherwise(0)
    sign = F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(a >= b, 1).otherwise(-1)
    span = F.make_dt_interval(days=sign * days, secs=(sign * time).cast("decimal(18, 0)") / F.lit(1_000_000).cast("decimal(18, 0)"))
    return F.make_ym_interval(months=sign * months), span


def age_months(later, earlier) -> Column:
    """``EXTRACT(year FROM AGE(..)) * 12 + EXTRACT(month FROM AGE(..))``."""
    years, months = age_parts(later, earlier)
    return years * 12 + months
