"""Shop calendar: local time, week and day codes, delivery dates, week starts.

Timestamps are naive UTC (``timestamp_ntz``), so nothing here depends on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# weekday() numbers
TUESDAY, THURSDAY, FRIDAY, SATURDAY = 1, 3, 4, 5


def local_time(ts: Column, lag_hours: int = 6) -> Column:
    """Shop time: a fixed shift, no daylight saving."""
    return ts - F.make_dt_interval(hours=F.lit(lag_hours))


def week_code(ts: Column) -> Column:
    """Two digits of the calendar year followed by two of the ISO week.

    The two do not belong together around New Year: 1 January 2021 gives ``2153``.
    """
    day = F.to_date(ts)
    year = (F.year(day) % 100).cast("string")
    return F.concat(F.lpad(year, 2, "0"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def year_day(ts: Column) -> Column:
    """Two-digit year and day of year as one number; wraps at the century."""
    day = F.to_date(ts)
    return (F.year(day) % 100) * 1000 + F.dayofyear(day)


def customer_novelty(born_utc: Column, ordered_utc: Column, lag_hours: int = 6) -> Column:
    """``OLD`` if the customer was created on an earlier day than the order, else new.

    The creation day is taken in UTC and the order day in shop time; an unknown day counts
    as new.
    """
    earlier = year_day(born_utc) < year_day(local_time(ordered_utc, lag_hours))
    return F.when(earlier, "OLD").otherwise("NEW CUSTOMER")


def delivery_date(ts: Column, lag_hours: int = 6, cutoff_hour: int = 21) -> Column:
    """Next day for orders up to the cutoff, the day after for later ones, never a Sunday."""
    placed = local_time(ts, lag_hours)
    day = F.to_date(placed)
    cutoff = day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(cutoff_hour))
    early = placed <= cutoff
    days = (
        F.when(early & (F.weekday(day) == SATURDAY), 2)
        .when(early, 1)
        .when(F.weekday(day) == FRIDAY, 3)
        .otherwise(2)
    )
    return F.date_add(day, days)


def week_start(day: Column, strict: bool = False) -> Column:
    """First day of the order week.

    Weeks are numbered from the first Monday of the year but read back as ISO weeks, so in
    years whose 1 January is a Tuesday, Wednesday or Thursday the result lies one week before
    the true Monday. ``strict`` gives the true Monday always.
    """
    monday = F.date_sub(day, F.weekday(day))
    if strict:
        return monday
    new_year = F.weekday(F.make_date(F.year(monday), F.lit(1), F.lit(1)))
    return F.when(new_year.between(TUESDAY, THURSDAY), F.date_sub(monday, 7)).otherwise(monday)
