from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grapevine.functions import calendar
from tests.frames import moment


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} timestamp_ntz" for n in names))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("utc", "code"),
    [("2021-01-01 12:00:00", "2153"), ("1999-12-31 12:00:00", "9952"), ("2000-01-03 12:00:00", "0001")],
)
def test_week_code_mixes_calendar_year_and_iso_week(spark, utc, code):
    assert one(spark, calendar.week_code(F.col("t")), t=moment(utc)) == code


def test_local_time_is_six_hours_back(spark):
    assert one(spark, calendar.local_time(F.col("t")), t=moment("2021-01-01 05:59:59")) == moment(
        "2020-12-31 23:59:59"
    )


@pytest.mark.parametrize(
    ("local", "delivered"),
    [
        ("2021-03-05 20:59:59", "2021-03-06"),  # Friday
        ("2021-03-05 21:00:00", "2021-03-06"),
        ("2021-03-05 21:00:01", "2021-03-08"),
        ("2021-03-06 20:59:59", "2021-03-08"),  # Saturday
        ("2021-03-06 21:00:00", "2021-03-08"),
        ("2021-03-06 21:00:01", "2021-03-08"),
        ("2021-03-07 12:00:00", "2021-03-08"),  # Sunday
        ("2021-03-03 21:00:00.000001", "2021-03-05"),  # Wednesday
    ],
)
def test_delivery_date_around_the_cutoff(spark, local, delivered):
    utc = moment(local) + dt.timedelta(hours=6)
    assert one(spark, calendar.delivery_date(F.col("t")), t=utc) == dt.date.fromisoformat(delivered)


def first_monday_week(day: dt.date) -> dt.date:
    """Number the week from the year's first Monday, then read the number as an ISO week."""
    monday = day - dt.timedelta(days=day.weekday())
    number = (monday.timetuple().tm_yday - 1) // 7 + 1
    return dt.date.fromisocalendar(monday.year, 1, 1) + dt.timedelta(weeks=number - 1)


def test_week_start_follows_the_two_step_rule_on_every_day(spark):
    first, last = dt.date(1990, 1, 1), dt.date(2039, 12, 31)
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS d")
    rows = days.select(
        "d", calendar.week_start(F.col("d")).alias("w"), calendar.week_start(F.col("d"), strict=True).alias("m")
    ).collect()
    assert len(rows) == (last - first).days + 1
    assert all(r.w == first_monday_week(r.d) for r in rows)
    assert all(r.m == r.d - dt.timedelta(days=r.d.weekday()) for r in rows)


@pytest.mark.parametrize(
    ("born", "ordered", "novelty"),
    [
        ("2021-03-04 00:00:00", "2021-03-05 12:00:00", "OLD"),
        ("2021-03-05 00:00:00", "2021-03-05 12:00:00", "NEW CUSTOMER"),
        ("2021-03-05 02:00:00", "2021-03-06 03:00:00", "NEW CUSTOMER"),  # still the 5th in shop time
        ("1999-12-30 00:00:00", "2000-01-05 12:00:00", "NEW CUSTOMER"),  # two-digit years wrap
        (None, "2021-03-05 12:00:00", "NEW CUSTOMER"),
    ],
)
def test_customer_novelty(spark, born, ordered, novelty):
    assert (
        one(spark, calendar.customer_novelty(F.col("b"), F.col("o")), b=moment(born), o=moment(ordered)) == novelty
    )


def test_session_zone_does_not_matter(spark):
    utc = moment("2021-03-14 08:30:00")  # 02:30 local, a gap in New York
    columns = [
        calendar.delivery_date(F.col("t")),
        calendar.week_code(calendar.local_time(F.col("t"))),
        calendar.year_day(calendar.local_time(F.col("t"))),
    ]
    before = [one(spark, c, t=utc) for c in columns]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [one(spark, c, t=utc) for c in columns] == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
