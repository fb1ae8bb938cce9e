from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from grapevine.operators import growth
from grapevine.operators.accuracy import mape
from grapevine.rules import Rules
from tests.frames import moment, rows_of

POINTS = "ClientId long, day date, uses long, x int, y double, u0 long"


def curve(client: int, k: float, u0: int, days: list[int]) -> list[tuple]:
    return [(client, None, None, x, float(u0 * x) if k == 1 else u0 * (k**x - 1) / (k - 1) + 0.0, u0) for x in days]


def test_candidates_lie_closest_around_one():
    ks = growth.candidates(0.01, 10.0)
    assert ks[0] == 0.01 and ks[-1] == 10.0 and ks == sorted(set(ks))
    assert [k for k in ks if 0.975 < k < 1.025] == [0.98, 0.99, 1.0, 1.01, 1.02]
    assert max(b - a for a, b in zip(ks, ks[1:], strict=False)) == pytest.approx(0.25)
    assert growth.candidates(0.5, 0.52) == [0.5, 0.52]


def test_k_is_found_again_on_exact_curves(spark):
    ks = [0.6, 0.9, 0.99, 1.0, 1.003, 1.05, 1.2, 3.0, 9.7]
    rows = [p for i, k in enumerate(ks) for p in curve(i, k, 3, [0, 1, 2, 4, 7, 11, 20])]
    found = growth.k_factor(spark.createDataFrame(rows, POINTS), Rules()).orderBy("ClientId").collect()
    assert [r.k_factor for r in found] == pytest.approx(ks, abs=1e-6)


def test_k_needs_five_days_and_stays_in_bounds(spark):
    rows = curve(1, 1.2, 2, [0, 1, 2, 3]) + curve(2, 1.2, 2, [0, 1, 2, 3, 4])
    rows += [(3, None, None, x, 10.0**9 * x, 1) for x in range(5)]  # steeper than any k in bounds
    rows += [(4, None, None, x, 1.0, 1000) for x in range(5)]
    found = growth.k_factor(spark.createDataFrame(rows, POINTS), Rules()).orderBy("ClientId").collect()
    assert found[0].k_factor is None
    assert [r.k_factor for r in found[1:]] == pytest.approx([1.2, 10.0, 0.01], abs=1e-6)


def test_k_is_the_least_squares_minimum_on_uneven_data(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], []
    grid = np.concatenate([np.linspace(0.01, 2, 200_001), np.linspace(2, 10, 80_001)])
    for client in range(25):
        x = np.sort(rng.choice(np.arange(1, rng.choice([10, 40, 300])), 7, replace=False))
        x = np.concatenate([[0], x]).astype(float)
        uses = rng.integers(1, 6, len(x))
        y = np.cumsum(uses).astype(float)
        rows += [(client, None, None, int(a), float(b), int(uses[0])) for a, b in zip(x, y, strict=True)]
        with np.errstate(all="ignore"):
            shape = np.where(grid[:, None] == 1, x, (grid[:, None] ** x - 1) / (grid[:, None] - 1))
            error = ((uses[0] * shape - y) ** 2).sum(axis=1)
        expected.append(grid[np.nanargmin(error)])
    found = growth.k_factor(spark.createDataFrame(rows, POINTS), Rules()).orderBy("ClientId").collect()
    assert [r.k_factor for r in found] == pytest.approx(expected, abs=2e-4)


def made_histories():
    rng = np.random.default_rng(3)
    days, histories = [], []
    for client in range(120):
        span = int(rng.choice([10, 30, 200, 1000]))
        x = np.append(0, np.sort(rng.choice(np.arange(1, span), min(span, 60) - 1, False))).astype(float)
        growing = rng.uniform(0.5, 3) ** (x / x.max() * 4)
        y = np.cumsum(np.maximum(1, rng.lognormal(0, rng.uniform(0.1, 2.5), len(x)) * growing).astype(int)).astype(float)
        histories.append((x, y))
        days += [(client, None, None, int(a), float(b), int(y[0])) for a, b in zip(x, y, strict=True)]
    return days, histories


def errors(x, y, k):
    with np.errstate(over="ignore"):
        return ((y[0] * (k[:, None] ** x - 1) / (k[:, None] - 1) - y) ** 2).sum(1)


def test_the_fit_does_not_depend_on_the_first_intervals(spark, monkeypatch):
    frame = spark.createDataFrame(made_histories()[0], POINTS)
    found = {r.ClientId: r.k_factor for r in growth.k_factor(frame, Rules()).collect()}
    monkeypatch.setattr(growth, "SCAN", ((float("inf"), 2.5),))
    monkeypatch.setattr(growth, "FIRST", 1)
    monkeypatch.setattr(growth, "HALVINGS", 14)
    for r in growth.k_factor(frame, Rules()).collect():
        assert r.k_factor == pytest.approx(found[r.ClientId], abs=1e-6)


def test_no_error_in_an_interval_is_below_its_bound(spark):
    days, histories = made_histories()
    rng = np.random.default_rng(8)
    ends = {c: sorted(rng.choice([rng.uniform(0.01, 10, 2), rng.uniform(0.9, 1.1, 2)])) for c in range(len(histories))}
    frame = spark.createDataFrame([(*d, *map(float, ends[d[0]])) for d in days], POINTS + ", lo double, hi double")
    points = F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "y"))
    rows = frame.groupBy("ClientId", "lo", "hi").agg(points.alias("points"), F.first("u0").cast("double").alias("u0"))
    lo, hi = (growth._knot(F.col(c), F.col("u0")) for c in ("lo", "hi"))
    for r in rows.select("ClientId", growth._bound(F.col("points"), lo, hi).alias("bound")).collect():
        x, y = histories[r.ClientId]
        inside = errors(x, y, np.linspace(*ends[r.ClientId], 2001))
        assert r.bound <= inside.min() * (1 + 1e-9)


def test_the_scan_brackets_the_minimum_of_long_histories(spark):
    """Nowhere within the bounds does a dense grid have a smaller error than the k that is found."""
    grid = np.unique(np.concatenate([np.arange(0.01, 0.9, 0.002), np.arange(0.9, 1.1, 0.0005), np.arange(1.1, 10, 0.005)]))
    grid = grid[np.abs(grid - 1) > 1e-9]
    days, histories = made_histories()
    for r in growth.k_factor(spark.createDataFrame(days, POINTS), Rules()).collect():
        x, y = histories[r.ClientId]
        k = r.k_factor + (1e-7 if abs(r.k_factor - 1) < 1e-7 else 0)
        assert errors(x, y, np.array([k]))[0] <= errors(x, y, grid).min() * (1 + 1e-6) + 1e-6


def test_cumulative_uses_count_utc_days_from_the_first(spark):
    times = ["2021-01-03 23:59:59", "2021-01-01 00:00:00", "2021-01-01 08:00:00", None]
    uses = spark.createDataFrame([(1, moment(t)) for t in times], "c long, t timestamp_ntz")
    found = rows_of(growth.cumulative_uses(growth.daily_uses(uses, "c", "t")))
    assert found == [
        (1, dt.date(2021, 1, 1), 2, 0, 2, 2),
        (1, dt.date(2021, 1, 3), 1, 2, 3, 2),
    ]


FORECASTS = [("a", 10.0, 8.0), ("a", 0.0, 5.0), ("a", -4.0, -5.0), ("b", 4.0, 5.0), ("c", -4.0, -5.0), ("d", 0.0, 1.0)]


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({}, [("a", 22.5), ("b", 25.0), ("c", 25.0), ("d", None)]),
        ({"single_row_as_ratio": True}, [("a", 22.5), ("b", 0.25), ("c", -0.25), ("d", None)]),
        ({"remove_zero_targets": False}, [("a", (20 + 500 + 25) / 3), ("b", 25.0), ("c", 25.0), ("d", 100.0)]),
    ],
)
def test_mape(spark, options, expected):
    df = spark.createDataFrame(FORECASTS, "g string, t double, p double")
    found = mape(df, "t", "p", by=["g"], **options).orderBy("g").collect()
    assert [r.g for r in found] == [g for g, _ in expected]
    for row, (_, value) in zip(found, expected, strict=True):
        assert row.mape == (None if value is None else pytest.approx(value))


def test_mape_without_groups(spark):
    df = spark.createDataFrame(FORECASTS, "g string, t double, p double").where(F.col("g") == "a")
    assert mape(df, "t", "p").first().mape == pytest.approx(22.5)
