"""Growth factor: how fast the cumulative uses of a code multiply per day."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grapevine.rules import Rules

# The first intervals for k: up to this value in this step. Long histories have their k close to 1: uses grow as k^x, so a k
# over 2 over 60 days would be 10^18 uses. The steps decide how much work follows, not which k is found.
SCAN = ((0.9, 0.05), (1.1, 0.01), (2.0, 0.05), (math.inf, 0.25))
FIRST = 4  # as many of these steps are one interval
HALVINGS = 8  # of the intervals that may hold the minimum, before a section search in what is left of them
PRECISION = 1e-9
GOLDEN = (math.sqrt(5) - 1) / 2
SLACK = 1 + 1e-9  # for rounding in sums of squares


def candidates(low: float, high: float) -> list[float]:
    """Values from ``low`` to ``high`` in the steps of SCAN."""
    found = [low]
    while found[-1] < high:
        step = next(step for until, step in SCAN if found[-1] < until - 1e-9)
        found.append(min(high, round((math.floor(found[-1] / step + 1e-9) + 1) * step, 10)))
    return found


def daily_uses(uses: DataFrame, client: str, moment: str) -> DataFrame:
    """Uses per client and UTC calendar day; rows without a time are left out."""
    return (
        uses.where(F.col(moment).isNotNull())
        .groupBy(F.col(client).alias("ClientId"), F.to_date(moment).alias("day"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def cumulative_uses(days: DataFrame) -> DataFrame:
    """Per client and active day: days since the first, uses so far, uses on the first day.

    The window holds one row per client and calendar day, so its size is bounded by the
    calendar whatever the number of uses. The number of partitions is set here, because the
    fit that follows is heavy for the size of its data: adaptive merging, which goes by size,
    would leave it to few tasks.
    """
    partitions = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_day = W.partitionBy("ClientId").orderBy("day")
    so_far = by_day.rowsBetween(W.unboundedPreceding, W.currentRow)
    return days.repartition(partitions, "ClientId").select(
        "ClientId",
        "day",
        "uses",
        F.date_diff("day", F.first("day").over(so_far)).alias("x"),
        F.sum("uses").over(so_far).alias("y"),
        F.first("uses").over(so_far).alias("u0"),
    )


def _knot(k: Column, u0: Column) -> Column:
    """A value of k with what the curve u0 (k^x - 1) / (k - 1) needs of it; next to 1 where it is 1."""
    near = F.when(F.abs(k - 1) < 1e-12, F.lit(1 + 1e-12)).otherwise(k)
    return F.struct(k.alias("k"), (u0 / (near - 1)).alias("factor"), F.ln(near).alias("log"))


def _missed(knot: Column, point: Column) -> Column:
    return knot.factor * F.expm1(point.x * knot.log) - point.y


def _error(points: Column, knot: Column) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda total, p: total + F.pow(_missed(knot, p), 2))


def _bound(points: Column, lo: Column, hi: Column) -> Column:
    """No k from lo to hi has a smaller error: the curve rises with k at every x, so it stays between its ends."""

    def add(total: Column, p: Column) -> Column:
        return total + F.pow(F.greatest(_missed(lo, p), -_missed(hi, p), F.lit(0.0)), 2)

    return F.aggregate(points, F.lit(0.0), add)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _judged(points: Column, intervals: Column) -> Column:
    """Intervals with the bound on their error, and the error at their upper end where that is new."""

    def judge(i: Column) -> Column:
        errors = _bound(points, i.lo, i.hi).alias("bound"), F.when(i.new, _error(points, i.hi)).alias("error")
        return F.struct(i.lo.alias("lo"), i.hi.alias("hi"), *errors)

    return F.transform(intervals, judge)


def _promising(judged: Column, best: Column) -> Column:
    return F.filter(judged, lambda i: i.bound <= best * SLACK)


def _least_error(judged: Column, best: Column) -> Column:
    return F.least(best, F.array_min(F.transform(judged, lambda i: i.error)))


def _section(points: Column, u0: Column, span: Column, steps: int) -> Column:
    """Golden-section search for the least error in a span: error and k. Every step looks at one new k."""

    def at(k: Column) -> Column:
        return F.struct(k.alias("k"), _error(points, _knot(k, u0)).alias("error"))

    def inner(lo: Column, hi: Column, share: float) -> Column:
        return lo + share * (hi - lo)

    def state(lo: Column, hi: Column, left: Column, right: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), left.alias("left"), right.alias("right"))

    def narrow(s: Column, _step: Column) -> Column:
        to_left = state(s.lo, s.right.k, at(inner(s.lo, s.right.k, 1 - GOLDEN)), s.left)
        to_right = state(s.left.k, s.hi, s.right, at(inner(s.left.k, s.hi, GOLDEN)))
        narrowed = F.when(s.left.error <= s.right.error, to_left).otherwise(to_right)
        return F.when(s.hi - s.lo <= PRECISION, s).otherwise(narrowed)

    first = state(span.lo, span.hi, at(inner(span.lo, span.hi, 1 - GOLDEN)), at(inner(span.lo, span.hi, GOLDEN)))

    def middle(s: Column) -> Column:
        return _bind((s.lo + s.hi) / 2, lambda k: F.struct(at(k).error.alias("error"), k.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, narrow, middle)


def k_factor(cumulative: DataFrame, rules: Rules) -> DataFrame:
    """The k that fits u0 (k^x - 1) / (k - 1) to a client's cumulative uses best.

    Least squares within [k_low, k_high], which must be above 0; NULL with fewer than
    ``min_active_days`` days. Branch and bound: intervals whose least possible error is above an error
    already met are dropped, the others halved. What is left surely holds the best k; a section search
    narrows each connected part of it, and the best of these counts. All of it is one projection over one
    short array per client, at most an entry per calendar day, and needs no further shuffle.
    """
    if rules.k_low <= 0:
        raise ValueError("k_low must be above 0")
    fits = cumulative.groupBy("ClientId").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
        ).alias("points"),
        F.first("u0").cast("double").alias("u0"),
    )
    enough = F.size("points") >= rules.min_active_days
    points, u0 = F.col("points"), F.col("u0")

    ks = candidates(rules.k_low, rules.k_high)
    ks = [*ks[:-1:FIRST], ks[-1]]
    knots = F.transform(F.array(*[F.lit(k) for k in ks]), lambda k: _knot(k, u0))
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(len(ks) - 2)),
        lambda i: F.struct(F.col("knots")[i].alias("lo"), F.col("knots")[i + 1].alias("hi"), F.lit(True).alias("new")),
    )

    def kept(judged: Column, best: Column) -> Column:
        found = lambda least: F.struct(_promising(judged, least).alias("left"), least.alias("best"))
        return _bind(_least_error(judged, best), found)

    def halves(i: Column) -> Column:
        parts = lambda m: F.array(
            F.struct(i.lo.alias("lo"), m.alias("hi"), F.lit(True).alias("new")),
            F.struct(m.alias("lo"), i.hi.alias("hi"), F.lit(False).alias("new")),
        )
        return _bind(_knot((i.lo.k + i.hi.k) / 2, u0), parts)

    def halved(state: Column, _step: Column) -> Column:
        return _bind(_judged(points, F.flatten(F.transform(state.left, halves))), lambda j: kept(j, state.best))

    first = kept(F.col("judged"), _error(points, F.col("knots")[0]))
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.col("first"), halved).getField("left")

    # Intervals that touch are one span; they come in rising order.
    def joined(spans: Column, i: Column) -> Column:
        last = F.element_at(spans, -1)
        grown = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last.lo.alias("lo"), i.hi.k.alias("hi"))))
        own = F.concat(spans, F.array(F.struct(i.lo.k.alias("lo"), i.hi.k.alias("hi"))))
        return F.when(F.size(spans) == 0, own).when(last.hi == i.lo.k, grown).otherwise(own)

    spans = F.aggregate(F.col("rounds"), F.expr("cast(array() AS array<struct<lo: double, hi: double>>)"), joined)
    steps = math.ceil(math.log((rules.k_high - rules.k_low) / PRECISION) / -math.log(GOLDEN))
    best = F.array_min(F.transform(F.col("spans"), lambda span: _section(points, u0, span, steps)))
    fitted = fits.withColumn("knots", knots)
    for name, step in (("judged", _judged(points, pairs)), ("first", first), ("rounds", rounds), ("spans", spans)):
        fitted = fitted.withColumn(name, F.when(enough, step))
    return fitted.select("ClientId", F.when(enough, best.getField("k")).alias("k_factor"))
