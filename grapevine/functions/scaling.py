"""Ratios, scaling and the growth curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_SPLIT = 2.0**27 + 1  # parts a double into two halves whose products are exact


def _halves(value: Column) -> tuple[Column, Column]:
    high = value * _SPLIT - (value * _SPLIT - value)
    return high, value - high


def rounded_to_cents(value: Column) -> Column:
    """The double nearest to two decimal places of the binary value, ties to even; for values from 0 to 2^40.

    ``round`` and ``bround`` round the shortest decimal of a double instead: 0.075, which as a double is a
    little less, becomes 0.08 there and 0.07 here. The product with 200 is odd where the value is half-way; its
    rounding error, found exactly from halves of the factors, tells which side of that the value is on.
    """
    product = value * 200.0
    high, low = _halves(value)
    error = (high * 200.0 - product) + low * 200.0
    below, above = F.floor((product - 1) / 2), F.floor((product + 1) / 2)
    even = F.when(below % 2 == 0, below).otherwise(above)
    at_half = (product % 2) == 1
    cents = F.when(~at_half | (error > 0), above).when(error < 0, below).otherwise(even)
    return cents.cast("double") / 100


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in doubles; NULL, never an error or NaN, when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def with_minmax(df: DataFrame, scaled: dict[str, str]) -> DataFrame:
    """Add min-max scaled copies of columns (``{new name: column}``).

    The extremes come from one one-row aggregate used as a scalar subquery, so no frame is
    gathered into one task. A column with a single value scales to NULL.
    """
    extremes = df.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"{c}_lo") for c in scaled.values()],
            *[F.max(c).cast("double").alias(f"{c}_hi") for c in scaled.values()],
        ).alias("extremes")
    ).scalar()
    return df.withColumns(
        {
            new: ratio(
                F.col(c) - extremes.getField(f"{c}_lo"),
                extremes.getField(f"{c}_hi") - extremes.getField(f"{c}_lo"),
            )
            for new, c in scaled.items()
        }
    )


def virality_curve(t: Column, k: Column, first_uses: Column) -> Column:
    """Cumulative uses after ``t`` days: u0 (k^t - 1) / (k - 1), and u0 t at k = 1."""
    linear = first_uses * t
    return F.when(k == 1, linear).otherwise(
        first_uses * F.try_divide(F.pow(k, t) - 1, k - 1)
    )
