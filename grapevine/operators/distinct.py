"""Distinct counts per group without multiplying the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapevine.operators import skew

SKETCH = 22  # a sketch holds 2 ** SKETCH hashes, 64 MB, in a group that large; small groups take what they need
SET_ROWS = 2 ** (SKETCH - 1)  # distinct values up to which a sketch surely holds the hash of each, and so counts exactly


def distinct_counts(
    df: DataFrame,
    keys: Sequence[str],
    distinct: dict[str, str],
    others: dict[str, Column] | None = None,
    finest: str | None = None,
) -> DataFrame:
    """``df.groupBy(keys)`` with distinct counts (``{new name: column}``) and other aggregates.

    Several ``count_distinct`` in one aggregate make Spark repeat every row once per counted column
    and shuffle all of them twice. Here a group keeps the 64-bit hashes of its values in a sketch of
    bounded size, which combines before the one shuffle. A group with so many values that its
    sketch is full gives itself away by its count. Such groups, one for every SET_ROWS rows at most,
    are counted by rows, which deals their values over all tasks. A frame with fewer rows can have none,
    and nor can one where no value of ``finest``, the key with the most values (all keys by default), has
    so many; a count by it comes first, and as nearly always there are none, the result is one aggregate,
    of which Spark makes the columns that are used. Pass a written table.
    """
    kept = {name: column.alias(name) for name, column in (others or {}).items()}
    hashes = {name: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for name, c in distinct.items()}
    sizes = [
        F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(h, SKETCH)), F.lit(0)).cast("bigint").alias(name)
        for name, h in hashes.items()
    ]
    counted = df.groupBy(*keys).agg(*kept.values(), *sizes)
    if skew.estimated_bytes(df) < SET_ROWS or df.count() < SET_ROWS:
        return counted
    rows = df.groupBy(*([finest] if finest else keys)).agg(F.count(F.lit(1)).alias("_rows"))
    if rows.where(F.col("_rows") >= SET_ROWS).isEmpty():
        return counted
    full = F.greatest(*[F.col(name) for name in distinct], F.lit(0)) >= SET_ROWS
    own = {c: f"_own_{c}" for c in keys}
    heavy = counted.where(full).select(*[F.col(c).alias(own[c]) for c in keys])
    counts = [F.count_distinct(c).alias(name) for name, c in distinct.items()]
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()]
    by_rows = df.join(F.broadcast(heavy), same, "left_semi").groupBy(*keys).agg(*kept.values(), *counts)
    return counted.where(~full).unionByName(by_rows)
