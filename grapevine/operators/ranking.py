"""Row numbers in a global order, without gathering a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grapevine.session import Workspace


def ranked(df: DataFrame, group: str, order: Sequence[Column], rank: str, workspace: Workspace) -> DataFrame:
    """Add ``rank``: 1, 2, ... within each group, by ``order``, which should leave no ties.

    A window over a group would sort the whole group in one task. Instead the frame is sorted
    over range partitions by group and order, and written with each row's partition and
    running number; the few counts per partition and group then give every partition's
    offset. The written table fixes which row is in which partition, also if a task repeats.
    """
    # The sort looks for its ranges first, and would make the rows twice.
    numbered = workspace.keep(df, f"unranked-{rank}").orderBy(F.col(group), *order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")
    )
    written = workspace.keep(numbered, f"ranked-{rank}")
    counts = written.groupBy(group, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first")
    )
    # At most a row per partition and one per group, as a group's rows stand side by side.
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    return (
        written.join(offsets, [group, "_part"])
        .withColumn(rank, F.col("_before") + F.col("_row") - F.col("_first") + 1)
        .select(*df.columns, rank)
    )
