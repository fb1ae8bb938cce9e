"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grapevine.session import Workspace


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id written as text, modulo the divisor. Missing ids have remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor)), F.lit(0))


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows with a number of their own. Write the result before reading it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def placed(df: DataFrame, order: list[str], workspace: Workspace) -> DataFrame:
    """The frame with each row's ``place`` (0, 1, ...) in the order, nulls first, and the sorted ``part`` it is in.

    The rows are sorted over range partitions and written, which fixes their places, and a row count
    for each partition gives its offset. Rows that tie on all of ``order`` stand in one partition.
    """
    sorted_ = df.orderBy(*[F.col(c).asc_nulls_first() for c in order])
    written = sorted_.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    written = workspace.keep(written, "placed")
    first = written.groupBy("part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    shift = (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    moved = written.join(F.broadcast(first.select("part", shift)), "part")
    return moved.select(*df.columns, "part", (F.col("place") + F.col("shift")).alias("place"))


def table_of(batch: pa.RecordBatch, **added: pa.Array) -> pa.RecordBatch:
    """The batch with more columns."""
    names = [*batch.schema.names, *added]
    return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(a) for a in added.values()]], names=names)


@cache
def _trim() -> Callable[[int], int]:
    """Gives freed memory back to the system, where the C library can."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Returns to the system what arrays took that are no longer used."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def in_arrow(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``mapInArrow``, after each task of which the worker process gives back the memory that it worked in.

    Worker processes outlive tasks, and count as their executor's memory while other steps run.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def with_columns(
    df: DataFrame, text: str, schema: str, compute: Callable[[pa.Array], dict], most: int = 16 << 20
) -> DataFrame:
    """All rows and columns of a frame, and what ``compute`` makes of the texts of some rows at a time.

    ``schema`` declares the new columns; their names must not be in the frame.
    """
    from grapevine.llm.words import blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, most):
            yield table_of(block, **compute(block.column(text)))

    return in_arrow(df, run, T.StructType([*df.schema.fields, *T.StructType.fromDDL(schema).fields]))
