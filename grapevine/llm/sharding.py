"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Documents with equal text form a group, whose vector is its share of all bytes, tokens and rows.
Groups are placed in falling order, each in the shard where the dot product of its vector with the
residual capacity is highest. Every task places its share of the groups into bins of its own; the
bins, a few per task, are then placed the same way. A group with a large share is split first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grapevine.llm.rows import numbered
from grapevine.session import Workspace

SHARDS = 8
PARTS = 16  # a group with over a PARTS-th of a shard, in any dimension, is split
GROUPS = 20_000  # that a task places, unless there are more than that for every shuffle partition
CHUNK = 50_000  # rows that are numbered together
DIMENSIONS = ["bytes", "tokens", "rows"]
_TEXT = ["size", "text_crc32", "digest"]  # equal for equal texts only, but for a chance of 1 in 2^96


def measured(docs: DataFrame) -> DataFrame:
    """Per document: row number, size, crc32 and digest of its text (null: empty), and its words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return numbered(docs.select("doc_id", text.alias("text"))).select(
        "row_id",
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("digest"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def place(vectors: Iterator[np.ndarray], capacity: np.ndarray) -> Iterator[int]:
    """The shard of each vector in turn: highest dot product with what is left, the first of equals.

    ``capacity`` has a row per shard. A shard may be filled over its capacity: what is left is then
    below nil, and others come first.
    """
    left = capacity.copy()
    for vector in vectors:
        shard = int(np.argmax(left @ vector))
        left[shard] -= vector
        yield shard


def sharded(docs: DataFrame, workspace: Workspace, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (its number in the shard) of every document.

    Null text counts as empty, with size 1. Equal texts share a shard, unless their group was
    split; rows that repeat are rows of one group. No document, no row. Of shards that suit alike
    the lowest is taken. Only ``doc_id`` and ``text`` are read, whole; other columns may be called
    anything.
    """
    rows = workspace.keep(measured(docs), "measured")
    groups = rows.groupBy(*_TEXT, "words").agg(F.count("*").alias("rows"))
    sums = [F.sum(F.col("rows") * F.col(c)).alias(n) for n, c in (("bytes", "size"), ("tokens", "words"))]
    totals = groups.agg(*sums, F.sum("rows").alias("rows"), F.count("*").alias("groups")).first()
    total = {name: max(1, totals[name] or 0) for name in DIMENSIONS}
    count = {"bytes": F.col("rows") * F.col("size"), "tokens": F.col("rows") * F.col("words"), "rows": F.col("rows")}
    share = [(count[name] / F.lit(total[name])).alias(f"share_{name}") for name in DIMENSIONS]
    largest = F.greatest(*[F.col(f"share_{name}") for name in DIMENSIONS])

    # At most shards * PARTS groups in each dimension are as large as this.
    hot = groups.select(*_TEXT, *share).where(largest * shards * PARTS > 1)
    hot = hot.select(*_TEXT, F.ceil(largest * shards * PARTS).cast("int").alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row_id"), F.col("parts"))).cast("int")
    split = rows.join(F.broadcast(hot), _TEXT, "left").withColumn("part", part).drop("parts")

    keys = [*_TEXT, "part"]
    items = split.groupBy(*keys, "words").agg(F.count("*").alias("rows")).select(*keys, *share)
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, -(-totals["groups"] // GROUPS)))
    dealt = items.withColumn("weight", largest).repartition(tasks, *keys)
    dealt = dealt.sortWithinPartitions(F.desc("weight"), *keys).drop("weight")
    equal = np.full((shards, len(DIMENSIONS)), 1 / shards)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        batches = (b for b in batches if len(b))
        chosen: list[int] = []
        waiting: list[pa.RecordBatch] = []

        def vectors() -> Iterator[np.ndarray]:
            for batch in batches:
                waiting.append(batch)
                yield from np.stack([batch.column(f"share_{name}").to_numpy() for name in DIMENSIONS], 1)

        for shard in place(vectors(), equal / tasks):
            chosen.append(shard)
            if len(chosen) == len(waiting[-1]):
                batch = waiting.pop()
                own = [pa.array([task] * len(batch), pa.int32()), pa.array(chosen, pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "task", "bin"])
                chosen = []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    placed = workspace.keep(dealt.mapInArrow(fill, f"{schema}, task int, bin int"), "placed")

    # A few numbers for each task: bins are placed as groups are, the largest first.
    loads = placed.groupBy("task", "bin").agg(*[F.sum(f"share_{name}").alias(name) for name in DIMENSIONS]).collect()
    loads.sort(key=lambda r: (-max(r[name] for name in DIMENSIONS), r["task"], r["bin"]))
    shard_of_bin = place((np.array([r[name] for name in DIMENSIONS]) for r in loads), equal)
    bins = [(r["task"], r["bin"], shard) for r, shard in zip(loads, shard_of_bin, strict=True)]
    spark = rows.sparkSession
    of_bin = F.broadcast(spark.createDataFrame(bins, "task int, bin int, shard int"))  # shards * tasks rows
    assigned = placed.select(*keys, "task", "bin").join(of_bin, ["task", "bin"]).select(*keys, "shard")

    chunks = max(1, -(-total["rows"] // CHUNK))
    located = workspace.keep(
        split.join(assigned, keys).withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.lit(chunks))), "located"
    )
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = located.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    offsets = sizes.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row_id"))
    return (
        located.withColumn("number", number)
        .join(offsets, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("number") - 1).alias("slot"))
    )
