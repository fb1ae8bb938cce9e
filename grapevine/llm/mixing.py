"""Mixing sources to target weights by repeating documents.

Words per source and the weights give every source a target, and target over words the rate at
which its documents repeat: each is emitted floor(rate) times, and once more where a number drawn from its
hash is below the rate's fraction.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapevine.llm.rows import placed
from grapevine.session import Workspace

WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
SHARE = 1.5  # of all words, that the mix takes
MOST = 2.0  # times a source's words, that its target may reach
SEED = 42
SOURCES = 10_000  # up to so many rows of sources are broadcast
SALTS = 32  # tasks that share a source's rows where there are more sources
CHUNK = 100_000  # rows alike that one task writes out
_HEX = 13  # hex digits of a hash: as many bits as a double holds exactly


class Mixture(NamedTuple):
    """``rates``: a row per source; ``counted``: a row, with its count, for documents alike in id, text and source."""

    rates: DataFrame
    counted: DataFrame


def _digest(seed: int) -> Column:
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *fields).cast("binary"), 256)


def _level(sources: DataFrame, total: int, share: float, most: float) -> float:
    """Words per weight of the sources whose target does not stop at ``most`` times their size.

    Round by round the sources above it stop, and what they leave is shared by the rest, until none
    is above. Only sums come to the driver; a round stops at least a source, mostly all that will.
    """
    level, stopped = 0.0, -1
    while True:
        above = most * F.col("source_size") < F.lit(level) * F.col("weight")
        sums = sources.agg(
            F.count_if(above).alias("stopped"),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if sums["stopped"] == stopped or not sums["weight"]:
            return level
        level, stopped = (share * total - most * sums["size"]) / sums["weight"], sums["stopped"]


def mixture(
    docs: DataFrame,
    workspace: Workspace,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
) -> Mixture:
    """Sizes, targets and rates of the sources, and the documents counted.

    A document's size is its words, none where the text is null. Sources get the weights in turn, by code
    point, the missing source last. A source without words has target 0. Only ``doc_id``,
    ``source`` and ``text`` are read, whatever other columns there are. No rows, no sources.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    # Rows alike are added up before they are shuffled.
    counted = docs.select("doc_id", "source", size.alias("size"), _digest(seed).alias("digest"))
    counted = counted.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n"))
    counted = workspace.keep(counted, "counted")
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sizes = workspace.keep(sizes.withColumn("last", F.col("source").isNull()), "sources")
    sources = placed(sizes, ["last", "source"], workspace)
    choices = F.array(*[F.lit(w) for w in weights])
    weight = F.element_at(choices, (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = workspace.keep(sources.select("source", "source_size", weight.alias("weight")), "weighted")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = _level(sources, total, share, most)
    target = F.least(F.lit(most) * F.col("source_size"), F.lit(level) * F.col("weight"))
    rates = sources.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return Mixture(workspace.keep(rates.withColumn("rate", rate), "rates"), counted)


def _with_rate(rows: DataFrame, made: Mixture) -> DataFrame:
    """The rows with ``source_size``, ``target`` and ``rate`` of their source."""
    rates = made.rates.select(F.col("source").alias("of"), "source_size", "target", "rate")
    same = F.col("source").eqNullSafe(F.col("of"))
    if rates.count() <= SOURCES:
        return rows.join(F.broadcast(rates), same).drop("of")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    repeated = rates.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, same & (F.col("salt") == F.col("own"))).drop("of", "salt", "own")


def _extra(n: Column) -> Column:
    """How many of ``n`` documents alike are emitted once more: for one document, one at the chance of the fraction."""
    draw = F.conv(F.substring("digest", 1, _HEX), 16, 10).cast("double") / F.lit(float(16**_HEX))
    expected = n * (F.col("rate") - F.floor("rate"))
    return F.floor(expected) + (draw < expected - F.floor(expected)).cast("long")


def _repeated(rows: DataFrame, times: str, most: int, name: str) -> DataFrame:
    """Every row ``times`` over, numbered from 0; ``most`` is the largest ``times``."""
    chunks = F.ceil(F.col(times) / CHUNK).cast("long")
    rows = rows.where(F.col(times) > 0)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    if most > CHUNK:
        rows = rows.repartition("digest", "chunk")
    first = F.col("chunk") * CHUNK
    last = F.least(F.col(times), first + CHUNK) - 1
    return rows.withColumn(name, F.explode(F.sequence(first, last))).drop("chunk")


def _most(counted: DataFrame) -> int:
    return counted.agg(F.max("n")).first()[0] or 0


def planned(made: Mixture) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``copies`` of every document; no text is moved.

    Of documents alike in id, text and source as many are emitted once more as the fraction tells, the rest by chance.
    """
    rows = _repeated(_with_rate(made.counted, made), "n", _most(made.counted), "nth")
    copies = F.floor("rate") + (F.col("nth") < _extra(F.col("n"))).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def emitted(docs: DataFrame, made: Mixture, seed: int = SEED) -> DataFrame:
    """The mix: the documents' columns, each row as often as ``planned`` says. ``made`` is the mixture of ``docs``.

    Of documents alike in id, text and source, one row stands for all.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(whole, "source", _digest(seed).alias("digest"))
    alike = made.counted.where("n > 1").select(F.col("source").alias("own"), F.col("digest").alias("own_digest"), "n")
    same = (F.col("digest") == F.col("own_digest")) & F.col("source").eqNullSafe(F.col("own"))
    single = rows.join(alike, same, "left_anti").withColumn("n", F.lit(1).cast("long"))
    grouped = rows.join(alike, same, "left_semi").groupBy("source", "digest")
    grouped = grouped.agg(F.any_value("whole").alias("whole"), F.count("*").alias("n")).select(*single.columns)
    ready = _with_rate(single.union(grouped), made)
    ready = ready.withColumn("times", F.col("n") * F.floor("rate") + _extra(F.col("n")))
    return _repeated(ready, "times", 2 * _most(made.counted), "copy").select("whole.*")
