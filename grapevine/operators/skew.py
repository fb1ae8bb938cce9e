"""Joins that stay balanced when a few keys hold much of the data."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000  # a key with fewer rows overloads no task; of a hot key, about as many go to one
TRACKED = 8192  # keys that one summary holds, a power of two
SLACK = 4  # a summary may miss a key by a SLACK-th of the rows that make it hot
LISTED = 1000  # hot keys that stand in the plan itself; more are broadcast


def _same_on_every_run(columns: Sequence[str]) -> Column:
    # A content hash, not rand(): a task repeated after an executor loss must agree.
    return F.xxhash64(*[F.col(c) for c in columns])


def _setting_in_bytes(spark: SparkSession, name: str) -> int:
    text = spark.conf.get(name).lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, which only a classic session tells; elsewhere any frame may be large."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return 2**62


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's own size estimate lets it broadcast the frame unasked."""
    limit = _setting_in_bytes(df.sparkSession, "spark.sql.autoBroadcastJoinThreshold")
    return estimated_bytes(df) <= limit


class Probe:
    """Finds the hot keys of a table, in one job for all joins on it.

    ``rows`` holds the key columns of each join in ``key_sets``. A key is hot from ``hot_rows`` rows
    on, HOT_ROWS by default, however small its share is. Every row is counted, in mergeable summaries
    of the most frequent keys, which combine before they are shuffled. Keys are dealt by hash over as
    many summaries as it takes for each to miss no key that is hot. Nothing is counted for frames
    that are smaller than what the session calls a skewed partition. The first call of ``hot`` runs
    the job.
    """

    def __init__(self, rows: DataFrame, *key_sets: Sequence[str], hot_rows: int | None = None):
        self.rows = rows
        self.hot_rows = HOT_ROWS if hot_rows is None else hot_rows
        self.key_sets = [list(keys) for keys in key_sets]
        self._one_job = Lock()  # for steps that are made at the same time

    @cached_property
    def large(self) -> bool:
        limit = _setting_in_bytes(
            self.rows.sparkSession, "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"
        )
        return estimated_bytes(self.rows) > limit

    @cached_property
    def _found(self) -> list[tuple[int, int, int]]:
        """Key set, key hash and rows: small numbers to collect, a key for every ``hot_rows`` rows at most.

        A summary of n rows counts a key up to 3.5 / TRACKED n too few, less where few keys hold most rows.
        """
        rows = self.rows.count()  # of a file, from its footer
        missed = 3.5 / TRACKED * rows
        summaries = max(16, math.ceil(missed * SLACK / self.hot_rows))
        marks = [
            F.struct(F.lit(i).alias("key_set"), _same_on_every_run(keys).alias("key"))
            for i, keys in enumerate(self.key_sets)
        ]
        # A summary cannot list more keys than it tracks, and does not list those that it surely overrates.
        frequent = F.expr(f"approx_top_k(key, {TRACKED * 3 // 4}, {TRACKED})")
        counted = (
            self.rows.select(F.explode(F.array(*marks)).alias("mark"))
            .select("mark.*")
            .groupBy("key_set", F.pmod("key", F.lit(summaries)).alias("summary"))
            .agg(frequent.alias("found"))
            .select("key_set", F.explode("found").alias("found"))
            .where(F.col("found.count") >= self.hot_rows)
        )
        return [(row["key_set"], row["found"]["item"], row["found"]["count"]) for row in counted.collect()]

    def hot(self, keys: Sequence[str]) -> dict[int, int]:
        """About how many rows the hot keys of one key set have, by hash of the key.

        Only the placement of rows depends on this, never the result.
        """
        wanted = self.key_sets.index(list(keys))
        if not self.large:
            return {}
        with self._one_job:
            found = self._found
        return {key: n for key_set, key, n in found if key_set == wanted}

    def called(self, names: dict[str, str]) -> Probe:
        """This probe for frames that call its columns otherwise: new name by old one. No other job."""
        return _Called(self, names)


class _Called(Probe):
    def __init__(self, probe: Probe, names: dict[str, str]):
        super().__init__(probe.rows, *[[names.get(c, c) for c in keys] for keys in probe.key_sets])
        self.probe = probe

    def hot(self, keys: Sequence[str]) -> dict[int, int]:
        return self.probe.hot(self.probe.key_sets[self.key_sets.index(list(keys))])


def _salt_count(n: int) -> int:
    """Tasks that share a key of ``n`` rows: a power of two."""
    return max(2, 1 << (n // max(1, HOT_ROWS)).bit_length())


def _salts(keys: Sequence[str], hot: dict[int, int]) -> Column:
    """Number of tasks that share a row's key, 1 where it is not hot."""
    by_salts: dict[int, list[int]] = {}
    for key, n in hot.items():
        by_salts.setdefault(_salt_count(n), []).append(key)
    salts = F.lit(1)
    for count, own in by_salts.items():
        salts = F.when(_same_on_every_run(keys).isin(own), F.lit(count)).otherwise(salts)
    return salts


def _with_salts(df: DataFrame, keys: Sequence[str], hot: dict[int, int]) -> DataFrame:
    """The frame with ``_salts``. A long list is no part of the plan: it is broadcast, sixteen bytes for every HOT_ROWS rows."""
    if len(hot) <= LISTED:
        return df.withColumn("_salts", _salts(keys, hot))
    listed = df.sparkSession.createDataFrame([(k, _salt_count(n)) for k, n in hot.items()], "_key long, _salts int")
    marked = df.withColumn("_key", _same_on_every_run(keys)).join(F.broadcast(listed), "_key", "left").drop("_key")
    return marked.withColumn("_salts", F.coalesce("_salts", F.lit(1)))


def balanced_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str] | None,
    probe: Probe,
    how: str = "inner",
) -> DataFrame:
    """``big.join(small, keys, how)`` (inner, left or left_semi) with hot keys spread out.

    Where the small side can be broadcast, or the probe finds no hot key, this is the plain
    join. Otherwise the rows of a hot key in ``big`` are dealt over tasks, the more the heavier
    the key, by a hash of the ``spread`` columns, and the matching rows of ``small`` are repeated
    once per task; all other keys join as they are. Without ``spread`` rows are dealt by their
    place in a source that ``big`` is read from, which a repeated task finds the same; this parts
    rows that are alike. The list of hot keys is fixed before the join, the same for both sides.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"cannot balance a {how!r} join")
    keys = list(keys)
    hot = probe.hot(keys) if not fits_broadcast(small) else {}
    if not hot:
        return big.join(small, keys, how)
    own = F.xxhash64(F.monotonically_increasing_id()) if spread is None else _same_on_every_run(spread)
    dealt = big.withColumn("_own", own)
    dealt = _with_salts(dealt, keys, hot).withColumn("_salt", F.pmod("_own", F.col("_salts")).cast("int"))
    repeated = _with_salts(small, keys, hot)
    repeated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return dealt.drop("_own", "_salts").join(repeated, [*keys, "_salt"], how).drop("_salt")
