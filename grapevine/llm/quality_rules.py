"""Quality rules: text statistics, two fixed rules, and robust multivariate outliers per language and source.

The outliers come from minimum-covariance-determinant estimates: of the transformed statistic
vectors of a language and source, the share ``COVERED`` whose covariance has the least determinant
gives centre and covariance, and a vector too far from the centre by Mahalanobis distance is
rejected. Concentration steps start from the medians (several scales of them) and keep, step by
step, the nearest share of the rows; a step is one aggregation over all rows, by group and
distance bin, so a group of any size is never in one task. A group's estimate is drawn towards its
language's, and that towards the one of all rows, by their numbers of rows, so no number of rows
switches from one estimate to another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapevine.llm import words as W
from grapevine.llm.rows import with_columns
from grapevine.session import Workspace

MIN_WORDS = 10
MAX_REPEATED = 0.20  # share of words that stand in repeated windows
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_signs"]
COUNTS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)

COVERED = 0.75
STEPS = 8
SPREADS = (1.0, 3.0)  # starting scales, in robust standard deviations
PRIOR_ROWS = 60  # rows that the coarser estimate counts for beside a group's own
REJECTED_SHARE = 1e-9  # of normally distributed vectors
BINS_PER_DOUBLING = 32
FIT_FILES = 8  # of the estimates of a step, a row for each group and start


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts per text; a null counts as an empty text.

    Words are runs of bytes other than ASCII space. ``n_repeat_words`` are the words that stand
    in a window of five words which the text holds twice or more, first occurrence included.
    """
    text = W.text_of(texts)
    n = len(text.offsets) - 1
    out = {name: np.zeros(n, np.int64) for name in COUNTS}
    for lo, begin, end, hashes in W.spans_in_slices(text, W.words_of):
        hi = lo + np.searchsorted(text.offsets[lo:], end[-1], "left") if len(end) else lo
        part = slice(lo, max(hi, lo + 1))
        bounds = np.searchsorted(begin, text.offsets[lo : part.stop + 1])
        out["n_words"][part] = np.diff(bounds)
        rows = np.repeat(np.arange(part.stop - lo), np.diff(bounds))
        covered = _in_repeated_windows(rows, hashes)
        out["n_repeat_words"][part] = W.row_sums(covered, bounds)
    for name, wanted in _BYTE_COUNTS.items():
        out[name] = W.row_sums(wanted[text.data], text.offsets)
    for lo, begin, end, hashes in W.spans_in_slices(text, _lines):
        rows = np.searchsorted(text.offsets, begin, "right") - 1
        _, before = W.repeated_within(rows, hashes)
        out["n_lines"] += np.bincount(rows, minlength=n)
        out["n_dup_lines"] += np.bincount(rows[before], minlength=n)
    return out


def _byte_table(wanted) -> np.ndarray:
    return np.array([wanted(b) for b in range(256)], bool)


# A character counts by its first byte.
_BYTE_COUNTS = {
    "word_chars": _byte_table(lambda b: b not in W.SPACES and b & 0xC0 != 0x80),
    "n_symbols": _byte_table(lambda b: b in SYMBOLS),
    "n_upper": _byte_table(lambda b: 65 <= b <= 90),
    "n_signs": _byte_table(lambda b: b < 128 and b not in W.SPACES and not chr(b).isalnum()),
}


def _lines(text: W.Text) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word."""
    begin, end = W.words_of(text, _LINE_CLASSES)
    filled = np.zeros(len(text.data) + 1, np.int64)
    np.cumsum(W.BLANK_OR_WORD[text.data] != W.SPACE, out=filled[1:])
    real = filled[end] > filled[begin]
    return begin[real], end[real]


_LINE_CLASSES = np.full(256, W.LETTER, np.uint8)
_LINE_CLASSES[ord("\n")] = W.SPACE


def _in_repeated_windows(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """By word: whether it stands in a window that its row holds twice or more."""
    n = len(hashes)
    covered = np.zeros(n, bool)
    if n < WINDOW:
        return covered
    last = n - WINDOW + 1
    windows = np.zeros(last, np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + last]
    whole = np.flatnonzero(rows[:last] == rows[WINDOW - 1 :])
    again, _ = W.repeated_within(rows[whole], W.mixed(windows[whole]))
    for k in range(WINDOW):
        covered[whole[again] + k] = True
    return covered


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of the words in repeated windows."""
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > round(100 * MAX_REPEATED) * n)


#: Name, transformed statistic, and the least spread it is held to have: most texts hold no symbol
#: and repeat no line, so the spread of these shares alone would be nil. What is added to the wholes
#: keeps short texts, whose shares vary most, near the middle.
_STATISTICS = [
    ("log_words", lambda: F.log(F.col("n_words") + 1.0), 1.0),
    ("log_word_length", lambda: F.log((F.col("word_chars") + 100.0) / (F.col("n_words") + 20.0)), 0.06),
    ("symbol_share", lambda: _root_share("n_symbols", "word_chars", 100), 0.05),
    ("sign_share", lambda: _root_share("n_signs", "word_chars", 100), 0.05),
    ("upper_share", lambda: _root_share("n_upper", "word_chars", 100), 0.06),
    ("dup_line_share", lambda: _root_share("n_dup_lines", "n_lines", 2), 0.12),
    ("repeat_share", lambda: _root_share("n_repeat_words", "n_words", 20), 0.09),
]
NAMES = [name for name, _, _ in _STATISTICS]
LEAST_SPREAD = np.array([least for _, _, least in _STATISTICS])
SIZE = len(NAMES)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]
_SUMS = [*[f"s{i}" for i in range(SIZE)], *[f"p{i}_{j}" for i, j in PAIRS]]  # of the statistics and their products


def _root_share(part: str, whole: str, more: int) -> Column:
    return F.sqrt(F.col(part) / (F.col(whole) + more))


def with_statistics(counted: DataFrame) -> DataFrame:
    """Transformed statistics beside the counts."""
    return counted.select("*", *[make().alias(name) for name, make, _ in _STATISTICS])


def _levels(lang: str, source: str) -> Column:
    """The groups a row belongs to, finest first: language and source, language, all."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    every = F.lit(None).cast("string")
    return F.array(
        F.struct(F.lit(0).alias("level"), text(lang).alias("lang_key"), text(source).alias("source_key")),
        F.struct(F.lit(1).alias("level"), text(lang).alias("lang_key"), every.alias("source_key")),
        F.struct(F.lit(2).alias("level"), every.alias("lang_key"), every.alias("source_key")),
    )


_GROUP = ["level", "lang_key", "source_key"]
_GROUP_SCHEMA = "level int, lang_key string, source_key string"
_FIT_SCHEMA = f"{_GROUP_SCHEMA}, start int, log_det double, rows long, centre array<double>, whitener array<double>"


def _distance() -> Column:
    """Squared Mahalanobis distance: the vector, centred and multiplied by the whitening matrix."""
    at = [F.col(name) - F.col("centre")[i] for i, name in enumerate(NAMES)]
    rows = [
        reduce(lambda a, b: a + b, [F.col("whitener")[i * SIZE + j] * at[j] for j in range(i + 1)])
        for i in range(SIZE)
    ]
    return reduce(lambda a, b: a + b, [r * r for r in rows])


def fit(vectors: DataFrame, workspace: Workspace, lang: str = "lang", source: str = "source") -> DataFrame:
    """Centre and whitening matrix per group (``_FIT_SCHEMA``), the start with the least determinant.

    ``vectors`` has the statistics as columns; write it first, every step reads it. A group's
    result is one row, so the result has as many rows as there are languages and sources.
    """
    rows = vectors.select(F.explode(_levels(lang, source)).alias("group"), *NAMES).select("group.*", *NAMES)
    grid = [F.percentile_approx(name, [0.25, 0.5, 0.75], 2000).alias(f"q_{name}") for name in NAMES]
    quartiles = rows.groupBy(*_GROUP).agg(F.count("*").alias("rows"), *grid)
    found = quartiles.mapInArrow(_starts, _FIT_SCHEMA)
    for step in range(STEPS):
        found = workspace.keep(found, f"mcd-{step}", FIT_FILES)
        binned = (
            rows.join(found, _same_group(rows, found), "inner")
            .select(*[rows[c] for c in _GROUP], "start", *[rows[n] for n in NAMES], _distance().alias("d2"))
            .withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-3) * BINS_PER_DOUBLING).cast("int"))
        )
        sums = [F.sum(name).alias(f"s{i}") for i, name in enumerate(NAMES)]
        sums += [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in PAIRS]
        by_bin = binned.groupBy(*_GROUP, "start", "bin").agg(F.count("*").alias("n"), *sums)
        # A group has at most as many bins as distances have, some thousand: no sort or window, of which
        # every task would take pages of memory for a handful of rows.
        bins = F.collect_list(F.struct("bin", "n", F.array(*_SUMS).alias("sums"))).alias("bins")
        found = by_bin.groupBy(*_GROUP, "start").agg(bins).mapInArrow(_concentrated, _FIT_SCHEMA)
    best = F.min_by(F.struct("rows", "centre", "whitener"), F.struct("log_det", "start")).alias("best")
    return workspace.keep(found.groupBy(*_GROUP).agg(best).select(*_GROUP, "best.*"), "mcd", FIT_FILES)


def _same_group(a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in _GROUP])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Medians, and spreads from the quartiles, at several scales."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            q = np.array([row[f"q_{name}"] for name in NAMES], float)
            spread = np.hypot((q[:, 2] - q[:, 0]) / 1.349, LEAST_SPREAD)
            for start, scale in enumerate(SPREADS):
                whitener = np.diag(1 / (spread * scale))
                out.append(_fitted(row | {"start": start}, 0.0, q[:, 1], whitener))
        if out:
            yield pa.RecordBatch.from_pylist(out, _FIT_ARROW)


def _fitted(row: dict, log_det: float, centre: np.ndarray, whitener: np.ndarray) -> dict:
    kept = {c: row[c] for c in (*_GROUP, "start", "rows")}
    return kept | {"log_det": log_det, "centre": centre.tolist(), "whitener": whitener.ravel().tolist()}


_FIT_ARROW = pa.schema(
    [("level", pa.int32()), ("lang_key", pa.string()), ("source_key", pa.string()), ("start", pa.int32())]
    + [("log_det", pa.float64()), ("rows", pa.int64())]
    + [("centre", pa.list_(pa.float64())), ("whitener", pa.list_(pa.float64()))]
)


def _concentrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean and covariance of each group's nearest rows, from the sums of its bins. A bin that begins within the share counts whole."""
    for batch in batches:
        out, bins = [], batch.column("bins")
        for i, row in enumerate(batch.drop_columns(["bins"]).to_pylist()):
            at, n, sums = bins[i].values.flatten()
            nearest = np.argsort(at.to_numpy())
            n, sums = n.to_numpy()[nearest], sums.flatten().to_numpy().reshape(-1, len(_SUMS))[nearest]
            row["rows"] = int(n.sum())
            n = n[np.cumsum(n) - n < COVERED * row["rows"]]
            total = dict(zip(_SUMS, sums[: len(n)].sum(0) / n.sum(), strict=True))
            mean = np.array([total[f"s{k}"] for k in range(SIZE)])
            cov = np.empty((SIZE, SIZE))
            for k, j in PAIRS:
                cov[k, j] = cov[j, k] = total[f"p{k}_{j}"] - mean[k] * mean[j]
            # The nearest share of a normal sample is narrower than the whole; the least spreads keep it regular.
            cov = cov * _consistency(COVERED, SIZE) + np.diag(LEAST_SPREAD**2)
            lower = np.linalg.cholesky(cov)
            out.append(_fitted(row, 2 * float(np.log(np.diag(lower)).sum()), mean, np.linalg.inv(lower)))
        if out:
            yield pa.RecordBatch.from_pylist(out, _FIT_ARROW)


def chi_square_quantile(share: float, freedom: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty's approximation)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(share)
    return freedom * (1 - 2 / (9 * freedom) + z * math.sqrt(2 / (9 * freedom))) ** 3


def _consistency(share: float, freedom: int) -> float:
    """What the covariance of the nearest share of a normal sample is multiplied by."""
    from statistics import NormalDist

    z = chi_square_quantile(share, freedom)
    k = freedom + 2
    inside = NormalDist().cdf(((z / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))
    return share / inside


_JUDGE_SCHEMA = "lang_key string, source_key string, centre array<double>, whitener array<double>"
_JUDGE_ARROW = pa.schema([("lang_key", pa.string()), ("source_key", pa.string())] + list(_FIT_ARROW)[-2:])


def _moments(estimate: dict) -> tuple[np.ndarray, np.ndarray]:
    lower = np.linalg.inv(np.array(estimate["whitener"]).reshape(SIZE, SIZE))
    return np.array(estimate["centre"]), lower @ lower.T


def drawn_towards(own: dict, coarser: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of a mixture: a group's rows, and PRIOR_ROWS rows of the coarser estimate."""
    centre, cov = _moments(own)
    weight = own["rows"] / (own["rows"] + PRIOR_ROWS)
    apart = centre - coarser[0]
    mixed = weight * cov + (1 - weight) * coarser[1] + weight * (1 - weight) * np.outer(apart, apart)
    return weight * centre + (1 - weight) * coarser[0], mixed


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            centre, cov = drawn_towards(row["fit0"], drawn_towards(row["fit1"], _moments(row["fit2"])))
            whitener = np.linalg.inv(np.linalg.cholesky(cov))
            keys = {c: row[c] for c in ("lang_key", "source_key")}
            out.append(keys | {"centre": centre.tolist(), "whitener": whitener.ravel().tolist()})
        if out:
            yield pa.RecordBatch.from_pylist(out, _JUDGE_ARROW)


def estimates(fits: DataFrame) -> DataFrame:
    """Centre and whitening matrix that each language and source is judged by (``_JUDGE_SCHEMA``)."""
    of_level = lambda k, *keys: fits.where(F.col("level") == k).select(
        F.lit(0).alias("every"), *keys, F.struct("rows", "centre", "whitener").alias(f"fit{k}")
    )
    own = of_level(0, "lang_key", "source_key")
    joined = own.join(of_level(1, "lang_key").drop("every"), "lang_key").join(of_level(2), "every")
    return joined.drop("every").mapInArrow(_drawn, _JUDGE_SCHEMA)


def judged(vectors: DataFrame, fits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows with ``base_failed``, ``distance`` and ``kept``.

    A row is judged by the estimate of its language and source, drawn towards the coarser ones; a
    group of a few rows is judged nearly by these alone.
    """
    limit = math.sqrt(chi_square_quantile(1 - REJECTED_SHARE, SIZE))
    own = estimates(fits).select(F.struct("lang_key", "source_key").alias("_key"), "centre", "whitener")
    finest = _levels(lang, source)[0]
    keyed = vectors.withColumn("_key", F.struct(finest["lang_key"].alias("lang_key"), finest["source_key"].alias("source_key")))
    scored = keyed.join(own, "_key", "left").withColumn("distance", F.sqrt(_distance()))
    scored = scored.withColumn("base_failed", base_failed())
    verdict = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    return scored.withColumn("kept", verdict).drop("_key", "centre", "whitener", *NAMES)


def _keys_and_text(docs: DataFrame, *others: str) -> DataFrame:
    return docs.select(*others, "lang", "source", "text")


def quality_rules(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance`` and ``kept`` of every document.

    Null text counts as empty, and fails; null language or source is a value of its own. Rows
    that repeat are judged each. No document, no row. Other columns of ``docs`` are ignored.
    """
    counted = with_columns(_keys_and_text(docs, "doc_id"), "text", COUNTS_SCHEMA, text_counts, W.BLOCK)
    vectors = workspace.keep(with_statistics(counted.drop("text")), "statistics")
    return judged(vectors, fit(vectors, workspace)).drop("lang", "source")


def drop_rejected(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """The documents that pass, with all their columns.

    The statistics are counted once for the estimates and once more for the verdict, as a row's
    text need not move for either. A text is handed to Python once, not also within the whole row.
    """
    counted = with_columns(_keys_and_text(docs), "text", COUNTS_SCHEMA, text_counts, W.BLOCK)
    fits = fit(workspace.keep(with_statistics(counted.drop("text")), "statistics"), workspace)
    plain = ("lang", "source", "text")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in plain]
    row = F.struct(F.lit(0).alias("_filled"), *others).alias("_row")
    again = with_columns(docs.select(row, *plain), "text", COUNTS_SCHEMA, text_counts, W.BLOCK)
    kept = judged(with_statistics(again), fits).where("kept")
    return kept.select(*[F.col(c).alias(c) if c.lower() in plain else F.col(f"_row.`{c}`") for c in docs.columns])
