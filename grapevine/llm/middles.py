"""Fill-in-middle texts, cut by a learned index from token ranks to offsets.

The offsets of all token boundaries of a text are covered by straight segments that miss none by
more than ``ERROR``; what each boundary misses is stored in a byte. A cut after so many tokens is
predicted by its segment, and the stored residual makes it exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapevine.llm.words import Text, blocks, text_of, words_of

SEED = 42
PERCENT = 50  # of the texts are transformed
SPM_PERCENT = 80  # of these begin with the suffix, the others with the prefix
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 127  # a residual fits a signed byte
BLOCK = 8 << 20  # bytes of text whose boundaries are indexed together


class RankIndex(NamedTuple):
    """Segments over the boundaries of many texts, numbered one after the other, and a residual for each."""

    starts: np.ndarray
    origins: np.ndarray
    rises: np.ndarray
    runs: np.ndarray
    residuals: np.ndarray

    def offsets(self, numbers: np.ndarray) -> np.ndarray:
        """The exact offsets of some boundaries."""
        at = np.searchsorted(self.starts, numbers, "right") - 1
        return _line(self.origins[at], self.rises[at], self.runs[at], numbers - self.starts[at]) + self.residuals[numbers]


def _line(origin: np.ndarray, rise: np.ndarray, run: np.ndarray, steps: np.ndarray) -> np.ndarray:
    # Whole numbers alone, so that a prediction is the same whenever it is made.
    return origin + steps * rise // run


def fitted(offsets: np.ndarray, bounds: np.ndarray, error: int = ERROR) -> RankIndex:
    """Segments that predict every offset to within ``error``; none passes from one text to the next.

    A text begins as one segment through its first and last boundary, moved so that it misses as
    much above as below. A segment that misses more than it may is halved, all of these at a time; one
    with a single boundary misses nothing.
    """
    lo, hi = bounds[:-1], bounds[1:]
    residuals = np.zeros(len(offsets), np.int8)
    found = []
    while len(lo):
        size = hi - lo
        run = np.maximum(size - 1, 1)
        rise = offsets[hi - 1] - offsets[lo]
        first = np.cumsum(size) - size
        steps = np.arange(size.sum()) - np.repeat(first, size)
        members = np.repeat(lo, size) + steps
        line = _line(np.repeat(offsets[lo], size), np.repeat(rise, size), np.repeat(run, size), steps)
        missed = offsets[members] - line
        most, least = np.maximum.reduceat(missed, first), np.minimum.reduceat(missed, first)
        shift = (most + least) // 2
        good = np.maximum(most - shift, shift - least) <= error
        kept = np.repeat(good, size)
        residuals[members[kept]] = (missed - np.repeat(shift, size))[kept]
        found.append(np.stack([lo, offsets[lo] + shift, rise, run])[:, good])
        lo, hi = lo[~good], hi[~good]
        half = (lo + hi) // 2
        lo, hi = np.concatenate([lo, half]), np.concatenate([half, hi])
    segments = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
    segments = segments[:, np.argsort(segments[0])]
    return RankIndex(*segments, residuals)


def boundaries(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in code points of all token boundaries (0 first), and where each text's begin.

    A token ends where a word does; spaces after the last word are one more token.
    """
    _, end = words_of(text)
    words = np.searchsorted(end, text.offsets, "right")  # a word's end is past its text's begin
    last = np.where(np.diff(words) > 0, end[np.maximum(words[1:], 1) - 1] if len(end) else 0, text.offsets[:-1])
    spaces = last < text.offsets[1:]
    bounds = np.zeros(len(text.offsets), np.int64)
    np.cumsum(1 + np.diff(words) + spaces, out=bounds[1:])
    marks = np.empty(bounds[-1], np.int64)
    marks[bounds[:-1]] = text.offsets[:-1]
    owner = np.repeat(np.arange(len(words) - 1), np.diff(words))
    marks[bounds[owner] + 1 + np.arange(len(end)) - words[owner]] = end
    marks[bounds[1:][spaces] - 1] = text.offsets[1:][spaces]
    points = np.zeros(len(text.data) + 1, np.int64)
    np.cumsum((text.data & 0xC0) != 0x80, out=points[1:])
    return points[marks] - np.repeat(points[text.offsets[:-1]], np.diff(bounds)), bounds


def cuts(texts: pa.Array, draws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and its two cuts in code points, the smaller first, after ``draw % (tokens + 1)`` tokens."""
    offsets, bounds = boundaries(text_of(texts))
    index = fitted(offsets, bounds)
    tokens = np.diff(bounds) - 1
    places = [index.offsets(bounds[:-1] + draw % (tokens + 1)) for draw in draws]
    return tokens, np.minimum(*places), np.maximum(*places)


def transformed(docs: DataFrame, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n`` (tokens), ``form`` (plain, spm or psm), ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    Null text counts as empty. What is cut where follows from the id alone, so rows with the same
    id and text come out alike; a missing id counts as an empty one. Long texts are cut whole. Only
    ``doc_id`` and ``text`` are read, whatever other columns there are. No rows, no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            draws = [batch.column(name).to_numpy() for name in ("h1", "h2")]
            n, first, second = cuts(batch.column("text"), draws)
            added = [pa.array(n), pa.array(first.astype(np.int32)), pa.array((second - first).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "n", "a", "b"])

    ready = docs.select("doc_id", text, *numbers)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields)
    cut = ready.mapInArrow(run, f"{kinds}, n long, a int, b int")
    marked = [F.contains("text", F.lit(mark)) for mark in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("text") == "") | marked[0] | marked[1] | marked[2] | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rest = F.lit(2**31 - 1)
    prefix = F.substring("text", F.lit(1), F.col("a"))
    middle = F.substring("text", F.col("a") + 1, F.col("b"))
    suffix = F.substring("text", F.col("a") + F.col("b") + 1, rest)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = cut.withColumn("form", form)
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.when(F.col("form") != "plain", F.col("a")).cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("b")).cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: a mark's first place is where it was put, as no text with a mark is cut."""

    def part(after: str, before: str | None) -> Column:
        begin = F.instr(output, after) + len(after)
        size = F.instr(output, before) - begin if before else F.lit(2**31 - 1)
        return F.substring(output, begin, size)

    middle = part(MIDDLE, None)
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
