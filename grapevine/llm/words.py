"""Words of whole texts as numpy arrays, read from Arrow's string buffers without a Python object per word.

A word is named by a 64-bit hash of its bytes; two of a billion different words share one with a
chance of about three in a hundred.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at a time. The arrays over a block take up to a hundred times as much, and what a
#: worker process has taken once it keeps in part for the steps after it.
BLOCK = 1 << 20
SPACES = b" \t\n\v\f\r"
SPACE, SYMBOL, LETTER = 0, 1, 2
#: By byte: space or not.
BLANK_OR_WORD = np.full(256, LETTER, np.uint8)
BLANK_OR_WORD[list(SPACES)] = SPACE
#: By byte: space, letter or digit (all of a non-ASCII character counts as one), or another sign.
LETTERS_APART = np.array(
    [SPACE if b in SPACES else LETTER if b >= 128 or chr(b).isalnum() else SYMBOL for b in range(256)], np.uint8
)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_MIX = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []


class Text(NamedTuple):
    """Bytes of some texts, one after the other, and where each begins (one entry more than texts)."""

    data: np.ndarray
    offsets: np.ndarray


class Vocabulary(NamedTuple):
    """Words of some texts: the entry of each word in turn, where each text's words begin, and the entries."""

    codes: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    entries: Text


def text_of(texts: pa.Array, lower: bool = False) -> Text:
    """A null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bytes_ = texts.buffers()[2]
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return Text(LOWER[data] if lower else data, offsets - offsets[0])


def ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` in total size; a larger row stands alone."""
    begun, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield begun, row
            begun, total = row, 0
        total += size
    if begun < len(sizes):
        yield begun, len(sizes)


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Record batches whose texts have at most ``most`` bytes in total, in the order of the rows."""
    for batch in batches:
        sizes = np.diff(text_of(batch.column(column)).offsets)
        for lo, hi in ranges(sizes, most):
            yield batch.slice(lo, hi - lo)


def words_of(text: Text, classes: np.ndarray = BLANK_OR_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes of one class, spaces left out. No run passes a text's end."""
    kind = classes[text.data]
    edge = np.empty(len(kind) + 1, bool)
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[text.offsets] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    real = kind[begin] != SPACE
    return begin[real], end[real]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 20, 1 << n.bit_length())
        _powers.clear()
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, out=table))
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    powers, _ = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MIX[data] * powers[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each begin to its end, the same wherever the bytes stand."""
    _, inverse = _power_tables(len(sums))
    return mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def word_counts(text: Text, begin: np.ndarray) -> np.ndarray:
    """Where each text's words begin in ``begin``: one entry more than texts."""
    return np.searchsorted(begin, text.offsets)


def entries_of(text: Text, begin: np.ndarray, end: np.ndarray) -> Text:
    """Copies of the given spans, one after the other."""
    sizes = end - begin
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    places = np.repeat(begin - offsets[:-1], sizes) + np.arange(offsets[-1])
    return Text(text.data[places], offsets)


def strings_of(entries: Text) -> list[str]:
    raw, at = entries.data.tobytes(), entries.offsets.tolist()
    return [raw[a:b].decode("utf-8") for a, b in zip(at, at[1:])]


SLICE = 1 << 19  # bytes that are hashed at a time, so that the arrays stay in the processor's cache


def spans_in_slices(text: Text, find) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First text, begin, end and hashes of the spans that ``find`` gives, for a slice of the texts at a time."""
    for lo, hi in ranges(np.diff(text.offsets), SLICE):
        base = text.offsets[lo]
        part = Text(text.data[base : text.offsets[hi]], text.offsets[lo : hi + 1] - base)
        begin, end = find(part)
        yield lo, begin + base, end + base, span_hashes(prefix_sums(part.data), begin, end)


def hashed_words(text: Text, find=words_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of all words."""
    parts = list(spans_in_slices(text, find))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))


def factorized(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each hash in turn, and where each entry occurs first."""
    import pandas as pd

    codes, _ = pd.factorize(hashes)
    first = np.empty(codes.max(initial=-1) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def vocabulary_of(text: Text, find=words_of) -> Vocabulary:
    begin, end, hashes = hashed_words(text, find)
    codes, first = factorized(hashes)
    return Vocabulary(codes, word_counts(text, begin), hashes[first], entries_of(text, begin[first], end[first]))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values from each bound to the next."""
    sums = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64 if values.dtype.kind in "biu" else float))
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated_within(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By value: whether it occurs in its row again, and whether it occurred there before (in sorting order)."""
    keys = hashes + mixed(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return again, before
