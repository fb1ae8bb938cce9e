"""Word shingles of whole texts, and fast similarity sketches of their sets."""

from __future__ import annotations

import numpy as np

from grapevine.llm import words as W

WORDS = 5
COORDINATES = 128
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: W.Text) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, and where each text's begin.

    A shingle is five words in a row; a text of fewer words is one shingle, one without words none.
    """
    begin, _, hashes = W.hashed_words(text)
    bounds = W.word_counts(text, begin)
    counts = np.diff(bounds)
    n = len(counts)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    last = max(0, len(hashes) - WORDS + 1)
    windows = np.zeros(last, np.uint64)
    for k in range(WORDS):
        windows = windows * _A + hashes[k : k + last]
    rows = np.repeat(np.arange(n), counts)
    whole = np.flatnonzero(rows[:last] == rows[WORDS - 1 :]) if last else np.zeros(0, np.int64)
    found, owner = W.mixed(windows[whole]), rows[whole]
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    alone = np.zeros(len(short), np.uint64)
    for k in range(WORDS - 1):
        has = counts[short] > k
        alone[has] = alone[has] * _A + hashes[bounds[short[has]] + k]
    found = np.concatenate([found, W.mixed(alone + counts[short].astype(np.uint64) * _B)])
    owner = np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(n + 1))


def sketch(sets: np.ndarray, bounds: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """A row of ``size`` numbers for each set; two rows agree in about the share of the sets' Jaccard index.

    Rounds of bin placement: in each of the first ``size`` rounds every element is thrown into a
    random bin with a random number, rounds counting first; in round ``size + j`` all are thrown
    into bin j, so every bin fills. A bin keeps its least number. A set whose bins are full is
    done, as later rounds hold larger numbers only: about ``n + size log size`` throws for n elements.
    An empty set's row is nil.
    """
    n = len(bounds) - 1
    out = np.full(n * size, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    bits, mask = np.uint64(48), np.uint64((1 << 48) - 1)
    elements = sets
    salts = np.arange(1, 2 * size + 1, dtype=np.uint64) * _B
    for turn in range(2 * size):
        thrown = W.mixed(elements + salts[turn])
        if turn < size:
            at = (W.mixed(thrown + _A) % np.uint64(size)).astype(np.int64)
        else:
            at = np.full(len(elements), turn - size)
        np.minimum.at(out, owner * size + at, (np.uint64(turn) << bits) | (thrown & mask))
        empty = (out.reshape(n, size) == np.iinfo(np.uint64).max).any(1)
        going = empty[owner]
        if not going.any():
            break
        elements, owner = elements[going], owner[going]
    out = out.reshape(n, size)
    out[np.diff(bounds) == 0] = 0
    return out


def band_keys(rows: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` numbers of a sketch, different from band to band."""
    n, size = rows.shape
    bands = rows.reshape(n, size // width, width)
    keys = np.arange(1, size // width + 1, dtype=np.uint64)[None, :] * _B
    for k in range(width):
        keys = W.mixed(keys * _A + bands[:, :, k])
    return keys


def set_digests(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    out = []
    for salt in (_A, _B):
        sums = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(W.mixed(sets ^ salt), out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]
