"""Language of texts, and of their parts where languages mix.

The script of a word's letters narrows the languages it can be in; hashed letter n-grams, counted
per language over all labelled documents, give each word a score per language; and the Viterbi
path through a text's words, with a penalty for every switch, labels spans. A text's language is
the one with most letters in its spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapevine.llm import words as W

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)  # bytes of an n-gram, the space on both sides of a word included
PENALTY = 10.0  # natural logarithm of the odds against a switch
LEAST_SHARE = 0.01  # of a language's letters in a script, for the script to point to it
UNKNOWN = "und"

# First and last code point of the blocks of a script's letters.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]
_LAST = np.array([last for _, _, last in sorted(SCRIPTS, key=lambda s: s[1])])
_FIRST = np.array([first for _, first, _ in sorted(SCRIPTS, key=lambda s: s[1])])
_INDEX = np.array([SCRIPT_NAMES.index(name) for name, _, _ in sorted(SCRIPTS, key=lambda s: s[1])])


def letters_of(entries: W.Text) -> tuple[np.ndarray, np.ndarray]:
    """By word: number of letters, and script of the first letter (-1 without one)."""
    n = len(entries.offsets) - 1
    points = np.frombuffer(entries.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first_bytes = np.flatnonzero((entries.data & 0xC0) != 0x80)
    owner = np.searchsorted(entries.offsets, first_bytes, "right") - 1
    distinct, which = np.unique(points, return_inverse=True)
    letter = np.array([chr(p).isalpha() for p in distinct.tolist()], bool)[which]
    place = np.searchsorted(_LAST, distinct)
    inside = np.append(_FIRST, 1 << 32)[place] <= distinct
    script = np.where(inside, np.append(_INDEX, 0)[place], len(SCRIPT_NAMES) - 1)[which]
    owner, script = owner[letter], script[letter]
    out = np.full(n, -1, np.int64)
    out[owner[::-1]] = script[::-1]
    return np.bincount(owner, minlength=n), out


def grams_of(entries: W.Text) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every n-gram of every word."""
    n, sizes = len(entries.offsets) - 1, np.diff(entries.offsets)
    offsets = entries.offsets + 2 * np.arange(n + 1)
    data = np.full(offsets[-1], 32, np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    data[np.arange(len(owner)) + 2 * owner + 1] = entries.data
    owner, sums = np.repeat(np.arange(n), sizes + 2), W.prefix_sums(data)
    ends, here = offsets[owner + 1], np.arange(len(data))
    owners, buckets = [], []
    for order in ORDERS:
        whole = np.flatnonzero(here + order <= ends)
        owners.append(owner[whole])
        hashes = W.span_hashes(sums, whole, whole + order)
        buckets.append((hashes % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def _entry_slices(entries: W.Text, most: int = 1 << 18) -> Iterator[tuple[int, W.Text]]:
    for lo, hi in W.ranges(np.diff(entries.offsets), most):
        base = entries.offsets[lo]
        yield lo, W.Text(entries.data[base : entries.offsets[hi]], entries.offsets[lo : hi + 1] - base)


@dataclass
class Model:
    """Languages in alphabetic order, log-probability of each bucket, and which scripts point to which."""

    languages: list[str]
    log_p: np.ndarray
    candidates: np.ndarray

    def word_scores(self, entries: W.Text) -> tuple[np.ndarray, np.ndarray]:
        """By word: a score per language (nil where the script points to none), and the number of letters."""
        count = len(entries.offsets) - 1
        scores, letters = np.zeros((count, len(self.languages)), np.float32), np.zeros(count, np.int64)
        for lo, part in _entry_slices(entries):
            n = len(part.offsets) - 1
            letters[lo : lo + n], script = letters_of(part)
            owner, bucket = grams_of(part)
            own = np.stack([np.bincount(owner, lp[bucket], n) for lp in self.log_p], 1) / len(ORDERS)
            can = self.candidates[script] & (script >= 0)[:, None]
            # Outside its script's languages a word is worth less than in the worst of them.
            worst = np.where(can, own, np.inf).min(1, keepdims=True)
            own = np.where(can, own, worst - PENALTY)
            scores[lo : lo + n] = np.where(can.any(1, keepdims=True), own, 0)
        return scores, letters

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Label of every word, its scores, its number of letters, and where each text's words begin."""
        vocabulary = W.vocabulary_of(W.text_of(texts, lower=True))
        scores, letters = self.word_scores(vocabulary.entries)
        scores = scores[vocabulary.codes]
        return viterbi(scores, vocabulary.bounds, PENALTY), scores, letters[vocabulary.codes], vocabulary.bounds

    def predict(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Language and score by text. The score is the share of the letters in that language's
        spans, times the odds of that language over the others in these spans."""
        n, width = len(texts), len(self.languages)
        if not width:
            return {"lang_pred": pa.array([UNKNOWN] * n, pa.string()), "score": pa.array(np.zeros(n))}
        labels, scores, letters, bounds = self.spans(texts)
        rows = np.repeat(np.arange(n), np.diff(bounds))
        by = np.bincount(rows * width + labels, letters, n * width).reshape(n, width)
        total, best = by.sum(1), by.argmax(1)
        inside = labels == best[rows]
        sums = np.stack([np.bincount(rows[inside], scores[inside, k], n) for k in range(width)], 1)
        odds = np.exp(np.clip(sums - sums[np.arange(n), best][:, None], -60, 60)).sum(1)
        score = np.where(total > 0, by[np.arange(n), best] / np.maximum(total, 1) / np.maximum(odds, 1), 0.0)
        names = np.array([*self.languages, UNKNOWN], object)[np.where(total > 0, best, width)]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score)}


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word of every text; all texts go forward one word at a time together.

    Of equal paths the one that stays, or else the first label, is taken.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    labels = np.zeros(len(scores), np.int64)
    longest = int(sizes.max(initial=0))
    if not longest:
        return labels
    running = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with a word at each step
    switched = np.zeros(scores.shape, bool)
    came = np.zeros(len(scores), np.uint16)
    value = scores[starts[: running[0]]].astype(np.float64)
    last = np.empty(running[0], np.int64)
    for step in range(1, longest):
        n = running[step]
        last[n : len(value)] = value[n:].argmax(1)
        value = value[:n]
        at = starts[:n] + step
        best = value.argmax(1)
        moved = value[np.arange(n), best] - penalty
        leave = value < moved[:, None]
        came[at], switched[at] = best, leave
        value = np.where(leave, moved[:, None], value) + scores[at]
    last[: len(value)] = value.argmax(1)
    now = last[: running[-1]]
    for step in range(longest - 1, 0, -1):
        n = running[step]
        now = np.concatenate([now, last[len(now) : n]])
        at = starts[:n] + step
        labels[at] = now
        now = np.where(switched[at, now], came[at], now)
    now = np.concatenate([now, last[len(now) :]])
    labels[starts[: len(now)]] = now
    return labels


def fit(docs: DataFrame, learn: Column) -> Model:
    """The model of all documents with a language for which ``learn`` (over ``doc_id``) holds.

    Each task sums n-grams over its documents; what comes together has a row per language and
    bucket that was seen, whatever the number of documents.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in W.blocks(batches, "text", 16 << 20):
            vocabulary = W.vocabulary_of(W.text_of(block.column("text"), lower=True))
            langs = block.column("lang").dictionary_encode()
            rows = np.repeat(langs.indices.to_numpy(), np.diff(vocabulary.bounds))
            names, n = langs.dictionary.to_pylist(), len(vocabulary.hashes)
            counts = [np.bincount(vocabulary.codes[rows == k], minlength=n) for k in range(len(names))]
            for lo, part in _entry_slices(vocabulary.entries):
                letters, script = letters_of(part)
                owner, bucket = grams_of(part)
                for name, of_word in zip(names, counts, strict=True):
                    times = of_word[lo : lo + len(letters)]
                    own = sums.setdefault(name, np.zeros(BUCKETS + len(SCRIPT_NAMES)))
                    own[:BUCKETS] += np.bincount(bucket, times[owner], BUCKETS)
                    real = script >= 0
                    own[BUCKETS:] += np.bincount(script[real], (times * letters)[real], len(SCRIPT_NAMES))
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])],
                names=["lang", "at", "times"],
            )

    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    parts = seen.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(
        counted, "lang string, at long, times double"
    )
    table = parts.groupBy("lang", "at").agg(F.sum("times").alias("times")).toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    sums = np.zeros((len(names), BUCKETS + len(SCRIPT_NAMES)))
    which = np.searchsorted(np.array(names, object), np.array(table["lang"].to_pylist(), object)) if names else []
    sums[which, table["at"].to_numpy()] = table["times"].to_numpy()
    grams, scripts = sums[:, :BUCKETS] + 0.5, sums[:, BUCKETS:]
    log_p = np.log(grams / grams.sum(1, keepdims=True))
    candidates = scripts.T >= LEAST_SHARE * np.maximum(scripts.sum(1), 1)
    return Model(names, log_p, candidates)


def labelled(docs: DataFrame, model: Model, *others: str) -> DataFrame:
    """``lang_pred`` and ``score`` of every document, beside the columns named.

    A text that is null or has no letter is ``und`` with score 0; equal languages go to the first
    name. Rows that repeat are judged each; without a labelled document every text is ``und``.
    """
    from grapevine.llm.rows import with_columns

    most = max(1 << 20, (64 << 20) // max(4, len(model.languages)))
    out = with_columns(docs.select(*others, "text"), "text", "lang_pred string, score double", model.predict, most)
    return out.drop("text")


def span_table(docs: DataFrame, model: Model) -> DataFrame:
    """Spans of one language: ``doc_id``, ``first_word``, ``n_words``, ``span_lang``, in the order of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "text", 4 << 20):
            labels, _, _, bounds = model.spans(block.column("text"))
            rows = np.repeat(np.arange(len(block)), np.diff(bounds))
            if not len(rows):
                continue
            new = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (rows[1:] != rows[:-1])))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").take(pa.array(rows[new])),
                    pa.array(new - bounds[rows[new]]),
                    pa.array(np.diff(np.append(new, len(rows)))),
                    pa.array(np.array(model.languages, object)[labels[new]], pa.string()),
                ],
                names=["doc_id", "first_word", "n_words", "span_lang"],
            )

    schema = f"doc_id {kind}, first_word long, n_words long, span_lang string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
