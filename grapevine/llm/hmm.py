"""Hidden Markov language model over whole texts.

A text is its words and then one end. A word belongs to a class: words of up to ``ENDING`` bytes
by themselves, longer ones by their last bytes, hashed into ``CLASSES`` numbers. Hidden states emit
classes, and a class emits its words by their training counts, with one more for all unseen ones:
``log10 P(text) = log10 P(class sequence) + sum of log10 P(word | class)``.

Documents are read once into blocks (a row of some megabytes: the words' numbers in the block's
own vocabulary). Counts of a word meet by its hash, one row for each block that has it, and go
back to the blocks. Baum-Welch counts are summed over all training text in every round, until its
log-likelihood hardly rises; what a round brings together is a row per class and task. The scaled forward recursion then scores
every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grapevine.llm import words as W
from grapevine.operators import skew
from grapevine.session import Workspace

STATES = 8
CLASSES = 1 << 14
ENDING = 4
END = 0  # class of the end of a text; no word has it
STRETCH = 512  # words of a training sequence; longer texts train in several
GAIN = 1e-3  # rounds over all text end with the first that raises its log-likelihood by a smaller share
WARM_STRETCHES = 400  # stretches that the rounds before are made on, to find the states
WARM_BLOCKS = 1600  # blocks they are drawn from, about
WARM_ROUNDS = 15
BLOCK = 16 << 20


@dataclass
class Model:
    """First and stationary state probabilities, transitions, and emissions by class."""

    first: np.ndarray
    steps: np.ndarray
    emits: np.ndarray

    @property
    def stationary(self) -> np.ndarray:
        p = np.full(len(self.first), 1 / len(self.first))
        for _ in range(50):
            p = p @ self.steps
        return p / p.sum()


def start(share: np.ndarray, seed: int = 11) -> Model:
    """States that stay, and emit the classes' shares, disturbed."""
    k = STATES
    steps = np.full((k, k), 0.1 / (k - 1)) + np.eye(k) * (0.9 - 0.1 / (k - 1))
    noise = np.random.default_rng(seed).gamma(2.0, 0.5, (len(share), k))
    emits = share[:, None] * noise
    return Model(np.full(k, 1 / k), steps, emits / emits.sum(0))


def _running(sizes: np.ndarray) -> np.ndarray:
    """Of sequences sorted by falling size, how many have a word at each step."""
    return np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")


def log_likelihood(model: Model, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural logarithm of each sequence's probability by the scaled forward recursion."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, running = bounds[:-1][order], _running(sizes[order])
    total = np.zeros(len(sizes))
    state = np.broadcast_to(model.first, (len(sizes), len(model.first)))
    for step, n in enumerate(running.tolist()):
        state = (state[:n] if step == 0 else state[:n] @ model.steps) * model.emits[classes[starts[:n] + step]]
        scale = state.sum(1)
        total[:n] += np.log(scale)
        state /= scale[:, None]
    out = np.empty(len(sizes))
    out[order] = total
    return out


def expected_counts(model: Model, classes: np.ndarray, bounds: np.ndarray, opens: np.ndarray) -> tuple:
    """Expected first states, transitions and emissions over some sequences, and their log-likelihood.

    ``opens`` tells which sequences begin a text; the others begin with the stationary distribution.
    """
    k = len(model.first)
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, running, opens = bounds[:-1][order], _running(sizes[order]), opens[order]
    alpha, scales = np.empty((len(classes), k)), np.empty(len(classes))
    state = np.where(opens[:, None], model.first, model.stationary)
    for step, n in enumerate(running.tolist()):
        at = starts[:n] + step
        state = (state[:n] if step == 0 else state[:n] @ model.steps) * model.emits[classes[at]]
        scales[at] = scale = state.sum(1)
        state /= scale[:, None]
        alpha[at] = state
    steps = np.zeros((k, k))
    beta = np.ones((int(running[-1]) if len(running) else 0, k))
    gamma = alpha  # overwritten from the end
    for step in range(len(running) - 1, 0, -1):
        n = int(running[step])
        beta = np.concatenate([beta, np.ones((n - len(beta), k))])
        at = starts[:n] + step
        ahead = model.emits[classes[at]] * beta / scales[at][:, None]
        steps += alpha[at - 1].T @ ahead
        gamma[at] *= beta
        beta = ahead @ model.steps.T
    beta = np.concatenate([beta, np.ones((len(starts) - len(beta), k))])
    if len(running):
        gamma[starts] *= beta
    emits = np.stack([np.bincount(classes, gamma[:, s], CLASSES) for s in range(k)], 1)
    return gamma[starts[opens]].sum(0), steps * model.steps, emits, float(np.log(scales).sum())


def improved(first: np.ndarray, steps: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Model:
    """The model of expected counts, smoothed towards the classes' shares."""
    first, steps, emits = first + 0.1, steps + 0.1, emits + 20 * share[:, None]
    return Model(first / first.sum(), steps / steps.sum(1, keepdims=True), emits / emits.sum(0))


def _classes(text: W.Text, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of each entry: 1 to CLASSES - 1."""
    last = np.maximum(begin, end - ENDING)
    sums = W.prefix_sums(text.data)
    # A word that is longer than its ending never shares a class with the word that is the ending.
    hashes = W.mixed(W.span_hashes(sums, last, end) + (last > begin).astype(np.uint64))
    return (hashes % np.uint64(CLASSES - 1)).astype(np.int64) + 1


_BLOCKS = (
    "block long, doc_id array<{kind}>, sizes array<int>, held_out array<boolean>, numbers binary, "
    "hash array<long>, class array<int>, times array<int>"
)


def blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per block of documents. Write it before use.

    ``numbers`` has the words of the block as numbers in its vocabulary (``hash``, ``class`` and
    ``times``: the count in the texts that are not held out), sorted from the most frequent on, by
    byte plane. The end of a text is not stored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in W.blocks(batches, "text", BLOCK):
            text = W.text_of(batch.column("text"), lower=True)
            vocabulary = W.vocabulary_of(text)
            n, sizes = len(vocabulary.hashes), np.diff(vocabulary.bounds)
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            order = np.argsort(-np.bincount(vocabulary.codes, minlength=n), kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            codes = rank[vocabulary.codes]
            times = np.bincount(codes[~np.repeat(held, sizes)], minlength=n)
            entries = vocabulary.entries
            classes = _classes(entries, entries.offsets[:-1], entries.offsets[1:])[order]
            made = {
                "block": pa.array([number]),
                "doc_id": _one_list(batch.column("doc_id")),
                "sizes": _one_list(pa.array(sizes.astype(np.int32))),
                "held_out": _one_list(batch.column("held_out")),
                "numbers": pa.array([codes.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary()),
                "hash": _one_list(pa.array(vocabulary.hashes[order].view(np.int64))),
                "class": _one_list(pa.array(classes.astype(np.int32))),
                "times": _one_list(pa.array(times.astype(np.int32))),
            }
            yield pa.RecordBatch.from_arrays([*made.values()], names=[*made])
            number += 1

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, _BLOCKS.format(kind=kind))


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)


def _list(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def _with_ends(classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences with their ends, and where each begins."""
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(bounds[-1], END, np.int64)
    word = np.ones(bounds[-1], bool)
    word[bounds[1:] - 1] = False
    out[word] = classes
    return out, bounds


def _training_sequences(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class sequences of the training texts in stretches: classes, bounds, and which begin a text."""
    sizes, held = _list(batch, "sizes", row).astype(np.int64), _list(batch, "held_out", row)
    codes = _numbers(batch.column("numbers")[row].as_py())[~np.repeat(held, sizes)]
    classes, bounds = _with_ends(_list(batch, "class", row).astype(np.int64)[codes], sizes[~held])
    sizes = np.diff(bounds)
    pieces = -(-sizes // STRETCH)
    which = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(bounds[:-1], pieces) + which * STRETCH
    return classes, np.append(starts, bounds[-1]), which == 0


def warm_stretches(read: DataFrame) -> list[np.ndarray]:
    """At most WARM_STRETCHES stretches, short texts among them, drawn by a hash of their classes.

    They come from about WARM_BLOCKS blocks at most, drawn by a hash of their number, and a block offers its
    share of four times as many: what reaches the driver does not grow with the input.
    """
    n = read.count()
    share = min(1.0, WARM_BLOCKS / max(1, n))
    offered = min(WARM_STRETCHES, -(-4 * WARM_STRETCHES // max(1, min(n, WARM_BLOCKS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                classes, bounds, _ = _training_sequences(batch, row)
                number = np.arange(len(bounds) - 1)
                turns = W.mixed(classes[bounds[:-1]].astype(np.uint64) + number.astype(np.uint64) * np.uint64(2654435761))
                drawn = np.argsort(turns, kind="stable")[:offered]
                texts = [classes[bounds[i] : bounds[i + 1]].astype(np.uint16).tobytes() for i in drawn.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(turns[drawn].view(np.int64)), pa.array(texts, pa.binary())], names=["turn", "classes"]
                )

    some = read.where(F.pmod(F.xxhash64("block"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    drawn = some.select("sizes", "held_out", "numbers", "class").mapInArrow(run, "turn long, classes binary")
    found = drawn.orderBy("turn", "classes").limit(WARM_STRETCHES).collect()
    return [np.frombuffer(r.classes, np.uint16).astype(np.int64) for r in found]


def _warmed(model: Model, stretches: list[np.ndarray], share: np.ndarray) -> Model:
    if not stretches:
        return model
    classes = np.concatenate(stretches)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in stretches])])
    for _ in range(WARM_ROUNDS):
        first, steps, emits, _ = expected_counts(model, classes, bounds, np.ones(len(stretches), bool))
        model = improved(first, steps, emits, share)
    return model


def _one_round(read: DataFrame, model: Model, share: np.ndarray) -> tuple[Model, float]:
    """A better model by the Baum-Welch counts of all training texts, summed by task and then by class, and
    the log-likelihood of these texts by the given one."""
    k = STATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        total = np.zeros((1, k))
        for batch in batches:
            for row in range(len(batch)):
                classes, bounds, opens = _training_sequences(batch, row)
                for lo, hi in W.ranges(np.diff(bounds), 1 << 18):
                    own = classes[bounds[lo] : bounds[hi]]
                    a, b, c, likely = expected_counts(model, own, bounds[lo : hi + 1] - bounds[lo], opens[lo:hi])
                    first, steps, emits = first + a, steps + b, emits + c
                    total[0, 0] += likely
        table = np.concatenate([emits, steps, first[None], total])
        at = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), *[pa.array(table[at, s]) for s in range(k)]],
            names=["at", *[f"s{s}" for s in range(k)]],
        )

    schema = "at long, " + ", ".join(f"s{s} double" for s in range(k))
    counted = read.select("sizes", "held_out", "numbers", "class").mapInArrow(run, schema)
    sums = counted.groupBy("at").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).toArrow()
    table = np.zeros((CLASSES + k + 2, k))
    table[sums["at"].to_numpy()] = np.stack([sums[f"s{s}"].to_numpy() for s in range(k)], 1)
    model = improved(table[CLASSES + k], table[CLASSES : CLASSES + k], table[:CLASSES], share)
    return model, float(table[-1, 0])


def fitted(read: DataFrame, model: Model, share: np.ndarray) -> Model:
    """The model after rounds over all training text, the last of which hardly raised its log-likelihood."""
    before = -np.inf
    while True:
        model, total = _one_round(read, model, share)
        if total - before < GAIN * abs(total):
            return model
        before = total


def _counted(entries: DataFrame, n_blocks: int, workspace: Workspace) -> DataFrame:
    """Every entry (``block``, ``place``, ``class``) with its word's ``count``; ``once`` marks one entry of each word.

    A word has at most a row per block, however often it occurs. With no more blocks than the rows
    that a key may have, no word is hot, and a window counts; else words are summed before the
    shuffle, and the sums go back in a join that deals the rows of the words in most blocks over tasks.
    """
    first = F.struct("block", "place")
    if n_blocks <= skew.HOT_ROWS:
        of_word = Window.partitionBy("hash")
        once = F.row_number().over(of_word.orderBy("block", "place")) == 1
        return entries.select("block", "place", "class", F.sum("times").over(of_word).alias("count"), once.alias("once"))
    sums = entries.groupBy("hash").agg(F.sum("times").alias("count"), F.min(first).alias("first"))
    probe = skew.Probe(entries.select("hash"), ["hash"])
    joined = skew.balanced_join(entries, workspace.keep(sums, "sums"), ["hash"], ["block", "place"], probe)
    return joined.select("block", "place", "class", "count", (first == F.col("first")).alias("once"))


def scored(docs: DataFrame, held_out: Column, workspace: Workspace) -> DataFrame:
    """Every document's ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    A null text counts as empty: one token, its end. Rows that repeat train and score each. With
    nothing to learn from, every word is unknown; without documents there is no row. Texts of any
    length are scored whole. Only ``doc_id``, ``text`` and what ``held_out`` names are read; other
    columns may be called anything.
    """
    read = workspace.keep(blocks(docs, held_out), "blocks")
    entries = read.select("block", F.posexplode(F.arrays_zip("hash", "class", "times")).alias("place", "entry"))
    entries = entries.select("block", "place", "entry.*")
    counts = workspace.keep(_counted(entries, read.count(), workspace), "counts")
    table = (
        counts.where("once and count > 0")
        .groupBy("class")
        .agg(F.sum("count").alias("tokens"), F.count("*").alias("words"))
        .toArrow()
    )
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    tokens[table["class"].to_numpy()] = table["tokens"].to_numpy()
    words[table["class"].to_numpy()] = table["words"].to_numpy()
    texts = read.select(F.explode(F.filter("held_out", lambda h: ~h))).count()
    tokens[END], words[END] = texts, int(texts > 0)
    n, v = int(tokens.sum()), int(words.sum())
    share = (tokens + 1) / (n + CLASSES)

    model = _warmed(start(share), warm_stretches(read) if n else [], share)
    model = fitted(read, model, share) if n else model

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = counts.groupBy("block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "count"))), lambda x: x["count"]).alias("count")
    )
    whole = read.drop("hash", "times").join(given, "block", "left")
    logs = np.log10(tokens + words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                sizes = _list(batch, "sizes", row).astype(np.int64)
                codes = _numbers(batch.column("numbers")[row].as_py())
                classes = _list(batch, "class", row).astype(np.int64)
                found = _list(batch, "count", row).astype(np.float64) if len(classes) else np.zeros(0)
                texts = np.repeat(np.arange(len(sizes)), sizes)
                add = lambda by_entry: np.bincount(texts, by_entry[codes], len(sizes))  # noqa: E731, B023
                plain = add(np.log10(found + 1)) + np.log10(tokens[END] + 1) - (sizes + 1) * np.log10(n + v + 1)
                inside = add(np.log10(found + 1) - logs[classes])
                sequence, bounds = _with_ends(classes[codes], sizes)
                hidden = log_likelihood(model, sequence, bounds) / np.log(10)
                known = add((found > 0).astype(float)).astype(np.int64) + int(tokens[END] > 0)
                made = {
                    "doc_id": batch.column("doc_id")[row].values,
                    "held_out": batch.column("held_out")[row].values,
                    "n_tokens": pa.array(sizes + 1),
                    "n_known": pa.array(known),
                    "train_tokens": pa.array(np.full(len(sizes), n)),
                    "base_score": pa.array(plain),
                    "score": pa.array(hidden + inside),
                }
                yield pa.RecordBatch.from_arrays([*made.values()], names=[*made])

    return whole.mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
