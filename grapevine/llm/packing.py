"""Packing by lexical retrieval: sequences of a fixed length whose documents resemble each other.

Documents are tokenised once and dealt into shards of some million tokens, in the order of several
min-hashes of their tokens, in which a token counts by its rarity, so that documents with rare tokens
in common meet. Neighbours are looked up inside a shard. It has an inverted BM25 index with the document frequencies of the whole corpus. The largest unused
document is a seed; the index returns its unused neighbours, best first, and those that fit fill
the window; the best that does not fit is cut to fill the rest, and its other part stays unused.
What a document holds in whole windows stands alone. A window that a shard cannot fill goes on
in the next one; the last of a task is cut into sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapevine.llm import words as W
from grapevine.llm.rows import in_arrow, numbered
from grapevine.session import Workspace

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 1 << 21
ROUTES, ROUTE_BITS = 3, 21  # min-hashes that shards are made by, and bits of each
K1, B = 1.2, 0.75
BLOCK = 4 << 20  # bytes of text tokenised at a time; what is done for each block is the less, the fewer there are
COMMON = 4  # a term in over a COMMON-th of a shard's pieces has a row in its index
REBUILT = 0.8  # share of live pieces at which used ones leave an index; changes no score
_MARK = "`"
# The pattern by which the tokenizer that lower-cases and marks word ends splits texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"

_SPACE, _LETTER, _DIGIT, _SYMBOL, _APOSTROPHE, _OTHER = range(6)


def _class_of(byte: int) -> int:
    if byte in W.SPACES:
        return _SPACE
    if byte >= 128:
        return _OTHER
    sign = chr(byte)
    return _LETTER if sign.isalpha() else _DIGIT if sign.isdigit() else _APOSTROPHE if sign == "'" else _SYMBOL


_CLASSES = np.array([_class_of(b) for b in range(256)], np.uint8)
#: By class of a byte and of the next one: whether the pattern surely parts them. Signs and apostrophes may match
#: as one, as may an apostrophe and the letters after it, and other characters (marks, say) with anything.
_PARTS = ~np.eye(6, dtype=bool)
_PARTS[_OTHER, 1:] = _PARTS[1:, _OTHER] = False
_PARTS[_SYMBOL, _APOSTROPHE] = _PARTS[_APOSTROPHE, _SYMBOL] = _PARTS[_APOSTROPHE, _LETTER] = False


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte; the letters from U+00C0 to U+00FF are letters with both their bytes."""
    classes = _CLASSES[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of times and division
    classes[lead] = classes[lead + 1] = _LETTER
    return classes


def pieces_of(text: W.Text) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the pieces of words that ``_PATTERN`` surely parts. No piece passes a text's end."""
    if not len(text.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes = _byte_classes(text.data)
    edge = np.ones(len(classes) + 1, bool)
    edge[1:-1] = _PARTS.ravel()[classes[:-1] * np.uint8(6) + classes[1:]]
    edge[text.offsets] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    real = classes[begin] != _SPACE
    return begin[real], end[real]


def lowered(text: W.Text) -> W.Text:
    """A-Z in lower case, unless a character follows that might combine with the capital."""
    data = W.LOWER[text.data]
    capital = np.flatnonzero(data[:-1] != text.data[:-1])
    kept = capital[_byte_classes(text.data)[capital + 1] == _OTHER]
    data[kept] = text.data[kept]
    return W.Text(data, text.offsets)


def _parts_words(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, splits by ``_PATTERN`` and marks the ends of words."""
    steps = json.loads(tokenizer.to_str())
    normal, split = steps["normalizer"] or {}, steps["pre_tokenizer"] or {}
    return (
        {"type": "Lowercase"} in normal.get("normalizers", [])
        and any(p.get("pattern") == {"Regex": _PATTERN} for p in split.get("pretokenizers", []))
        and steps["model"].get("end_of_word_suffix") == _WORD_END
    )


def _without_splitting(tokenizer) -> str:
    """The tokenizer for lower-case letters up to U+00FF with spaces between the words: without the steps that
    normalise and split by ``_PATTERN``, which leave such words as they are."""
    steps = json.loads(tokenizer.to_str())
    others = [p for p in steps["pre_tokenizer"]["pretokenizers"] if p.get("pattern") != {"Regex": _PATTERN}]
    steps["normalizer"] = None
    steps["pre_tokenizer"]["pretokenizers"] = [{"type": "WhitespaceSplit"}, *others]
    return json.dumps(steps)


class Known(NamedTuple):
    """Ids of words: their hashes in order, and where each word's ids begin in ``ids`` and end."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    ids: np.ndarray

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash stands, -1 if it does not."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def joined(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> Known:
        """With words that do not stand here yet, whose ids are given one after the other."""
        if not len(hashes):
            return self
        end = len(self.ids) + np.cumsum(sizes)
        # Only the new words are sorted: those that stand here are many, and in order.
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        own = zip((self.hashes, self.begin, self.end), (hashes, end - sizes, end), strict=True)
        return Known(*[np.insert(old, at, new[order]) for old, new in own], np.concatenate([self.ids, ids]))


def _taken(ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of many spans, one after the other."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Tokens:
    """Ids of whole texts by a tokenizer that never joins what ASCII space parts.

    A word is encoded once per block. With a tokenizer that lower-cases and splits by ``_PATTERN``, words are
    parted further, so that one with a comma is the same as one without, and plain letters skip the steps that
    change nothing in them. Words of earlier blocks are remembered by their hashes, up to ``remembered`` of them
    (some 32 bytes each); then all are forgotten.
    """

    def __init__(self, path: str, remembered: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.remembered = remembered
        self._forget()
        self.parted = _parts_words(self.tokenizer)
        self.ends = np.zeros(size, bool)
        if self.parted:
            self.plain = Tokenizer.from_str(_without_splitting(self.tokenizer))
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(_WORD_END)]] = True

    def _forget(self) -> None:
        self.known = Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all, one word after the other.

        Many words go at a time, with a mark after each; words that hold the mark go alone, and plain
        letters, whose last id says that the word ends, need none."""
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, w in enumerate(words):
            plain = self.parted and w.isalpha() and (w.isascii() or max(w) <= "\u00ff")
            kinds[0 if plain else 2 if _MARK in w else 1].append(i)
        plain, marked, alone = kinds
        sizes, parts = np.zeros(len(words), np.int64), []
        for at, marks in ((plain, False), (marked, True)):
            sizes[at], ids = self._together([words[i] for i in at], marks)
            parts.append(ids)
        for i in alone:
            ids = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, self.kind)
            sizes[i] = len(ids)
            parts.append(ids)
        order = np.array([*plain, *marked, *alone], np.int64)
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return sizes, _taken(np.concatenate(parts), begin, sizes)

    def _together(self, words: list[str], marks: bool) -> tuple[np.ndarray, np.ndarray]:
        after = f" {_MARK} " if marks else " "
        texts = [after.join([*words[i : i + 512], ""]) for i in range(0, len(words), 512)]
        if marks:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        elif texts:
            found = self.plain.encode_batch_fast([t.lower() for t in texts], add_special_tokens=False)
        else:
            found = []
        ids = np.concatenate([np.zeros(0, self.kind), *[np.array(f.ids, self.kind) for f in found]])
        ends = np.flatnonzero(ids == self.mark if marks else self.ends[ids])
        if len(ends) != len(words):
            raise ValueError(f"{len(words)} words came back as {len(ends)}")
        sizes = np.diff(ends, prepend=-1)
        return (sizes - 1, np.delete(ids, ends)) if marks else (sizes, ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, END_ID after each, and where each text's ids begin."""
        text = W.text_of(texts)
        vocabulary = W.vocabulary_of(lowered(text), pieces_of) if self.parted else W.vocabulary_of(text)
        place = self.known.places(vocabulary.hashes)
        new = np.flatnonzero(place < 0)
        at = vocabulary.entries.offsets
        made_sizes, made = self._encode(W.strings_of(W.entries_of(vocabulary.entries, at[new], at[new + 1])))
        old = np.flatnonzero(place >= 0)
        begin, sizes = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        begin[old], sizes[old] = self.known.begin[place[old]], (self.known.end - self.known.begin)[place[old]]
        begin[new], sizes[new] = len(self.known.ids) + np.cumsum(made_sizes) - made_sizes, made_sizes
        flat = np.concatenate([self.known.ids, made])
        if len(self.known.hashes) + len(new) > self.remembered:
            self._forget()
        some = new[: self.remembered]
        self.known = self.known.joined(vocabulary.hashes[some], sizes[some], _taken(flat, begin[some], sizes[some]))

        per_word = sizes[vocabulary.codes]
        ends = np.zeros(len(per_word) + 1, np.int64)
        np.cumsum(per_word, out=ends[1:])
        bounds = ends[vocabulary.bounds] + np.arange(len(vocabulary.bounds))
        out = np.full(bounds[-1], END_ID, self.kind)
        word = np.ones(len(out), bool)
        word[bounds[1:] - 1] = False
        out[word] = _taken(flat, begin[vocabulary.codes], per_word)
        return out, bounds


@cache
def tokens_of(path: str) -> Tokens:
    """One per worker process, so that a task knows the words of those before it. It takes some 100 MB: clear
    the cache in the step after."""
    return Tokens(path)


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``row_id``, ``doc_id``, ``ids`` (little-endian, 2 bytes each, or 4 for a large vocabulary) and
    ``doc_tokens``. Write it before use."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer)
        for block in W.blocks(batches, "text", BLOCK):
            ids, bounds = tokens.encode(block.column("text"))
            raw = pa.Array.from_buffers(
                pa.large_binary(),
                len(block),
                [None, pa.py_buffer(bounds.astype(np.int64) * tokens.kind.itemsize), pa.py_buffer(ids.tobytes())],
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [block.column("row_id"), block.column("doc_id"), raw, pa.array(np.diff(bounds))],
                names=["row_id", "doc_id", "ids", "doc_tokens"],
            )

    rows = numbered(docs.select("doc_id", "text"))
    return in_arrow(
        rows.select("row_id", "doc_id", "text"), run, f"row_id long, doc_id {kind}, ids binary, doc_tokens long"
    )


def _flat(batch: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column("ids").cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]]
    return data.view(kind), (at - at[0]) // kind.itemsize


def document_frequencies(tokens: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """In how many documents each id occurs: each task counts, and a row per id comes together.

    All is tokenised by then, so a worker process lets its tokenizer and the words it knows go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        tokens_of.cache_clear()
        found = np.zeros(size, np.int64)
        for batch in batches:
            ids, bounds = _flat(batch, kind)
            rows = np.repeat(np.arange(len(batch)), np.diff(bounds))
            for lo, hi in W.ranges(np.diff(bounds), 1 << 20):
                part = slice(bounds[lo], bounds[hi])
                found += np.bincount(pd.unique(rows[part] * size + ids[part]) % size, minlength=size)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["id", "n"])

    counted = in_arrow(tokens.select("ids"), run, "id long, n long")
    table = counted.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[table["id"].to_numpy()] = table["n"].to_numpy()
    return out


def turns(idf: np.ndarray) -> np.ndarray:
    """For each of ROUTES min-hashes the place of every id: a draw in which an id's chance to be first grows with its
    rarity. The end comes last, as all documents have it."""
    out = []
    for k in range(ROUTES):
        drawn = W.mixed(np.arange(1, len(idf) + 1, dtype=np.uint64) + np.uint64(k << 32)) >> np.uint64(11)
        time = -np.log((drawn + 0.5) / (1 << 53)) / np.maximum(idf, 1e-9)
        time[END_ID] = np.inf
        place = np.empty(len(idf), np.int64)
        place[np.argsort(time, kind="stable")] = np.arange(len(idf))
        out.append(np.minimum(place, (1 << ROUTE_BITS) - 1))
    return np.stack(out)


def routes(ids: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The min-hashes of each document as one number to sort by; each parts the documents that agree in those before."""
    out = np.zeros(len(bounds) - 1, np.int64)
    for place in places:
        out = out << ROUTE_BITS | np.minimum.reduceat(place[ids], bounds[:-1])
    return out


class Index:
    """Inverted BM25 index of one shard's pieces. A term that more than a part of them have is a row over all pieces
    instead of a list, which is less to add up; all rows have at most as many numbers as the lists, times COMMON."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray, mean_size: float):
        import pandas as pd

        n, size = len(bounds) - 1, len(idf)
        rows = np.repeat(np.arange(n), np.diff(bounds))
        codes, keys = pd.factorize(ids.astype(np.int64) * n + rows)  # hashed: sorting the distinct ones is less work
        order = np.argsort(keys)
        keys, times = keys[order], np.bincount(codes)[order]
        term, piece = keys // n, keys % n
        norm = K1 * (1 - B + B * np.diff(bounds) / max(mean_size, 1.0))
        weight = idf[term] * times * (K1 + 1) / (times + norm[piece])
        by_piece = np.argsort(piece, kind="stable")
        self.terms = term[by_piece]
        self.terms_at = np.searchsorted(piece[by_piece], np.arange(n + 1))
        self.n = n

        common = np.bincount(term, minlength=size) * COMMON > n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        listed = ~common[term]
        self.rows = np.zeros((int(common.sum()), n))
        self.rows[self.row[term[~listed]], piece[~listed]] = weight[~listed]
        self.piece, self.weight = piece[listed], weight[listed]
        self.at = np.searchsorted(term[listed], np.arange(size + 1))

    def terms_of(self, piece: int) -> np.ndarray:
        return self.terms[self.terms_at[piece] : self.terms_at[piece + 1]]

    def keep(self, live: np.ndarray) -> None:
        """Leaves out pieces that are used up; ``live`` says by piece whether it stays. The ones
        that stay get new numbers, in the order of the old ones; ``terms_of`` goes by the first numbers."""
        stays = live[self.piece]
        before = np.zeros(len(stays) + 1, np.int64)
        np.cumsum(stays, out=before[1:])
        self.at = before[self.at]
        self.piece = (np.cumsum(live) - 1)[self.piece[stays]]
        self.weight = self.weight[stays]
        self.rows = self.rows[:, live]
        self.n = int(live.sum())

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 score of every piece that stays in the index for a query."""
        row = self.row[terms]
        begin, sizes = self.at[terms], self.at[terms + 1] - self.at[terms]
        bounds = np.cumsum(sizes)
        places = np.repeat(begin - (bounds - sizes), sizes) + np.arange(bounds[-1] if len(bounds) else 0)
        listed = np.bincount(self.piece[places], self.weight[places], self.n)
        asked = np.zeros(len(self.rows))
        asked[row[row >= 0]] = 1
        return listed + np.einsum("t,tp->p", asked, self.rows)


class Window:
    """Pieces of a sequence that is being filled, and the words its neighbours are looked up by."""

    def __init__(self, query: np.ndarray):
        self.query, self.pieces, self.space = query, [], WINDOW

    def put(self, piece: tuple, ids: np.ndarray) -> None:
        self.pieces.append((*piece, ids))
        self.space -= len(ids)


def packed_shard(docs: list[tuple], idf: np.ndarray, mean_size: float, open_: Window | None) -> Iterator[Window]:
    """Windows over the (key, ids) of one shard; the last may have space left."""
    keys, starts, rest = [], [], []
    for key, ids in docs:
        whole = len(ids) // WINDOW * WINDOW
        for at in range(0, whole, WINDOW):
            alone = Window(np.zeros(0, np.int64))
            alone.put((key, at, len(ids)), ids[at : at + WINDOW])
            yield alone
        if whole < len(ids):
            keys.append((key, len(ids)))
            starts.append(whole)
            rest.append(ids[whole:])
    if not rest:
        if open_:
            yield open_
        return
    sizes = np.array([len(r) for r in rest])
    index = Index(np.concatenate(rest), np.concatenate([[0], np.cumsum(sizes)]), idf, mean_size)
    left, used = sizes.copy(), np.zeros(len(rest), np.int64)  # ids of a piece that are left, and before those
    seeds = iter(np.argsort(-sizes, kind="stable").tolist())
    indexed = np.arange(len(rest))  # the pieces that the index has

    def put(window: Window, piece: int, n: int) -> None:
        key, total = keys[piece]
        at = used[piece]
        window.put((key, starts[piece] + int(at), total), rest[piece][at : at + n])
        used[piece] += n
        left[piece] -= n

    while True:
        window = open_
        if window is None:
            seed = next((s for s in seeds if left[s]), None)
            if seed is None:
                return
            window = Window(index.terms_of(seed))
            put(window, seed, int(left[seed]))
        open_ = None
        if window.space:
            live = left[indexed] > 0
            if live.sum() <= REBUILT * len(indexed):
                index.keep(live)
                indexed, live = indexed[live], live[live]
            ranked = indexed[live][np.argsort(-index.scores(window.query)[live], kind="stable")]
            own = left[ranked]
            skip = 0
            while window.space and skip < len(ranked):
                fits = np.flatnonzero(own[skip:] <= window.space)
                if not len(fits):
                    break
                skip += int(fits[0])
                put(window, int(ranked[skip]), int(own[skip]))
                skip += 1
            unused = ranked[left[ranked] > 0]
            if window.space and len(unused):
                put(window, int(unused[0]), window.space)
        yield window


def powers_of_two(window: Window) -> list[Window]:
    """The pieces of a window in sequences whose sizes are powers of two."""
    total, out = WINDOW - window.space, []
    queue = list(window.pieces)[::-1]
    for size in (1 << k for k in reversed(range(WINDOW.bit_length())) if total >> k & 1):
        part = Window(window.query)
        part.space = size
        while part.space:
            key, start, whole, ids = queue.pop()
            n = min(part.space, len(ids))
            part.put((key, start, whole), ids[:n])
            if n < len(ids):
                queue.append((key, start + n, whole, ids[n:]))
        out.append(part)
    return out


def packed(docs: DataFrame, tokenizer: str, workspace: Workspace) -> DataFrame:
    """Pieces of packed sequences: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian, 4 bytes
    each), ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence.

    Every id of every document, its end included, lies in one piece. Null text counts as empty:
    its end alone. Rows that repeat are packed each. No document, no row. A document of a window or
    more is cut into windows. Of neighbours that score alike the first in the shard is taken. Only
    ``doc_id`` and ``text`` are read; other columns may be called anything.
    """
    tokens = workspace.keep(tokenised(docs, tokenizer), "tokens")
    reader = Tokens(tokenizer)
    kind, size = reader.kind, max(reader.tokenizer.get_vocab_size(), END_ID + 1)
    n, total = tokens.agg(F.count("*"), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    df = document_frequencies(tokens, kind, size)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    mean_size = min(WINDOW, total / max(1, n))
    doc_kind = docs.schema["doc_id"].dataType
    places = turns(idf)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of.cache_clear()
        for batch in batches:
            if len(batch):
                route = routes(*_flat(batch, kind), places)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route)], names=[*batch.schema.names, "route"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33

        def rows(windows: list[Window]) -> pa.RecordBatch:
            nonlocal number
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for window in windows:
                offset = 0
                for key, start, whole, ids in window.pieces:
                    values = (key, start, len(ids), ids.astype("<u4").tobytes(), whole, number, offset)
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                    offset += len(ids)
                number += 1
            arrays = [pa.array(out.pop("doc_id"), doc_type), *[pa.array(v, types[c]) for c, v in out.items()]]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *out])

        types = {c: pa.int64() for c in ("start", "length", "doc_tokens", "sequence_id", "offset")} | {"ids": pa.binary()}
        open_, shard, filled, doc_type = None, [], 0, None

        def flush() -> list[Window]:
            nonlocal open_, shard, filled
            windows = list(packed_shard(shard, idf, mean_size, open_))
            open_ = windows.pop() if windows and windows[-1].space else None
            shard, filled = [], 0
            return windows

        for batch in batches:
            doc_type = batch.column("doc_id").type
            ids, bounds = _flat(batch, kind)
            for row, key in enumerate(batch.column("doc_id").to_pylist()):
                shard.append((key, ids[bounds[row] : bounds[row + 1]].copy()))
                filled += len(shard[-1][1])
                if filled >= SHARD_TOKENS:
                    if done := flush():
                        yield rows(done)
        if shard or open_:
            done = flush()
            yield rows([*done, *(powers_of_two(open_) if open_ else [])])

    schema = (
        f"doc_id {doc_kind.simpleString()}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long"
    )
    # By range of (route, row): equal routes, however many, spread over tasks.
    routable = in_arrow(
        tokens.select("row_id", "doc_id", "ids"),
        routed,
        f"row_id long, doc_id {doc_kind.simpleString()}, ids binary, route long",
    )
    dealt = routable.repartitionByRange("route", "row_id").sortWithinPartitions("route", "row_id")
    return in_arrow(dealt.select("doc_id", "ids"), run, schema)
