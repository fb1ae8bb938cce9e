"""Byte-level BPE over a segment tree, for the vocabulary of a rank file.

A piece of text is a row of byte tokens. The leaves of a segment tree hold, by position, the rank
of the token that this position's token and the next one merge to; every node holds the least
rank below it and its leftmost position. A merge takes the root's position, joins two tokens and
renews three leaves (the merged pair, the pair before it and the one that is gone), each with its
path to the root. Live neighbours are linked, so a merge costs time logarithmic in the piece's length.

Pieces of like length are merged in step, one tree a row of numpy arrays; a very long piece has
its tree to itself. Each distinct piece with its leading space is encoded once a block of texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapevine.llm import words as W

NEVER = np.iinfo(np.int64).max
ALONE = 1024  # bytes from which a piece has a tree of its own


class Ranks:
    """The vocabulary: bytes by rank, ranks of single bytes, and the pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
        self.size = max(found.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in found.items():
            self.bytes_of[rank] = token
        self.single = np.array([found[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            found[token[:cut]] * self.size + found[token[cut:]]: rank
            for token, rank in found.items()
            for cut in range(1, len(token))
            if token[:cut] in found and token[cut:] in found
        }
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.slots = _hash_table(self.keys)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NEVER where a pair does not merge or ``right`` is -1."""
        wanted = left * self.size + right
        place = _slot(wanted, len(self.slots))
        out = np.full(len(wanted), NEVER, np.int64)
        open_ = np.flatnonzero(right >= 0)
        while len(open_):
            at = self.slots[place[open_]]
            hit = (at >= 0) & (self.keys[at] == wanted[open_])
            out[open_[hit]] = self.merged[at[hit]]
            open_ = open_[(at >= 0) & ~hit]
            place[open_] = (place[open_] + 1) % len(self.slots)
        return out


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (W.mixed(keys.astype(np.uint64)) % np.uint64(size)).astype(np.int64)


def _hash_table(keys: np.ndarray) -> np.ndarray:
    """Index of a key by slot, -1 where empty; a taken slot sends the key to the next one."""
    size = 1 << (4 * len(keys)).bit_length()
    slots = np.full(size, -1, np.int64)
    waiting, place = np.arange(len(keys)), _slot(keys, size)
    while len(waiting):
        free = slots[place] < 0
        slots[place[free]] = waiting[free]
        lost = slots[place] != waiting
        waiting, place = waiting[lost], (place[lost] + 1) % size
    return slots


def encode_together(pieces: np.ndarray, sizes: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces given as rows of bytes (padded on the right); the ids in a row, and their number by piece."""
    n, width = pieces.shape
    leaves = 1 << max(0, (width - 1).bit_length())
    here = np.arange(width)
    token = np.where(here < sizes[:, None], ranks.single[pieces], -1)
    after = np.where(here + 1 < sizes[:, None], here + 1, -1)
    before = np.broadcast_to(here - 1, (n, width)).copy()
    # A node's value is rank * leaves + position: its least is the least rank, and of equals the leftmost.
    tree = np.full((n, 2 * leaves), NEVER, np.int64)
    if width > 1:
        rank = ranks.of_pairs(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, leaves : leaves + width - 1] = np.where(rank < NEVER, rank * leaves + here[:-1], NEVER)
    for low in _levels(leaves):
        tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
    live = np.flatnonzero(tree[:, 1] < NEVER) if leaves > 1 else np.zeros(0, np.int64)
    while len(live):
        top = tree[live, 1]
        at = top % leaves
        gone = after[live, at]
        then = after[live, gone]
        token[live, at] = top // leaves
        token[live, gone] = -1
        after[live, at] = then
        linked = then >= 0
        before[live[linked], then[linked]] = at[linked]
        previous = before[live, at]
        first = previous >= 0
        rows = np.concatenate([live, live[first], live])
        places = np.concatenate([at, previous[first], gone])
        left = np.concatenate([token[live, at], token[live[first], previous[first]], np.zeros(len(live), np.int64)])
        nothing = np.full(len(live), -1, np.int64)
        right = np.concatenate([np.where(linked, token[live, then], -1), token[live, at][first], nothing])
        rank = ranks.of_pairs(left, right)
        tree[rows, leaves + places] = np.where(rank < NEVER, rank * leaves + places, NEVER)
        node = (leaves + places) >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node >>= 1
        live = live[tree[live, 1] < NEVER]
    kept = token >= 0
    return token[kept], kept.sum(axis=1)


def _levels(leaves: int) -> Iterator[int]:
    low = leaves // 2
    while low:
        yield low
        low //= 2


def encode_alone(piece: bytes, ranks: Ranks) -> list[int]:
    """The same merges for one long piece, on plain lists."""
    n, pairs, size = len(piece), ranks.pairs, ranks.size
    leaves = 1 << max(0, (n - 1).bit_length())
    token = ranks.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    tree = [NEVER] * (2 * leaves)
    for i in range(n - 1):
        rank = pairs.get(token[i] * size + token[i + 1])
        tree[leaves + i] = NEVER if rank is None else rank * leaves + i
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def renew(at: int) -> None:
        then = after[at]
        rank = pairs.get(token[at] * size + token[then]) if token[at] >= 0 and then >= 0 else None
        node = leaves + at
        tree[node] = NEVER if rank is None else rank * leaves + at
        node >>= 1
        while node:
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    while leaves > 1 and tree[1] < NEVER:
        rank, at = divmod(tree[1], leaves)
        gone = after[at]
        token[at], token[gone], after[at] = rank, -1, after[gone]
        if after[at] >= 0:
            before[after[at]] = at
        renew(gone)
        renew(at)
        if before[at] >= 0:
            renew(before[at])
    return [t for t in token if t >= 0]


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """Ids of each piece."""
    out: list = [None] * len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    for width in np.unique(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)).tolist():
        members = np.flatnonzero((sizes <= width) & (sizes > width // 2) if width > 1 else sizes <= 1)
        if width > ALONE:
            for i in members.tolist():
                out[i] = np.array(encode_alone(pieces[i], ranks), np.int64)
            continue
        for group in np.array_split(members, max(1, len(members) * width // (1 << 18))):
            raw = b"".join(pieces[i].ljust(width, b"\0") for i in group.tolist())
            rows = np.frombuffer(raw, np.uint8).reshape(len(group), width)
            ids, counts = encode_together(rows, sizes[group], ranks)
            for i, part in zip(group.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[i] = part
    return out


def units_of(text: W.Text) -> tuple[np.ndarray, np.ndarray]:
    """Words with the ASCII space before them, and space that ends a text.

    The splitting pattern never joins a sign to space after it, so it splits each unit as it
    splits the whole text.
    """
    begin, end = W.words_of(text)
    bounds = W.word_counts(text, begin)
    some = np.flatnonzero(np.diff(bounds))
    starts = np.empty_like(begin)
    starts[1:] = end[:-1]
    starts[bounds[some]] = text.offsets[some]
    last = text.offsets[:-1].copy()
    last[some] = end[bounds[some + 1] - 1]
    rest = last < text.offsets[1:]
    begin, end = np.concatenate([starts, last[rest]]), np.concatenate([end, text.offsets[1:][rest]])
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order]


class Encoder:
    """Encodes whole texts; remembers the units of earlier blocks, up to ``remembered`` of them."""

    def __init__(self, path: str, pattern: str, remembered: int = 300_000):
        import regex

        self.ranks = Ranks(path)
        self.split = regex.compile(pattern).findall
        self.remembered = remembered
        self.known: dict[str, np.ndarray] = {}

    def ids_of_units(self, units: list[str]) -> list[np.ndarray]:
        new = [u for u in units if u not in self.known]
        pieces = [self.split(u) for u in new]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(p for found in pieces for p in found))}
        encoded = encode_pieces([p.encode() for p in distinct], self.ranks)
        made = {
            u: encoded[distinct[found[0]]].astype(np.uint32)
            if len(found) == 1
            else np.concatenate([encoded[distinct[p]] for p in found]).astype(np.uint32)
            for u, found in zip(new, pieces, strict=True)
        }
        out = [made[u] if u in made else self.known[u] for u in units]
        if len(self.known) + len(made) > self.remembered:
            self.known.clear()
        self.known |= dict(list(made.items())[: self.remembered])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        text = W.text_of(texts)
        vocabulary = W.vocabulary_of(text, units_of)
        ids = self.ids_of_units(W.strings_of(vocabulary.entries))
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        per_word = sizes[vocabulary.codes]
        bounds = np.zeros(len(per_word) + 1, np.int64)
        np.cumsum(per_word, out=bounds[1:])
        places = np.repeat(starts[vocabulary.codes] - bounds[:-1], per_word) + np.arange(bounds[-1])
        return flat[places], bounds[vocabulary.bounds]


def digests(ids: np.ndarray, bounds: np.ndarray, decimal: list[bytes], bytes_of: list[bytes]) -> dict[str, list]:
    """By text: number of ids, hash of the ids as text, and hash of the bytes that the ids decode to."""
    out: dict[str, list] = {"n_tokens": np.diff(bounds), "ids_sha256": [], "decoded_sha256": []}
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        own = ids[a:b].tolist()
        out["ids_sha256"].append(hashlib.sha256(b",".join(map(decimal.__getitem__, own))).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(decode(own, bytes_of)).hexdigest())
    return out


def decode(ids: list[int], bytes_of: list[bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, ids))


def _per_block(df: DataFrame, path: str, pattern: str, schema: str, compute: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for block in W.blocks(batches, "text", 8 << 20):
            made = compute(encoder, block.column("text"))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *map(pa.array, made.values())], names=["doc_id", *made]
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every document; a null or empty text has none. Rows that repeat stay."""

    def compute(encoder: Encoder, texts: pa.Array) -> dict:
        ids, bounds = encoder.encode(texts)
        return {"ids": pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))}

    return _per_block(docs, path, pattern, "ids array<int>", compute)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of encoded documents."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = Ranks(path).bytes_of
        for batch in batches:
            texts = [decode(ids or [], bytes_of).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, number of ids, and the hashes of the ids as text and of what they decode to.

    Null text counts as empty: no ids, and the hashes of nothing. Every row is encoded whole;
    rows that repeat are encoded each. Only ``doc_id`` and ``text`` are read; other columns may be
    called anything.
    """

    def compute(encoder: Encoder, texts: pa.Array) -> dict:
        ids, bounds = encoder.encode(texts)
        return digests(ids, bounds, [b"%d" % i for i in range(encoder.ranks.size)], encoder.ranks.bytes_of)

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _per_block(docs, path, pattern, schema, compute).withColumn("n_tokens", F.col("n_tokens").cast("long"))
