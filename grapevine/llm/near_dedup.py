"""Near duplicates by fast similarity sketches, banding and exact verification.

Texts with the same set of shingles are one node. Sketches are cut into bands; nodes that agree in
a band share a bucket. Within a bucket, sketches are compared as arrays, and every node proposes
the few partners that look most alike; these pairs are confirmed on the full shingle sets. Then all
pairs across the components found so far that share a bucket and look alike are checked on the full
sets where they meet, in the tasks that compare a bucket: these pairs may be as many as the square
of a group's size, so they are never rows. Only links that join components leave such a task.

At a Jaccard index of 0.75 a pair shares no bucket of 32 bands of 4 with a chance of 6 in a million.
Nodes that share a bucket get a longer sketch, of 512 numbers; at 0.75 its agreement is below the
limits here, four and a half standard deviations off, with a chance of about 4 in a million. A pair
is compared in the first band it agrees in alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapevine.llm import words as W
from grapevine.llm.components import components
from grapevine.llm.rows import in_arrow, numbered, with_columns
from grapevine.llm.sketches import COORDINATES, band_keys, set_digests, shingles, sketch
from grapevine.operators.skew import Probe, balanced_join
from grapevine.session import Workspace

PERCENT = 75  # of the union that the intersection must have
BAND = 4
ALIKE = 74  # equal numbers of the short sketch, of COORDINATES, from which a pair is looked at
FINE, FINE_ALIKE = 512, 340  # numbers of the long sketch, and equal ones from which a pair is checked
PROPOSED = 3  # partners that a node proposes in a bucket
BROADCAST_NODES = 2_000_000  # node numbers (16 MB) up to which texts need not move to meet them
BLOCK_ROWS = 2048  # members of a bucket that are compared in one task with as many others
BLOCK_SHINGLES = 1 << 20  # shingles of a block of members whose full sets are compared in one task with another's
SLAB = 1 << 24  # numbers of sketches that are compared at a time
HELD = 1 << 18  # pairs that are held before the best of them are picked, or they are passed on
_SET = ["digest_a", "digest_b", "n_shingles"]


def sketched(docs: DataFrame) -> DataFrame:
    """Row number, id, text, size and digests of the shingle set, sketch (2 bytes a coordinate) and
    band keys of every document. Write it before use."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "text", W.BLOCK):
            sets, bounds = shingles(W.text_of(block.column("text"), lower=True))
            digest_a, digest_b = set_digests(sets, bounds)
            rows = sketch(sets, bounds)
            keys = band_keys(rows, BAND).view(np.int64)
            short = (W.mixed(rows) >> np.uint64(48)).astype("<u2")
            made = {
                "n_shingles": pa.array(np.diff(bounds)),
                "digest_a": pa.array(digest_a),
                "digest_b": pa.array(digest_b),
                "sketch": pa.array([r.tobytes() for r in short], pa.binary()),
                "bands": pa.ListArray.from_arrays(
                    np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel()
                ),
            }
            yield pa.RecordBatch.from_arrays([*block.columns, *made.values()], names=[*block.schema.names, *made])

    rows = numbered(docs.select("doc_id", "text")).select("row_id", "doc_id", "text")
    return in_arrow(
        rows,
        run,
        f"row_id long, doc_id {kind}, text string, n_shingles long, digest_a long, digest_b long, "
        "sketch binary, bands array<long>",
    )


def buckets(nodes: DataFrame) -> DataFrame:
    """``key``, ``band``, ``node`` and ``blocks`` of the buckets with two nodes or more; of buckets with
    the same members, the one of the first band."""
    rows = nodes.select(F.col("row_id").alias("node"), F.posexplode("bands").alias("band", "key"))
    members = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"m{k}") for k in (1, 2)]
    sizes = rows.groupBy("key", "band").agg(F.count("*").alias("n"), *members).where("n > 1")
    once = sizes.groupBy("n", "m1", "m2").agg(F.min(F.struct("band", "key")).alias("first"))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    return rows.join(once.select("first.*", blocks.alias("blocks")), ["key", "band"])


def _rows_of(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Sketches of equal size as rows."""
    raw = column.combine_chunks().cast(pa.large_binary())
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    if not len(raw):
        return np.zeros((0, size), np.uint16)
    begin = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset]
    return np.frombuffer(raw.buffers()[2], "<u2", len(raw) * size, begin).reshape(-1, size)


def alike(
    short: np.ndarray, fine: np.ndarray, band: int, wanted: Callable[[int, int], np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows that look alike, and in how many numbers of the long sketch they agree, a slab of rows at a time.

    ``wanted(lo, hi)`` (some rows by all rows) says which pairs are. A pair counts in the first band it agrees in.
    """
    m = len(short)
    step = max(1, SLAB // (m * COORDINATES))
    for lo in range(0, m, step):
        equal = (short[lo : lo + step, None, :] == short[None, :, :]).sum(2, dtype=np.int16)
        a, b = np.nonzero((equal >= ALIKE) & wanted(lo, min(lo + step, m)))
        for at in range(0, len(a), 1 << 15):
            i, j = a[at : at + (1 << 15)] + lo, b[at : at + (1 << 15)]
            bands = (short[i] == short[j]).reshape(len(i), -1, BAND).all(2)
            here = bands.argmax(1) == band
            i, j = i[here], j[here]
            agree = (fine[i] == fine[j]).sum(1, dtype=np.int16)
            good = agree >= FINE_ALIKE
            yield i[good], j[good], agree[good]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of some groups, where each begins (one entry more than groups), and which are of two blocks.

    A group is a bucket and pair of blocks, by which the rows are sorted.
    """
    held: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and len(batch):
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if held is None or (batch is not None and len(held) < 2000):
            continue
        keys = [held.column(c).to_numpy() for c in ("key", "first", "second")]
        new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        cuts = np.append(np.flatnonzero(new), len(new))
        cuts = cuts if batch is None else cuts[:-1]  # the last group may go on
        if len(cuts) > 1:
            begun = cuts[:-1]
            yield held.slice(0, cuts[-1]), cuts, keys[1][begun] != keys[2][begun]
            held = held.slice(cuts[-1])


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    plain = (table.column(c).to_numpy() for c in ("node", "comp", "n_shingles", "block", "band"))
    return *plain, _rows_of(table.column("sketch"), COORDINATES), _rows_of(table.column("fine"), FINE)


def _across(comp: np.ndarray, size: np.ndarray, block: np.ndarray, cross: bool) -> Callable[[int, int], np.ndarray]:
    """Pairs of a group across components, of sets that are not too different in size; if ``cross``, across blocks."""

    def wanted(lo: int, hi: int) -> np.ndarray:
        can = (comp[lo:hi, None] != comp) & (np.arange(lo, hi)[:, None] < np.arange(len(comp)))
        can &= 100 * np.minimum(size[lo:hi, None], size) >= PERCENT * np.maximum(size[lo:hi, None], size)
        return can & (block[lo:hi, None] != block) if cross else can

    return wanted


def _proposals(most: int | None):
    """From rows of buckets, sorted by bucket and pair of blocks, to the pairs that their members propose."""

    def best(ends: np.ndarray, other: np.ndarray, agree: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((node[other], -agree, ends))
        ends, other, agree = ends[order], other[order], agree[order]
        kept = np.arange(len(ends)) - np.searchsorted(ends, ends) < most
        return ends[kept], other[kept], agree[kept]

    def of_group(node, comp, size, short, fine, block, band, cross) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a group, in parts: memory grows with the rows, not with the pairs that look alike."""

        held = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int16))
        for i, j, agree in alike(short, fine, band, _across(comp, size, block, cross)):
            if most is None:
                yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                continue
            # The best of either end; what is not among the best of a part is not among the best of all.
            found = (np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([agree, agree]))
            held = tuple(np.concatenate(both) for both in zip(held, found, strict=True))
            if len(held[0]) > HELD + 2 * most * len(node):
                held = best(*held, node)
        if len(held[0]):
            i, j, _ = best(*held, node)
            yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(table: pa.Table, cuts: np.ndarray, crosses: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            node, comp, size, block, band, short, fine = _columns(table)
            for a, b, cross in zip(cuts[:-1], cuts[1:], crosses, strict=True):
                yield from of_group(*(x[a:b] for x in (node, comp, size, short, fine, block)), band[a], cross)

        def pairs(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            out, n = [], 0
            for part in itertools.chain(parts, [None]):
                out += [] if part is None else [part]
                n += 0 if part is None else len(part[0])
                if n > HELD or (n and part is None):
                    both = np.unique(np.concatenate([np.stack(p, 1) for p in out]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])
                    out, n = [], 0

        for groups in _whole_groups(batches):
            yield from pairs(parts(*groups))

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Members with their sketches, once for every pair of blocks that theirs is in.

    A bucket of many members is compared block by block, a task for every pair of blocks.
    """
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("first"), F.greatest(k, F.col("block")).alias("second")
    ))
    dealt = rows.withColumn("block", block).withColumn("pair", F.explode(others))
    return (
        dealt.select("pair.first", "pair.second", *[c for c in dealt.columns if c not in ("pair", "blocks")])
        .repartition("key", "first", "second")
        .sortWithinPartitions("key", "first", "second", "node")
    )


def _mixed(members: DataFrame, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their component ``comp`` and sketches."""
    labelled = members.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rows = labelled.join(mixed.select("key"), "key", "left_semi").join(sketches, "node")
    return rows.select("key", "band", "blocks", "node", "comp", "n_shingles", "sketch", "fine")


def proposed(members: DataFrame, found: DataFrame, sketches: DataFrame, most: int | None) -> DataFrame:
    """Pairs ``u < v`` that members of a bucket propose across components."""
    return in_arrow(_dealt(_mixed(members, found, sketches)), _proposals(most), "u long, v long").distinct()


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each group that look like one of another component."""
    names = ["key", "band", "node", "comp", "n_shingles"]
    for table, cuts, crosses in _whole_groups(batches):
        _, comp, size, block, band, short, fine = _columns(table)
        has = np.zeros(len(table), bool)
        for a, b, cross in zip(cuts[:-1], cuts[1:], crosses, strict=True):
            wanted = _across(comp[a:b], size[a:b], block[a:b], cross)
            for i, j, _ in alike(short[a:b], fine[a:b], band[a], wanted):
                has[a + i] = has[a + j] = True
        yield from table.select(names).filter(pa.array(has)).to_batches()


def in_common(sets: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements the sets ``i`` and ``j`` of each pair share; sets stand side by side, each from its bound."""
    sizes = np.diff(bounds)
    common = np.zeros(len(i), np.int64)
    for lo, hi in W.ranges(sizes[i] + sizes[j], 1 << 19):
        keys, rows = [], []
        for end in (i[lo:hi], j[lo:hi]):
            row = np.repeat(np.arange(hi - lo), sizes[end])
            begin = np.cumsum(sizes[end]) - sizes[end]
            keys.append(sets[np.arange(len(row)) + (bounds[end] - begin)[row]] + W.mixed(row.astype(np.uint64) + np.uint64(1)))
            rows.append(row)
        common[lo:hi] = np.bincount(rows[0][np.isin(*keys)], minlength=hi - lo)
    return common


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the components of each group: of the pairs that look alike, those confirmed on the full sets,
    without pairs that the links before them have joined. There are fewer than the group has members."""
    for table, cuts, crosses in _whole_groups(batches):
        node, comp, size, block, band, short, fine = _columns(table)
        u, v = [], []
        for a, b, cross in zip(cuts[:-1], cuts[1:], crosses, strict=True):
            sets, bounds = shingles(W.text_of(table.column("text").slice(a, b - a), lower=True))
            counts = np.diff(bounds)
            wanted, joined = _across(comp[a:b], size[a:b], block[a:b], cross), comp[a:b].copy()
            for i, j, _ in alike(short[a:b], fine[a:b], band[a], wanted):
                apart = joined[i] != joined[j]
                i, j = i[apart], j[apart]
                common = in_common(sets, bounds, i, j)
                good = 100 * common >= PERCENT * (counts[i] + counts[j] - common)
                for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
                    if joined[x] != joined[y]:
                        joined[joined == joined[y]] = joined[x]
                        u.append(min(node[a + x], node[a + y]))
                        v.append(max(node[a + x], node[a + y]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def joining(members: DataFrame, found: DataFrame, texts: DataFrame, workspace: Workspace) -> DataFrame:
    """Links ``u < v`` that join the components found so far, as all pairs across them in a bucket are checked.

    Members that look like none of another component are left out before texts move.
    """
    mixed = _mixed(members, found, texts.select("node", "n_shingles", "sketch", "fine"))
    kinds = "key long, band int, node long, comp long, n_shingles long"
    left = workspace.keep(in_arrow(_dealt(mixed), _with_partner, kinds).distinct(), "partners")
    blocks = F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_SHINGLES)
    sizes = left.groupBy("key").agg(F.ceil(blocks).cast("int").alias("blocks"))
    rows = left.join(sizes, "key").join(texts.select("node", "sketch", "fine", "text"), "node")
    return in_arrow(_dealt(rows), _joining, "u long, v long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have the wanted share in common, counted on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(W.text_of(batch.column(c)).offsets) for c in ("text_u", "text_v")]
            for lo, hi in W.ranges(sizes[0] + sizes[1], 2 * W.BLOCK):
                part = batch.slice(lo, hi - lo)
                keys, counts = [], []
                for column in ("text_u", "text_v"):
                    sets, bounds = shingles(W.text_of(part.column(column), lower=True))
                    rows = np.repeat(np.arange(hi - lo), np.diff(bounds))
                    keys.append((sets + W.mixed(rows.astype(np.uint64) + np.uint64(1)), rows))
                    counts.append(np.diff(bounds))
                shared = np.isin(keys[0][0], keys[1][0])
                common = np.bincount(keys[0][1][shared], minlength=hi - lo)
                good = 100 * common >= PERCENT * (counts[0] + counts[1] - common)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).filter(pa.array(good)) for c in ("u", "v")], names=["u", "v"]
                )

    of = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
    # A text that is like very many others stands in as many pairs.
    ends = Probe(pairs, ["u"], ["v"])
    both = balanced_join(balanced_join(pairs, of("u"), ["u"], ["v"], ends), of("v"), ["v"], ["u"], ends)
    return in_arrow(both.select("u", "v", "text_u", "text_v"), run, "u long, v long")


def _fine_sketches(texts: pa.Array) -> dict[str, pa.Array]:
    rows = W.mixed(sketch(*shingles(W.text_of(texts, lower=True)), FINE)) >> np.uint64(48)
    return {"fine": pa.array([r.tobytes() for r in rows.astype("<u2")], pa.binary())}


def linked(rows: DataFrame, workspace: Workspace) -> DataFrame:
    """``row_id``, ``doc_id``, ``n_shingles`` and ``root`` of every document, the root being a row number
    that all documents of a component share. ``rows`` comes from ``sketched`` and is written."""
    slim = rows.select("row_id", "doc_id", *_SET)
    sets = workspace.keep(slim.where("n_shingles > 0").groupBy(*_SET).agg(F.min("row_id").alias("node")), "sets")
    nodes = rows.join(sets.select(F.col("node").alias("row_id")), "row_id", "left_semi")
    members = workspace.keep(buckets(nodes.select("row_id", "bands")), "buckets")
    known = workspace.keep(members.select("node").distinct(), "known")
    known = F.broadcast(known) if known.count() <= BROADCAST_NODES else known
    whole = rows.select(F.col("row_id").alias("node"), "n_shingles", "sketch", "text").join(known, "node")
    texts = workspace.keep(with_columns(whole, "text", "fine binary", _fine_sketches, W.BLOCK), "members")
    spark = rows.sparkSession
    none = spark.createDataFrame([], "node long, component long")
    pairs = proposed(members, none, texts.select("node", "n_shingles", "sketch", "fine"), PROPOSED)
    pairs = workspace.keep(pairs, "pairs")
    links = workspace.keep(confirmed(pairs, texts.select("node", "text")), "confirmed")
    found = components(links, workspace)
    more = workspace.keep(joining(members, found, texts, workspace), "joining")
    if not more.isEmpty():
        known_links = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = components(known_links.union(more), workspace)
    return (
        slim.join(sets, _SET, "left")
        .join(found, "node", "left")
        .select("row_id", "doc_id", "n_shingles", F.coalesce("component", "node", "row_id").alias("root"))
    )


def classes(rows: DataFrame, workspace: Workspace) -> DataFrame:
    """``linked`` with ``component_id``, the least id in a component, and ``first``, whether a row is its first.

    The first row has the least id, and of rows that repeat it the least number.
    """
    found = workspace.keep(linked(rows, workspace), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_id")).alias("least")
    least = found.groupBy("root").agg(first)
    # A component may hold a third of all rows.
    return balanced_join(found, least, ["root"], ["row_id"], Probe(found, ["root"])).select(
        "row_id",
        "doc_id",
        "n_shingles",
        F.col("least.doc_id").alias("component_id"),
        (F.col("least.row_id") == F.col("row_id")).alias("first"),
    )


def near_duplicates(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    Null text counts as empty; a document without words is linked with nothing. Rows that repeat
    are in one component. A missing id counts as larger than any other; a component of such rows
    has none. ``kept`` tells whether the id is its component's. Texts of any length are compared
    whole. Only ``doc_id`` and ``text`` are read; other columns may be called anything.
    """
    rows = workspace.keep(sketched(docs), "sketched")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return classes(rows, workspace).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_duplicates(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """One document of each component, with all its columns: the one with the least id."""
    whole = workspace.keep(numbered(docs, "grapevine_row"), "documents")
    rows = workspace.keep(sketched(whole.select(F.col("grapevine_row").alias("doc_id"), "text")), "sketched")
    found = workspace.keep(linked(rows, workspace), "linked").select(F.col("doc_id").alias("grapevine_row"), "root")
    ids = whole.select("grapevine_row", "doc_id").join(found, "grapevine_row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "grapevine_row")).alias("least")
    stay = ids.groupBy("root").agg(least).select("least.grapevine_row")
    return whole.join(stay, "grapevine_row", "left_semi").drop("grapevine_row")
