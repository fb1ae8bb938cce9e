"""Near-duplicate vectors by a flat, robustly pruned graph.

Vectors of a label are split into overlapping clusters (spherical k-means on a bounded sample,
level by level, until a cluster has at most ``SHARD`` vectors); a vector also joins clusters whose
centres are nearly as close, however many. A cluster that splitting does not make smaller is compared whole, block
against block. Each other cluster builds a graph of its own: from a vector's nearest
candidates the closest is kept, and those that it brings much nearer are dropped. The adjacency
lists of all clusters are united. A vector is then searched for from its clusters' medoids: a
greedy beam finds its neighbourhood, and the range grows from every hit until no neighbour of a
hit is one. Found pairs are verified in double precision, and recall is audited on some vectors
against all others; where it stays too low, clusters with all pairs in them are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapevine.llm.components import components
from grapevine.llm.rows import numbered
from grapevine.operators.skew import Probe, balanced_join
from grapevine.session import Workspace

COSINE = 0.98
#: The most by which the cosines of a linked vector with its partner's centre and with its own can differ: the
#: partner is on the other side of the plane between both centres, at most sqrt(1 - COSINE ** 2) away from it.
BORDER = 2 * (1 - COSINE**2) ** 0.5 + 1e-6
SHARD = 1500
FAN = 16  # clusters that one is split into at most
SAMPLE = 4096  # vectors that the centres of a split are fitted on
SPLIT_ROWS = 8192  # vectors that are dealt to clusters in one task
LEVELS = 24
SHRINK = 0.75  # of the pairs of a cluster that those of its parts may come to; else it is compared whole
BLOCK_ROWS = 2048  # vectors of a cluster that are compared with as many others in one task
CANDIDATES, DEGREE, ALPHA = 64, 24, 1.2
AUDITED = 400  # vectors that recall is measured with
RECALL = 0.95
ATTEMPTS = ((0.1, 24), (0.2, 64), (0.4, 160))  # overlap in cosine, and beam, until recall is reached
_SLACK = 1e-4  # of single against double precision


def valid_vectors(rows: DataFrame) -> DataFrame:
    """Rows with a label and a vector of finite numbers that are not all zero."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd & some)


def _matrix(table: pa.Table, column: str = "embedding") -> np.ndarray:
    lists = table.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else very small or large numbers vanish or overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres_of(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from spread-out rows."""
    chosen, worst = [0], x @ x[0]
    for _ in range(k - 1):
        chosen.append(int(worst.argmin()))
        worst = np.maximum(worst, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        sums = np.stack([np.bincount(nearest, x[:, d], k) for d in range(x.shape[1])], 1)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _parts(near: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and the clusters that each of them joins, by the rows' cosines with the centres."""
    return np.nonzero(near >= near.max(1, keepdims=True, initial=-1) - margin)


def _centres(members: DataFrame, large: DataFrame, margin: float, level: int) -> DataFrame:
    """Centres that the large clusters are split by, and the share of a cluster's pairs that lie within its
    parts (``work``; pairs in several count as often), both found on a sample."""
    kind = members.schema["label"].dataType.simpleString()
    drawn = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30))
    sample = members.join(large, ["label", "path"]).where(drawn < F.lit(SAMPLE * (1 << 30)) / F.col("n"))

    def fitted(table: pa.Table) -> pa.Table:
        x = _unit(_matrix(table))
        k = min(FAN, max(2, -(-2 * table.column("n")[0].as_py() // SHARD)), len(x))
        centres = centres_of(x, k)
        shares = np.bincount(_parts(x @ centres.T, margin)[1], minlength=k) / len(x)
        out = {c: table.column(c).slice(0, 1) for c in ("label", "path")}
        made = {"k": pa.array([k], pa.int32()), "centres": [centres.ravel().tolist()], "work": [float(shares @ shares)]}
        return pa.table(out | made)

    return sample.groupBy("label", "path").applyInArrow(
        fitted, f"label {kind}, path string, k int, centres array<double>, work double"
    )


def _split(members: DataFrame, fits: DataFrame, margin: float) -> DataFrame:
    """Members of the clusters that have centres, in the clusters these are split into."""
    kind = members.schema["label"].dataType.simpleString()
    vector = members.schema["embedding"].dataType.simpleString()
    # New names: both sides of a cogroup must not come from the same columns.
    rows = members.join(fits.select("label", "path", F.col("salts").alias("deals")), ["label", "path"])
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(-1)), F.col("deals")).cast("int"))
    fits = fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def assigned(left: pa.Table, right: pa.Table) -> pa.Table:
        x = _unit(_matrix(left)) if len(left) else np.zeros((0, 1))
        k = right.column("k")[0].as_py()
        centres = np.array(right.column("centres")[0].as_py()).reshape(k, -1)
        row, part = _parts(x @ centres.T if len(x) else np.zeros((0, k)), margin)
        taken = left.take(pa.array(row))
        ends = [f"{p}/{b}" for p, b in zip(taken.column("path").to_pylist(), part.tolist(), strict=True)]
        return pa.table(
            {"label": taken.column("label"), "path": pa.array(ends, pa.string())}
            | {c: taken.column(c) for c in ("node", "embedding")}
        )

    return (
        dealt.groupBy("label", "path", "salt")
        .cogroup(fits.groupBy("label", "path", "salt"))
        .applyInArrow(assigned, f"label {kind}, path string, node long, embedding {vector}")
    )


def shards(nodes: DataFrame, margin: float, workspace: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """``label``, ``path``, ``node``, ``embedding``: members of the overlapping clusters; and, with their
    number ``n``, of the dense ones, if any.

    A cluster is dense if its parts would have more than SHRINK of its pairs (its vectors nearly coincide,
    so most of them join several parts). It is not split, nor is one that LEVELS splits leave too large.
    """
    members, done, dense = nodes.select("label", F.lit("").alias("path"), "node", "embedding"), [], []
    for level in range(LEVELS + 1):
        sizes = workspace.keep(members.groupBy("label", "path").agg(F.count("*").alias("n")), "shard-sizes")
        large = sizes.where(F.col("n") > SHARD)
        done.append(members.join(sizes.where(F.col("n") <= SHARD).select("label", "path"), ["label", "path"], "left_semi"))
        if large.isEmpty():
            break
        if level == LEVELS:
            dense.append(members.join(large, ["label", "path"]))
            break
        found = _centres(members, large, margin, level)
        salts = F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("salts")
        # A cluster of which nothing was drawn has no centres.
        fits = workspace.keep(large.join(found, ["label", "path"], "left").select("*", salts), "centres")
        apart = F.coalesce(F.col("work") <= SHRINK, F.lit(False))
        whole = fits.where(~apart).select("label", "path", "n")
        if not whole.isEmpty():
            dense.append(members.join(whole, ["label", "path"]))
        members = workspace.keep(_split(members, fits.where(apart), margin), "shard-members")
    out, whole = (reduce(DataFrame.union, frames) if frames else None for frames in (done, dense))
    return workspace.keep(out, "shards"), workspace.keep(whole, "dense") if dense else None


def _pairs_of(table: pa.Table) -> pa.Table:
    """Links of one block of a dense cluster, or from one block to another."""
    x, node, block = _unit(_matrix(table)), table.column("node").to_numpy(), table.column("block").to_numpy()
    inside = table.column("first")[0].as_py() == table.column("second")[0].as_py()
    left = np.flatnonzero(block == table.column("first")[0].as_py())
    right = left if inside else np.flatnonzero(block != table.column("first")[0].as_py())
    found = []
    for lo in range(0, len(left), 256):
        own = left[lo : lo + 256]
        near = x[own] @ x[right].T
        i, j = np.nonzero(near >= COSINE - 1e-9)
        a, b, near = own[i], right[j], near[i, j]
        unsure = np.flatnonzero(near < COSINE + 1e-9)
        near[unsure] = np.einsum("ij,ij->i", x[a[unsure]], x[b[unsure]])
        real = (near >= COSINE) & ((a < b) if inside else True)
        found.append(np.stack([node[a[real]], node[b[real]]]))
    u, v = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def compared(members: DataFrame) -> DataFrame:
    """Links within clusters of ``n`` members, all compared: block by block, a task for every pair of blocks."""
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(-2)), blocks).cast("int"))
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("first"), F.greatest(k, F.col("block")).alias("second")
    ))
    dealt = rows.withColumn("pair", F.explode(others)).select(
        "label", "path", "pair.first", "pair.second", "block", "node", "embedding"
    )
    return dealt.groupBy("label", "path", "first", "second").applyInArrow(_pairs_of, "u long, v long")


def pruned_neighbours(near: np.ndarray, candidates: np.ndarray, node: int) -> list[int]:
    """Robust pruning by cosine: nearest first, without those that a kept one is much nearer to."""
    kept = []
    candidates = candidates[np.argsort(-near[node, candidates], kind="stable")]
    away = 1 - near[node, candidates]
    while len(candidates) and len(kept) < DEGREE:
        best = candidates[0]
        kept.append(int(best))
        far = ALPHA * (1 - near[best, candidates]) > away
        far[0] = False
        candidates, away = candidates[far], away[far]
    return kept


def built(table: pa.Table) -> pa.Table:
    """Edges of one cluster's graph, in both directions."""
    x, node = _unit(_matrix(table)).astype(np.float32), table.column("node").to_numpy()
    near = x @ x.T
    n = len(x)
    links = set()
    for i in range(n):
        if n <= CANDIDATES + 1:
            candidates = np.delete(np.arange(n), i)
        else:
            candidates = np.argpartition(-near[i], CANDIDATES + 1)[: CANDIDATES + 1]
            candidates = candidates[candidates != i]
        for j in pruned_neighbours(near, candidates, i):
            links |= {(i, j), (j, i)}
    a, b = np.array(sorted(links), np.int64).reshape(-1, 2).T
    return pa.table({"node": node[a], "neighbour": node[b]})


class Graph:
    """A cluster's vectors with those united edges that stay in it."""

    def __init__(self, x: np.ndarray, neighbours: list[np.ndarray]):
        self.x, self.neighbours = x, neighbours
        mean = x.mean(0)
        self.medoid = int((x @ mean).argmax())

    def around(self, query: np.ndarray, beam: int) -> list[int]:
        """Vectors in range of the query: a greedy beam from the medoid, then from every hit on."""
        near = {self.medoid: float(self.x[self.medoid] @ query)}
        frontier, seen = [self.medoid], set()
        while frontier:
            best = max(frontier, key=near.__getitem__)
            seen.add(best)
            new = [v for v in self.neighbours[best].tolist() if v not in near]
            if new:
                near |= zip(new, (self.x[new] @ query).tolist(), strict=True)
            top = sorted(near, key=near.__getitem__, reverse=True)[:beam]
            frontier = [v for v in top if v not in seen]
        hits = [v for v, c in near.items() if c >= COSINE - _SLACK]
        waiting = [v for v in hits if v not in seen]
        while waiting:
            new = [v for v in self.neighbours[waiting.pop()].tolist() if v not in near]
            if new:
                found = (self.x[new] @ query).tolist()
                near |= zip(new, found, strict=True)
                own = [v for v, c in zip(new, found, strict=True) if c >= COSINE - _SLACK]
                hits += own
                waiting += own
        return hits


def _searched(beam: int):
    def run(table: pa.Table) -> pa.Table:
        exact, node = _unit(_matrix(table)), table.column("node").to_numpy()
        order = np.argsort(node)
        lists = table.column("neighbours").combine_chunks()
        flat, bounds = lists.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
        place = np.minimum(np.searchsorted(node[order], flat), len(node) - 1)
        here = node[order][place] == flat
        at = order[place]
        neighbours = [at[a:b][here[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
        graph = Graph(exact.astype(np.float32), neighbours)
        pairs = {(min(i, j), max(i, j)) for i in range(len(node)) for j in graph.around(graph.x[i], beam) if i != j}
        a, b = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        real = np.einsum("ij,ij->i", exact[a], exact[b]) >= COSINE
        u, v = node[a[real]], node[b[real]]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return run


def links(nodes: DataFrame, margin: float, beam: int, workspace: Workspace) -> DataFrame:
    """Verified pairs ``u < v`` of nodes of a label."""
    members, dense = shards(nodes, margin, workspace)
    edges = workspace.keep(members.groupBy("label", "path").applyInArrow(built, "node long, neighbour long"), "edges")
    # A node has at most some dozen neighbours in each of its clusters, plus those it is a neighbour of.
    united = edges.groupBy("node").agg(F.collect_set("neighbour").alias("neighbours"))
    empty = F.array().cast("array<long>")
    rows = members.join(united, "node", "left").withColumn("neighbours", F.coalesce("neighbours", empty))
    found = rows.groupBy("label", "path").applyInArrow(_searched(beam), "u long, v long")
    if dense is not None:
        found = found.union(compared(dense))
    return workspace.keep(found.distinct(), "vector-links")


def exact_links(nodes: DataFrame, workspace: Workspace) -> DataFrame:
    """All pairs ``u < v`` of linked nodes: those clusters are compared whole that overlap so far that every pair is in one."""
    members, dense = shards(nodes, BORDER, workspace)
    members = members.withColumn("n", F.lit(SHARD))
    found = compared(members if dense is None else members.unionByName(dense))
    return workspace.keep(found.distinct(), "vector-links")


def audit(nodes: DataFrame, found: DataFrame) -> tuple[int, int]:
    """Of the true links of at most about AUDITED nodes, drawn by hash and compared with all others, those found."""
    share = min(1.0, AUDITED / max(1, nodes.count()))
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit(99)), F.lit(1 << 30)) < int(share * (1 << 30)))
    queries = drawn.select("label", "node", "embedding").toArrow()
    if not len(queries):
        return 0, 0
    by_label: dict = {}
    for label in set(queries.column("label").to_pylist()):
        own = queries.filter(pa.array([x == label for x in queries.column("label").to_pylist()]))
        by_label[label] = own.column("node").to_numpy(), _unit(_matrix(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for label in set(table.column("label").to_pylist()) & set(by_label):
                own = table.filter(pa.array([x == label for x in table.column("label").to_pylist()]))
                node, x = own.column("node").to_numpy(), _unit(_matrix(own))
                ids, wanted = by_label[label]
                i, j = np.nonzero(wanted @ x.T >= COSINE)
                other = ids[i] != node[j]
                a, b = ids[i][other], node[j][other]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"]
                )

    true = nodes.select("label", "node", "embedding").mapInArrow(run, "u long, v long").distinct()
    marked = true.join(found.withColumn("hit", F.lit(1)), ["u", "v"], "left")
    n, hits = marked.agg(F.count("*"), F.count("hit")).first()
    return hits, n


def near_vectors(vectors: DataFrame, workspace: Workspace) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector, and the audited ``recall``.

    Vectors without label, null, zero or with a component that is null or not finite link with
    nothing; nor do vectors of different length. Equal vectors of a label are one node, and link
    with each other. A missing id counts as larger than any other. No vector, no row. ``recall``
    is null where no audited vector has a link.
    """
    rows = workspace.keep(numbered(vectors.select("vec_id", "label", "embedding")), "vectors")
    good = valid_vectors(rows)
    nodes = workspace.keep(
        # The length parts vectors that cannot be compared; it stands in for a label of its own.
        good.groupBy(F.struct("label", F.size("embedding").alias("size")).alias("label"), "embedding").agg(
            F.min("row_id").alias("node"), F.count("*").alias("copies")
        ),
        "nodes",
    )
    labels = nodes.withColumn("label", F.to_json("label"))
    for margin, beam in ATTEMPTS:
        found = links(labels, margin, beam, workspace)
        hits, true = audit(labels, found)
        if hits >= RECALL * true:
            break
    else:
        found = exact_links(labels, workspace)
        hits, true = audit(labels, found)
    copies = nodes.select("node", "copies")
    both = found.union(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # A vector may be linked with very many, a component or an embedding may hold a third of all rows.
    counted = balanced_join(both, copies.withColumnRenamed("node", "v"), ["v"], ["u"], Probe(both, ["v"]))
    partners = counted.groupBy(F.col("u").alias("node"))
    partners = partners.agg(F.sum("copies").alias("others"))
    located = components(found, workspace)
    of_node = (
        nodes.join(partners, "node", "left")
        .join(located, "node", "left")
        .select(
            F.col("label.label").alias("label"),
            "embedding",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("root"),
        )
    )
    same = ["label", "embedding"]
    placed = workspace.keep(
        balanced_join(rows, of_node, same, ["row_id"], Probe(rows, same), "left").select(
            "row_id",
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("root", "row_id").alias("root"),
        ),
        "placed",
    )
    least = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    recall = F.lit(hits / true if true else None).cast("double")
    return balanced_join(placed, least, ["root"], ["row_id"], Probe(placed, ["root"])).select(
        "vec_id",
        "n_links",
        "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
        recall.alias("recall"),
    )
