"""Merkle manifest of a dataset, and the climb of every row from its leaf to the root.

A leaf is the hash of one row. Per source the leaves, by id, are hashed three by three up to a
subroot, and the subroots, by source, likewise up to the root. The build stores what a climb needs as
node rows: a node of every ``STEP``-th level with its siblings on the levels up to the stored
ancestor, and a link to that ancestor. A recursive query then ascends from every leaf, appending
the siblings and folding the hash of the copy that is checked.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapevine.llm.rows import numbered, placed
from grapevine.session import Workspace

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3  # nodes under one parent
STEP = 4  # levels between stored nodes
WIDTH = RUN**STEP  # nodes under a stored one
LEAVES = 50_000  # a node above more leaves is stored that many times over, so that no key of a join is hot
TOP = -1  # the tree that stands on the subroots

_HASH = "unhex(sha2({}, 256))"
_JOINED = "aggregate({}, cast('' AS binary), (a, d) -> concat(a, d))"
_FOLD = (
    "aggregate({levels}, {digest}, (x, l) ->"
    " unhex(sha2(concat(lower(hex(l.before)), lower(hex(x)), lower(hex(l.after))), 256)))"
)
_PIECE = "aggregate({levels}, cast('' AS binary), (a, l) -> concat(a, l.before, l.after))"


class Manifest(NamedTuple):
    """``leaves``: row_id, doc_id, leaf, seen, and the first step up; ``nodes``: what a climb meets above them."""

    root: str | None
    leaves: DataFrame
    nodes: DataFrame


def leaf(fields: Sequence[Column]) -> Column:
    """Binary hash of a row: of each field ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = [field.cast("string") for field in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _stepped(nodes: DataFrame, level: int) -> DataFrame:
    """Blocks of a level: their members with siblings up to the block's node, and that node.

    ``nodes`` has tree, nodes (of the tree on this level), pos, digest, leaves and more. A tree
    of a single node is at its top, and has no more levels.
    """
    rest = [c for c in nodes.columns if c not in ("tree", "nodes")]
    blocks = (
        nodes.withColumn("block", F.expr(f"pos div {WIDTH}"))
        .groupBy("tree", "nodes", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias("members"))
        .withColumn("d0", F.expr("transform(members, m -> m.digest)"))
        .withColumn("n0", F.col("nodes"))
    )
    for j in range(STEP):
        text = f"aggregate(slice(d{j}, {RUN} * i + 1, {RUN}), '', (a, d) -> concat(a, lower(hex(d))))"
        runs = f"transform(sequence(0, (size(d{j}) - 1) div {RUN}), i -> {_HASH.format(text)})"
        blocks = blocks.withColumn(f"d{j + 1}", F.expr(f"if(n{j} > 1, {runs}, d{j})"))
        blocks = blocks.withColumn(f"n{j + 1}", F.expr(f"(n{j} + {RUN - 1}) div {RUN}"))

    def siblings(j: int) -> str:
        k = f"(i div {RUN**j})"
        before = _JOINED.format(f"slice(d{j}, {k} - {k} % {RUN} + 1, {k} % {RUN})")
        after = _JOINED.format(f"slice(d{j}, {k} + 2, {RUN - 1} - {k} % {RUN})")
        return f"if(n{j} > 1, named_struct('before', {before}, 'after', {after}), null)"

    levels = f"filter(array({', '.join(siblings(j) for j in range(STEP))}), l -> l IS NOT NULL)"
    members = ", ".join(f"'{c}', m.{c}" for c in rest)
    found = F.expr(f"transform(members, (m, i) -> named_struct({members}, 'levels', {levels}))")
    top = F.col(f"n{STEP}") == 1
    return blocks.select(
        "tree",
        F.lit(level).alias("level"),
        F.col(f"n{STEP}").alias("nodes"),
        F.col("block").alias("pos"),
        F.element_at(f"d{STEP}", 1).alias("digest"),
        F.expr("aggregate(members, 0L, (a, m) -> a + m.leaves)").alias("leaves"),
        found.alias("members"),
        # The top of a source's tree is a leaf of the tree on the subroots; the top of that is the root.
        F.when(~top, F.col("tree")).when(F.col("tree") != TOP, F.lit(TOP).cast("long")).alias("up_tree"),
        F.when(~top, F.lit(level + STEP)).otherwise(F.lit(0)).alias("up_level"),
        F.when(top, F.col("tree")).otherwise(F.col("block")).alias("up_pos"),
    )


def _built(nodes: DataFrame, most: int, workspace: Workspace) -> list[DataFrame]:
    """Written blocks of every ``STEP``-th level of trees that have ``most`` leaves at most."""
    levels = []
    while not levels or most > 1:
        levels.append(workspace.keep(_stepped(nodes, STEP * len(levels)), "merkle-level"))
        nodes = levels[-1].where("nodes > 1").select("tree", "nodes", "pos", "digest", "leaves")
        most = -(-most // WIDTH)
    return levels


def _members(level: DataFrame) -> DataFrame:
    times = F.ceil(F.col("leaves") / LEAVES).cast("int").alias("up_times")
    return level.select("tree", "level", "up_tree", "up_level", "up_pos", times, F.expr("inline(members)"))


def manifest(
    docs: DataFrame,
    workspace: Workspace,
    seen: dict[str, Column] | None = None,
    fields: Sequence[str] = FIELDS,
    order: str = "doc_id",
    group: str = "source",
) -> Manifest:
    """The manifest of the rows, made of their ``fields``, by ``order`` within each ``group``.

    ``seen`` gives other values of fields, as a copy that is to be checked has them. Only the
    fields are read, whatever other columns there are. Missing ids and groups come first; rows
    that share an id stand in the order of their leaves, and rows alike are leaves alike. No rows, no root.
    """
    values = {name: F.col(name) for name in fields}
    rows = numbered(
        docs.select(
            F.col(group).alias("of"),
            F.col(order).alias("id"),
            leaf(list(values.values())).alias("digest"),
            leaf(list((values | (seen or {})).values())).alias("seen"),
        )
    )
    rows = placed(workspace.keep(rows, "merkle-rows"), ["of", "id", "digest", "row_id"], workspace)
    # As many rows as there are sources and sorted partitions together: no source's rows meet in one task.
    runs = workspace.keep(rows.groupBy("of", "part").agg(F.min("place").alias("least"), F.count("*").alias("n")), "runs")
    trees = runs.groupBy("of").agg(F.min("least").alias("first"), F.sum("n").alias("nodes"))
    trees = workspace.keep(placed(trees, ["of"], workspace).select("of", F.col("place").alias("tree"), "first", "nodes"), "trees")
    known = runs.join(trees.withColumnRenamed("of", "own"), F.col("of").eqNullSafe(F.col("own")))
    known = known.select(F.col("of").alias("own"), F.col("part").alias("own_part"), "tree", "first", "nodes")
    here = (F.col("part") == F.col("own_part")) & F.col("of").eqNullSafe(F.col("own"))
    leaves = rows.join(known, here).select(
        "tree", "nodes", (F.col("place") - F.col("first")).alias("pos"), "digest", F.lit(1).cast("long").alias("leaves"),
        "row_id", "id", "seen",
    )

    size = trees.agg(F.max("nodes").alias("largest"), F.count("*").alias("trees")).first()
    levels = _built(leaves, size["largest"] or 1, workspace)
    done = [level.where("nodes = 1").select("tree", "digest", "leaves") for level in levels]
    subroots = done[0]
    for more in done[1:]:
        subroots = subroots.union(more)
    subroots = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(size["trees"]).cast("long").alias("nodes"),
        F.col("tree").alias("pos"), "digest", "leaves",
    )
    top = _built(subroots, size["trees"], workspace)
    root = top[-1].where("nodes = 1").select(F.lower(F.hex("digest")).alias("root")).first()

    kept = ["tree", "level", "pos", "digest", "levels", "up_tree", "up_level", "up_pos", "up_times"]
    nodes = None
    for level in [*levels[1:], *top]:
        times = F.sequence(F.lit(0), F.ceil(F.col("leaves") / LEAVES).cast("int") - 1)
        part = _members(level).select(*kept, F.explode(times).alias("time"))
        nodes = part if nodes is None else nodes.union(part)
    return Manifest(root and root["root"], _members(levels[0]), workspace.keep(nodes, "merkle-nodes"))


def climbed(made: Manifest, workspace: Workspace) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` (siblings from the leaf to the root), ``folded_root``, ``verified``.

    ``folded_root`` comes of the leaf of the copy that is checked and the manifest's siblings, and
    is the root where that leaf is unchanged. All are hex but ``proof``, which holds bytes.
    """
    spark = made.nodes.sparkSession
    leaves = made.leaves.select(
        "row_id", F.col("id").alias("doc_id"), F.col("digest").alias("leaf"),
        F.expr(_FOLD.format(levels="levels", digest="seen")).alias("folded"),
        F.expr(_PIECE.format(levels="levels")).alias("piece"),
        "up_tree", "up_level", "up_pos", F.pmod("row_id", F.col("up_times")).cast("int").alias("time"),
    )
    leaves = workspace.keep(leaves, "merkle-leaves")
    query = f"""
        WITH RECURSIVE climb(row_id, step, tree, level, pos, time, folded, subroot, piece) AS (
            SELECT row_id, 0, up_tree, up_level, up_pos, time, folded, cast(NULL AS binary), cast('' AS binary)
            FROM {{leaves}}
            UNION ALL
            SELECT c.row_id, c.step + 1, n.up_tree, n.up_level, n.up_pos, cast(pmod(c.row_id, n.up_times) AS int),
                {_FOLD.format(levels="n.levels", digest="c.folded")},
                if(n.tree = {TOP} AND n.level = 0, n.digest, NULL),
                {_PIECE.format(levels="n.levels")}
            FROM climb c JOIN {{nodes}} n
            ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos AND c.time = n.time
        )
        SELECT row_id, step, folded, subroot, piece FROM climb WHERE step > 0
    """
    # A climb has a row for every leaf and step: Spark's limit on rows is for queries that never end.
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        steps = spark.sql(query, leaves=leaves, nodes=made.nodes).withColumns(
            {"doc_id": F.lit(None).cast(leaves.schema["doc_id"].dataType), "leaf": F.lit(None).cast("binary")}
        )
        first = leaves.withColumns({"step": F.lit(0), "subroot": F.lit(None).cast("binary")})
        rows = (
            steps.unionByName(first.select(*steps.columns))
            .groupBy("row_id")
            .agg(
                F.max("doc_id").alias("doc_id"),
                F.max("leaf").alias("leaf"),
                F.max("subroot").alias("subroot"),
                F.max_by("folded", "step").alias("folded"),
                F.sort_array(F.collect_list(F.struct("step", "piece"))).alias("pieces"),
            )
            .withColumn("proof", F.expr("aggregate(pieces, cast('' AS binary), (a, p) -> concat(a, p.piece))"))
        )
        found = workspace.keep(rows.drop("pieces", "row_id"), "merkle-climb")
    finally:
        spark.conf.set(limit, before)
    folded = F.lower(F.hex("folded"))
    return found.select(
        "doc_id",
        F.lower(F.hex("leaf")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        F.lit(made.root).cast("string").alias("root"),
        "proof",
        folded.alias("folded_root"),
        (folded == F.lit(made.root)).alias("verified"),
    )
