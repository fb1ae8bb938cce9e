"""Connected components of a graph of links, by joins and aggregations alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapevine.operators.skew import Probe, balanced_join
from grapevine.session import Workspace


LINKS_A_FILE = 100_000  # of a round's table; fewer files than partitions where links are few


def _files(links: int) -> int:
    return max(8, math.ceil(links / LINKS_A_FILE))


def _with_least(rows: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """Rows by node ``u`` with its ``m``; where there may be ``hubs``, their rows are dealt over tasks."""
    return balanced_join(rows, least, ["u"], ["v"], Probe(rows, ["u"])) if hubs else rows.join(least, "u")


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every larger neighbour of a node is linked with the least of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _with_least(both, least, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least, hubs).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def components(links: DataFrame, workspace: Workspace) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) of all nodes in the links ``u``, ``v`` but those least ones.

    Alternating stars: the number of rounds grows with the logarithm of the number of nodes. Every
    round's table is written, so a lost executor costs a round at most. Links of a size that one
    node may hold too many of are written between the two stars too: there they are probed for it.
    No star makes more links than it is given and nodes, so a round is written in files by their number.
    """
    edges = workspace.keep(links.select("u", "v").where("u != v"), "links")
    files = _files(edges.count())
    before = None
    while True:
        hubs = Probe(edges).large
        linked = _large_star(edges, hubs)
        linked = workspace.keep(linked, "large-stars", files) if hubs else linked
        edges = workspace.keep(_small_star(linked, hubs), "stars", files)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
