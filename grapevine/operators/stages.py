"""Stages of users by how much they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapevine.operators.skew import Probe, balanced_join


def sharers(user_rows: DataFrame) -> DataFrame:
    return user_rows.where("n_shares != 0")


def non_sharers(user_rows: DataFrame) -> DataFrame:
    return user_rows.where("n_shares = 0")


def share_threshold(user_rows: DataFrame) -> DataFrame:
    """Mean number of shares among those who share: one row."""
    return sharers(user_rows).agg(F.avg("n_shares").alias("mean_shares"))


def influencers(user_rows: DataFrame) -> DataFrame:
    """Sharers above the mean."""
    return sharers(user_rows).where(F.col("n_shares") > share_threshold(user_rows).scalar())


def intermediates(user_rows: DataFrame) -> DataFrame:
    """Sharers up to the mean."""
    return sharers(user_rows).where(F.col("n_shares") <= share_threshold(user_rows).scalar())


def edge_probe(edges: DataFrame) -> Probe:
    """Finds clients with very many interactions, once for all steps on the same edges."""
    return Probe(edges, ["ClientId"])


def edges_of(edges: DataFrame, members: DataFrame, probe: Probe | None = None) -> DataFrame:
    """Interactions whose referrer is one of the given users, by client id."""
    ids = members.select("ClientId").distinct()
    uses = probe or edge_probe(edges)
    return balanced_join(edges, ids, ["ClientId"], ["OrderId"], uses, "left_semi").select(*edges.columns)


def typed_edges(edges: DataFrame, staged_sharers: DataFrame, probe: Probe | None = None) -> DataFrame:
    """Interactions with the stage of their referrer as ``referrer_type``.

    One join for both stages of sharers; users who do not share have no interactions.
    """
    stages = staged_sharers.select("ClientId", F.col("stage").alias("referrer_type")).distinct()
    uses = probe or edge_probe(edges)
    return balanced_join(edges, stages, ["ClientId"], ["OrderId"], uses).select(*edges.columns, "referrer_type")


def with_stage(user_rows: DataFrame) -> DataFrame:
    """Add ``stage``: influencer, intermediate or passive."""
    mean = share_threshold(user_rows).scalar()
    return user_rows.withColumn(
        "stage",
        F.when(F.col("n_shares") == 0, "passive")
        .when(F.col("n_shares") > mean, "influencer")
        .otherwise("intermediate"),
    )
