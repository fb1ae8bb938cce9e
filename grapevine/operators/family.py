"""Influencers and the customers they invited: do those share and buy in turn?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapevine.functions.scaling import ratio, rounded_to_cents
from grapevine.operators.distinct import distinct_counts
from grapevine.operators.reach import MISSING
from grapevine.operators.skew import Probe, balanced_join


def _phone(column: str):
    # A missing number counts as one number, and equals another missing number.
    return F.coalesce(F.col(column), F.lit(MISSING))


def _to_self():
    return _phone("from") == _phone("to")


def client_probe(client_edges: DataFrame) -> Probe:
    """Finds numbers and customers that very many clients invited, once for all steps on the same edges."""
    return Probe(client_edges.select("childId", _phone("to").alias("phone")), ["phone"], ["childId"])


def child_sharing(edges: DataFrame, client_edges: DataFrame, probe: Probe | None = None) -> DataFrame:
    """Per client: invited numbers, how many clients among them share, and the rate.

    ``edges`` are all interactions, ``client_edges`` those of the clients asked for. The
    second hop is reduced to one row per number before the join: a client has one number,
    so the clients behind different invited numbers are different and their counts add up.
    The client itself is left out on both sides. The rate is a percentage rounded to
    two places (``rounded_to_cents``), as a fraction; NULL for a client with no one else.
    """
    senders = edges.select(_phone("from").alias("phone"), "ClientId")
    sharing = distinct_counts(senders, ["phone"], {"n_sharing": "ClientId"})
    invited = client_edges.groupBy("ClientId", _phone("to").alias("phone")).agg(
        F.max(_to_self().cast("int")).alias("is_self")
    )
    probe = probe or client_probe(client_edges)
    second_hop = balanced_join(invited, sharing, ["phone"], ["ClientId"], probe, "left")
    counts = second_hop.groupBy("ClientId").agg(
        (F.count(F.lit(1)) - F.max("is_self")).alias("n_children"),
        (F.sum(F.coalesce("n_sharing", F.lit(0))) - F.max("is_self")).alias("n_sharing_children"),
    )
    percent = ratio(F.col("n_sharing_children") * 100, F.col("n_children"))
    return counts.withColumn("child_sharing_rate", rounded_to_cents(percent) / 100)


def children(client_edges: DataFrame) -> DataFrame:
    """Distinct client ids invited by each client.

    The client's own id is left out if its number is among the invited numbers; this is how
    a self invitation is recognised. An own id that bought under another number stays. Only own ids
    depend on the number, so no other row is looked up.
    """
    pairs = client_edges.select(F.col("ClientId").alias("parent_Id"), F.col("childId").alias("cliente"))
    others = pairs.where(~F.col("cliente").eqNullSafe(F.col("parent_Id"))).distinct()
    own = self_invitations(client_edges).where("invites_own_id = 1 AND invites_own_number = 0")
    return others.union(own.select("ClientId", "ClientId"))


def self_invitations(client_edges: DataFrame) -> DataFrame:
    """Per client 1 or 0: is the own number among the invited, and is the own id?"""
    own_number, own_id = _to_self(), F.col("childId") == F.col("ClientId")
    return client_edges.groupBy("ClientId").agg(
        F.max(own_number.cast("int")).alias("invites_own_number"),
        F.max(F.coalesce(own_id, F.lit(False)).cast("int")).alias("invites_own_id"),
    )


def self_mismatches(client_edges: DataFrame) -> DataFrame:
    """Clients whose own number is among the invited while their id is not: another customer has it.

    Their invited customers are counted as they stand; this lists what to look into.
    """
    found = self_invitations(client_edges).where("invites_own_number = 1 AND invites_own_id = 0")
    return found.select("ClientId")


def child_behaviour(client_edges: DataFrame, means: DataFrame, probe: Probe | None = None) -> DataFrame:
    """Mean behaviour of each invited customer, per inviting client.

    ``means`` has one row per customer, computed once however often the customer was
    invited. Customers without orders are left out.
    """
    per_child = means.withColumnRenamed("ClientId", "cliente")
    probe = probe or client_probe(client_edges)
    invited = probe.called({"childId": "cliente"})
    return balanced_join(children(client_edges), per_child, ["cliente"], ["parent_Id"], invited).select(
        "parent_Id", "cliente", "active", "mean_freq", "mean_gmv", "mean_AOV"
    )


def active_child_fraction(child_rows: DataFrame) -> DataFrame:
    """Mean over a client's invited customers of each one's mean activity."""
    return child_rows.groupBy(F.col("parent_Id").alias("ClientId")).agg(
        F.avg("active").alias("active_child_fracc")
    )


def parent_behaviour(client_edges: DataFrame, means: DataFrame) -> DataFrame:
    """Mean behaviour of the clients themselves; NULL without orders."""
    return client_edges.select("ClientId").distinct().join(means, "ClientId", "left")


def parent_metrics(
    edges: DataFrame, client_edges: DataFrame, means: DataFrame, probe: Probe | None = None
) -> DataFrame:
    """Own behaviour, sharing rate of the invited, and their active fraction, per client."""
    probe = probe or client_probe(client_edges)
    return (
        parent_behaviour(client_edges, means)
        .join(child_sharing(edges, client_edges, probe).select("ClientId", "child_sharing_rate"), "ClientId", "left")
        .join(active_child_fraction(child_behaviour(client_edges, means, probe)), "ClientId", "left")
    )


def users_metrics(edges: DataFrame, client_edges: DataFrame, means: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables: metrics per client, and behaviour per client and invited customer."""
    probe = client_probe(client_edges)
    return parent_metrics(edges, client_edges, means, probe), child_behaviour(client_edges, means, probe)
