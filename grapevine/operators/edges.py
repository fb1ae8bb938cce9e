"""Who invited whom: interactions, and the people at both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapevine.functions.text import name_similarity, store_label, week_label, zip_label
from grapevine.operators.skew import Probe, balanced_join

ENDS = {"Referrer_num": "from", "Referral_num": "to"}


def latest_interactions(redemptions: DataFrame) -> DataFrame:
    """One row per pair of numbers: its latest redemption, and how many there were.

    A missing time counts as latest; equal times go to the lowest order total, then to the
    lowest order and client id. Count and choice come from one aggregate, which combines before
    the shuffle, so a pair with very many redemptions is no hot spot.
    """
    pairs = redemptions.withColumnsRenamed(ENDS)
    total = F.col("GMV_after_discount")
    lateness = {
        "untimed": F.col("OrderUTC").isNull(),
        "OrderUTC": F.col("OrderUTC"),
        "unpriced": total.isNull(),
        "low_total": -total,
        "low_order": -F.col("OrderId"),
        "low_client": -F.col("ClientId"),
        "CouponCode": F.col("CouponCode"),
    }
    negated = {"GMV_after_discount": "low_total", "OrderId": "low_order", "ClientId": "low_client"}
    rest = [c for c in pairs.columns if c not in (*ENDS.values(), *lateness, *negated)]
    # One struct, in which every column stands once: max_by would sort and shuffle those it orders by twice.
    last = F.struct(*[column.alias(name) for name, column in lateness.items()], *rest)
    back = [
        (-F.col(f"last.{negated[c]}") if c in negated else F.col(f"last.{c}")).alias(c)
        for c in pairs.columns
        if c not in ENDS.values()
    ]
    return (
        pairs.groupBy("from", "to")
        .agg(F.count(F.lit(1)).alias("n_interactions"), F.max(last).alias("last"))
        .select("from", "to", *back, "n_interactions")
    )


def interactions(redemptions: DataFrame) -> DataFrame:
    """The edge table: latest interaction per pair with counts, labels and name similarity."""
    return with_similarity(lean_interactions(redemptions), name_probe(redemptions))


def lean_interactions(redemptions: DataFrame) -> DataFrame:
    """The edge table without name similarity, which no later step reads.

    Customers of a repeated pair are old by definition. ``store_key`` is the store label;
    the raw store id keeps its own column.
    """
    repeated = F.col("n_interactions") > 1
    return latest_interactions(redemptions).select(
        "OrderId",
        "OrderUTC",
        "CouponCode",
        "ClientId",
        "from",
        "Referrer_Name",
        "Referral_Name",
        "to",
        "childId",
        week_label(F.col("week")).alias("week"),
        F.when(repeated, "OLD").otherwise(F.col("IsNewCustomer")).alias("IsNewCustomer"),
        "StoreName",
        "StoreId",
        "ZipCode",
        "n_interactions",
        zip_label(F.col("ZipCode")).alias("zip_code"),
        store_label(F.col("StoreId")).alias("store_key"),
    )


NAMES = ["Referrer_Name", "Referral_Name"]
_BOTH_NAMED = " AND ".join(f"{name} IS NOT NULL" for name in NAMES)


_MATCHED = ["_first", "_second"]


def name_probe(rows: DataFrame) -> Probe:
    """Finds very common pairs of names among redemptions or edges."""
    return Probe(rows.where(_BOTH_NAMED).select(*NAMES).toDF(*_MATCHED), _MATCHED)


def with_similarity(edges: DataFrame, probe: Probe | None = None) -> DataFrame:
    """Edges with ``name_similarity`` after the postal code: one Python step over the distinct pairs of names.

    Edges without a name get none. They are dealt over all tasks by their numbers instead of
    meeting under their missing name, and the edges of a very common pair of names, which
    ``probe`` finds, by their order.
    """
    pairs = edges.select(*NAMES).where(_BOTH_NAMED).distinct()
    known = pairs.withColumn("name_similarity", name_similarity(*NAMES)).withColumnsRenamed(dict(zip(NAMES, _MATCHED)))
    named = F.expr(_BOTH_NAMED)
    dealt = edges.withColumns(
        {
            "_first": F.when(named, F.col(NAMES[0])),  # a missing one matches nothing
            "_second": F.when(named, F.col(NAMES[1])).otherwise(F.concat_ws(" ", "from", "to")),
        }
    )
    joined = balanced_join(dealt, known, _MATCHED, ["OrderId", "from", "to"], probe or name_probe(edges), "left")
    at = edges.columns.index("ZipCode") + 1
    return joined.select(*edges.columns[:at], "name_similarity", *edges.columns[at:])


def pair_counts(redemptions: DataFrame) -> DataFrame:
    """Redemptions per pair of numbers."""
    return (
        redemptions.withColumnsRenamed(ENDS)
        .groupBy("from", "to")
        .agg(F.count(F.lit(1)).alias("n_interactions"))
    )


def repeat_pairs(redemptions: DataFrame) -> DataFrame:
    """Pairs with more than one redemption."""
    return pair_counts(redemptions).where("n_interactions > 1")


def share_counts(redemptions: DataFrame) -> DataFrame:
    """Redemptions per referrer number, repeated ones included; no row for a missing number."""
    return (
        redemptions.where(F.col("Referrer_num").isNotNull())
        .groupBy(F.col("Referrer_num").alias("from"))
        .agg(F.count(F.lit(1)).alias("n_shares"))
    )


def users(redemptions: DataFrame) -> DataFrame:
    """One row per number seen at either end: name, kind of user, number of shares.

    A number seen as referrer takes the referrer's name and kind. Of several names, the one
    on the lowest order total counts (then the lowest order id). Each redemption gives two
    rows, and one aggregate does the rest.
    """

    def end(number: str, name: str, shares: int):
        return F.struct(F.col(number).alias("id"), F.col(name).alias("label"), F.lit(shares).alias("shares"))

    seen = redemptions.select(
        "OrderId",
        "GMV_after_discount",
        F.explode(F.array(end("Referrer_num", "Referrer_Name", 1), end("Referral_num", "Referral_Name", 0))).alias(
            "end"
        ),
    ).select("OrderId", "GMV_after_discount", "end.*")
    choice = F.struct(-F.col("shares"), "GMV_after_discount", "OrderId", "label")
    return (
        seen.groupBy("id")
        .agg(F.min_by("label", choice).alias("label"), F.sum("shares").alias("n"))
        .select(
            "id",
            "label",
            F.when(F.col("n") > 0, "Intermediate user").otherwise("End user").alias("user_type"),
            F.when(F.col("id").isNull(), 0).otherwise(F.col("n")).alias("n_shares"),
        )
    )


def phone_clients(edges: DataFrame) -> DataFrame:
    """Client id per number, as referrer and as invited customer.

    Of several clients behind one number, the one on the edge with the fewest interactions
    counts (then the earliest time and order).
    """

    def end(number: str, client: str, is_referrer: bool):
        return F.struct(
            F.col(number).alias("id"), F.col(client).alias("client"), F.lit(is_referrer).alias("is_referrer")
        )

    seen = edges.select(
        F.struct("n_interactions", "OrderUTC", "OrderId").alias("choice"),
        F.explode(F.array(end("from", "ClientId", True), end("to", "childId", False))).alias("end"),
    ).select("choice", "end.*")

    def pick(is_referrer: bool):
        chosen = F.when(F.col("is_referrer") == is_referrer, F.col("choice"))
        return F.min_by("client", chosen)

    return (
        seen.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(pick(True).alias("referrer_client"), pick(False).alias("child_client"))
    )


def people(user_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Users with their client id: as referrer if they share, as invited customer if not."""
    sharing = F.col("n_shares") != 0
    return user_rows.join(phone_clients(edges), "id", "left").select(
        *user_rows.columns,
        F.when(sharing, F.col("referrer_client")).otherwise(F.col("child_client")).alias("ClientId"),
    )


def referrer_client_ids(user_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Users with the client id their number has as a referrer, NULL if it never refers."""
    found = phone_clients(edges).select("id", F.col("referrer_client").alias("ClientId"))
    return user_rows.join(found, "id", "left")
