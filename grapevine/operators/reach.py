"""How far an influencer's code travels: people, places, weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapevine.functions.scaling import ratio, with_minmax
from grapevine.functions.text import untagged
from grapevine.operators.distinct import distinct_counts
from grapevine.rules import Rules

MISSING = "\x00"  # stands for NULL where a missing value counts as one value


def distinct_users(edges: DataFrame) -> DataFrame:
    """Interactions per client, one to oneself included."""
    return edges.groupBy("ClientId").agg(F.count(F.lit(1)).alias("n_distinct_users"))


def client_coupon(edges: DataFrame, rules: Rules) -> DataFrame:
    """The client's code; with ``stop_on_coupon_conflict`` several codes are an error."""
    code = F.min("CouponCode")
    if rules.stop_on_coupon_conflict:
        message = F.concat(F.col("ClientId").cast("string"), F.lit(" has more than one coupon"))
        several = F.min("CouponCode") != F.max("CouponCode")
        code = F.when(several, F.raise_error(message)).otherwise(code)
    return edges.groupBy("ClientId").agg(code.alias("coupon"))


def coupon_conflicts(edges: DataFrame) -> DataFrame:
    """Number of codes per client; ``has_conflict`` is 1 where it is not one."""
    return (
        edges.groupBy("ClientId")
        .agg(F.count_distinct("CouponCode").alias("n_coupons"))
        .withColumn("has_conflict", (F.col("n_coupons") != 1).cast("int"))
    )


def _values_with_count(edges: DataFrame, value: Column, name: str, count: str) -> DataFrame:
    """Distinct values per client as rows, each with the client's number of values.

    Rows rather than one array per client, because a client's list can be long.
    """
    values = edges.select("ClientId", value.alias(name)).distinct()
    counts = values.groupBy("ClientId").agg(F.count(F.lit(1)).alias(count))
    return values.join(counts, "ClientId")


def client_zipcodes(edges: DataFrame) -> DataFrame:
    """Postal codes where a client's code was used; a missing one counts as one."""
    return _values_with_count(edges, F.col("ZipCode"), "ZipCode", "delivery_zipcodes")


def client_stores(edges: DataFrame) -> DataFrame:
    """Names of the stores where a client's code was used."""
    return _values_with_count(edges, F.col("StoreName"), "StoreName", "delivery_stores")


def client_weeks(edges: DataFrame) -> DataFrame:
    """Weeks in which a client's code was used, without the label prefix."""
    return _values_with_count(edges, untagged(F.col("week")), "week", "n_active_weeks")


def shares_by_week(edges: DataFrame) -> DataFrame:
    """Interactions per client and week."""
    return edges.groupBy("ClientId", untagged(F.col("week")).alias("week")).agg(
        F.count(F.lit(1)).alias("n_users")
    )


def self_interactions(edges: DataFrame) -> DataFrame:
    """Redemptions by a client's own number, 0 if none."""
    to_self = F.when(F.col("from") == F.col("to"), F.col("n_interactions"))
    return edges.groupBy("ClientId").agg(F.coalesce(F.max(to_self), F.lit(0)).alias("auto_interactions"))


def reach(edges: DataFrame, rules: Rules) -> DataFrame:
    """Users, postal codes, stores and weeks per client, from one aggregate.

    A missing postal code, store or week counts as one value.
    """
    places = {"delivery_zipcodes": "ZipCode", "delivery_stores": "StoreName", "n_active_weeks": "week"}
    counts = distinct_counts(
        edges.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING)) for c in places.values()}),
        ["ClientId"],
        places,
        {
            "n_distinct_users": F.count(F.lit(1)),
            "coupon": F.min("CouponCode"),
            "other_coupon": F.max("CouponCode"),
        },
    )
    if rules.stop_on_coupon_conflict:
        message = F.concat(F.col("ClientId").cast("string"), F.lit(" has more than one coupon"))
        several = F.col("coupon") != F.col("other_coupon")
        counts = counts.withColumn("coupon", F.when(several, F.raise_error(message)).otherwise(F.col("coupon")))
    return counts.drop("other_coupon").withColumn(
        "places",
        rules.zipcode_weight * F.col("delivery_zipcodes") + rules.store_weight * F.col("delivery_stores"),
    )


def with_virality(reach_rows: DataFrame) -> DataFrame:
    """Min-max scaled virality by people, places and weeks, over all given clients."""
    return with_minmax(
        reach_rows,
        {"vir_users": "n_distinct_users", "vir_physical": "places", "vir_temp": "n_active_weeks"},
    ).drop("places")


def mean_shares(members: DataFrame, reach_rows: DataFrame) -> DataFrame:
    """Users joined with their reach, and shares per distinct user."""
    return members.join(reach_rows, "ClientId", "left").withColumn(
        "mean_shares_per_user", ratio(F.col("n_shares"), F.col("n_distinct_users"))
    )
