"""Every operator as a query on the shared test tables.

Results are made comparable across engines at the very end: dates and times as text, money
as doubles, doubles rounded to six places (halves up, see checks.oracle), integers as 64-bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grapevine.functions import calendar, text
from grapevine.functions.scaling import virality_curve
from grapevine.operators import accuracy, edges, family, growth, orders, reach, redemptions, stages
from grapevine.plans.campaign import Campaign, export_csv, run
from grapevine.rules import Rules
from grapevine.session import Workspace, use_trial_folder
from grapevine.sources.schemas import ShopTables
from grapevine.sources.tables import read_csv
from grapevine.sources.testviews import AS_OF, shop_from_test_tables

RULES = Rules()
STRICT = Rules(stop_on_coupon_conflict=True)
ONCE = Rules(dedupe_lines=True)
Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            column = column.cast("string")
        elif isinstance(kind, (T.DoubleType, T.DecimalType)):
            column = F.round(column.cast("double") + 1e-9, 6)
        elif isinstance(kind, T.IntegerType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _shop(spark: SparkSession, sf_dir: str) -> ShopTables:
    use_trial_folder(spark)
    return shop_from_test_tables(spark, sf_dir)


def _from_tables(build: Callable) -> Query:
    return lambda spark, sf_dir: comparable(build(_shop(spark, sf_dir)))


def _from_redemptions(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _from_tables(lambda tables: build(redemptions.redemptions(tables, RULES)))


def _from_lines(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _from_tables(lambda tables: build(orders.order_lines(tables, RULES)))


def _from_campaign(build: Callable[[Campaign], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(
        build(Campaign(spark, _shop(spark, sf_dir), AS_OF, RULES))
    )


def _without_similarity(rows: DataFrame) -> DataFrame:
    return rows.drop("name_similarity")


def _local_time(t):
    return t.order.select("Id", calendar.local_time(F.col("CreatedOnUtc")).alias("local_time"))


def _week_code(t):
    return t.order.select("Id", calendar.week_code(calendar.local_time(F.col("CreatedOnUtc"))).alias("week"))


def _delivery_date(t):
    return t.order.select("Id", calendar.delivery_date(F.col("CreatedOnUtc")).alias("fecha"))


def _week_start(t):
    fecha = calendar.delivery_date(F.col("CreatedOnUtc"))
    return t.order.select(
        "Id",
        calendar.week_start(fecha).alias("semana"),
        calendar.week_start(fecha, strict=True).alias("monday"),
    )


def _sharers(c: Campaign) -> DataFrame:
    return stages.sharers(c.people)


def _active_flag(lines: DataFrame) -> DataFrame:
    life = orders.customer_lifetime(lines)
    return life.select("cliente", orders.active_flag(F.col("ultimopedido"), AS_OF, RULES).alias("activo1"))


def _user_client_id(c: Campaign) -> DataFrame:
    return edges.referrer_client_ids(edges.users(c.redemptions), c.edges).select("id", "ClientId")


def _with_reach(c: Campaign) -> DataFrame:
    return reach.mean_shares(c.members("influencer"), c.reach)


def _self_interactions(c: Campaign) -> DataFrame:
    return reach.self_interactions(c.edges)


def _influencer_profile(c: Campaign) -> DataFrame:
    c.prepare()
    parents = family.parent_metrics(c.edges, c.influencer_edges, c.means, c.client_probe)
    return c.members("influencer").select("ClientId", "id", "label", "n_shares").join(parents, "ClientId")


def _users_metrics(c: Campaign) -> DataFrame:
    """Both tables of the pair in one result, told apart by ``cliente``."""
    parents, children = family.users_metrics(c.edges, c.influencer_edges, c.means)
    return parents.unionByName(
        children.withColumnRenamed("parent_Id", "ClientId"), allowMissingColumns=True
    )


def _virality_score(c: Campaign) -> DataFrame:
    return c.staged_people.where("stage = 'influencer'").select("ClientId", "virality_score")


def _rounded_k(rows: DataFrame) -> DataFrame:
    # The SQL searches in steps of 1e-6: shifted by half a step, the two never part at a half.
    return rows.withColumn("k_factor", F.round(F.col("k_factor") + 5e-7, 3))


def _cumulative_uses(c: Campaign) -> DataFrame:
    return growth.cumulative_uses(growth.daily_uses(c.influencer_edges, "ClientId", "OrderUTC"))


def _event_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    uses = events.select((F.col("user_id") % 15).alias("client"), "ts")
    return growth.cumulative_uses(growth.daily_uses(uses, "client", "ts"))


def _k_factor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_rounded_k(growth.k_factor(_event_uses(spark, sf_dir), RULES)))


def _virality_curve(c: Campaign) -> DataFrame:
    k = F.explode(F.array(F.lit(0.9), F.lit(1.0), F.lit(1.002))).alias("k")
    return (
        _cumulative_uses(c)
        .select("ClientId", "x", "u0", k)
        .withColumn("predicted", virality_curve(F.col("x"), F.col("k"), F.col("u0")))
    )


def _forecasts(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    event = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        by,
        F.when(event % 20 == 0, 0.0).otherwise(F.floor("value").cast("double")).alias("target"),
        (F.col("value") + event % 3).alias("prediction"),
    )


def _mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(accuracy.mape(_forecasts(spark, sf_dir), "target", "prediction", by=["event_type"]))


def _mape_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecasts(spark, sf_dir)
    return comparable(accuracy.mape(rows, "target", "prediction", by=["event_type"], remove_zero_targets=False))


def _mape_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every forecast by itself, as a ratio; a zero target gives none."""
    rows = _forecasts(spark, sf_dir, "event_id")
    return comparable(accuracy.mape(rows, "target", "prediction", by=["event_id"], single_row_as_ratio=True))


def _name_similarity(rows: DataFrame) -> DataFrame:
    return edges.interactions(rows).select("from", "to", "Referrer_Name", "Referral_Name", "name_similarity")


def _sink(name: str) -> Query:
    """Let the whole analysis replace both result tables in a database of its own, and read one of them."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = _shop(spark, sf_dir)
        workspace = Workspace(spark)
        database = f"results_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {database} LOCATION '{workspace.path(database)}'")
        run(spark, tables, AS_OF, RULES, database, workspace)
        back = spark.table(f"{database}.{name}")
        return comparable(_rounded_k(back) if "k_factor" in back.columns else _without_similarity(back))

    return build


def _csv(which: int) -> Query:
    """Export interactions and users as CSV, read one of them back."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = _shop(spark, sf_dir)
        workspace = Workspace(spark)
        rows = workspace.keep(redemptions.redemptions(tables, RULES), "redemptions")
        tables = edges.interactions(rows), edges.users(rows)
        paths = export_csv(*tables, workspace.path("csv"))
        return comparable(_without_similarity(read_csv(spark, paths[which], tables[which].schema)))

    return build


def _redemption_columns(*names: str) -> Query:
    return _from_redemptions(lambda rows: rows.select(*names))


def _label(column: str, label: Callable, name: str) -> Query:
    return _from_redemptions(lambda rows: rows.select("OrderId", "ClientId", column, label(F.col(column)).alias(name)))


QUERIES: dict[str, Query] = {
    # redemptions
    "redemptions": _from_tables(lambda t: redemptions.redemptions(t, RULES)),
    "personal_coupons": _from_tables(lambda t: redemptions.personal_coupons(t.discount, RULES)),
    "referrer_of_coupon": _from_tables(lambda t: redemptions.referrer_of_coupon(t, RULES)),
    "buyer_coupon_orders": _from_tables(lambda t: redemptions.buyer_coupon_orders(t, RULES)),
    "customer_zip": _from_tables(redemptions.customer_zip),
    "split_identities": _from_tables(redemptions.split_identities),
    "new_customer_flag": _redemption_columns("OrderId", "childId", "IsNewCustomer"),
    "local_time": _from_tables(_local_time),
    "week_code": _from_tables(_week_code),
    "zip_label": _label("ZipCode", text.zip_label, "zip_code"),
    "store_label": _label("StoreId", text.store_label, "store_key"),
    "week_label": _label("week", text.week_label, "week_tag"),
    # interactions and users
    "pair_counts": _from_redemptions(edges.pair_counts),
    "repeat_pairs": _from_redemptions(edges.repeat_pairs),
    "share_counts": _from_redemptions(edges.share_counts),
    "latest_interaction": _from_redemptions(
        lambda rows: edges.latest_interactions(rows).select("from", "to", "OrderId", "OrderUTC", "n_interactions")
    ),
    "interactions": _from_redemptions(
        lambda rows: _without_similarity(edges.interactions(rows)).orderBy(F.desc("n_interactions"), "OrderId")
    ),
    "users": _from_redemptions(lambda rows: edges.users(rows).orderBy(F.desc("n_shares"), "id")),
    "name_similarity": _from_redemptions(_name_similarity),
    "csv_interactions": _csv(0),
    "csv_users": _csv(1),
    "user_client_id": _from_campaign(_user_client_id),
    "non_sharer_client_id": _from_campaign(lambda c: stages.non_sharers(c.people).select("id", "ClientId")),
    "share_threshold": _from_redemptions(lambda rows: stages.share_threshold(edges.users(rows))),
    "sharers": _from_campaign(lambda c: _sharers(c).drop("stage")),
    "non_sharers": _from_campaign(lambda c: stages.non_sharers(c.people).drop("stage")),
    "influencers": _from_campaign(lambda c: stages.influencers(c.people).drop("stage")),
    "intermediates": _from_campaign(lambda c: stages.intermediates(c.people).drop("stage")),
    "influencer_interactions": _from_campaign(lambda c: _without_similarity(c.influencer_edges)),
    "intermediate_interactions": _from_campaign(
        lambda c: _without_similarity(stages.edges_of(c.edges, c.members("intermediate")))
    ),
    # reach of influencers
    "distinct_users": _from_campaign(lambda c: reach.distinct_users(c.influencer_edges)),
    "mean_shares": _from_campaign(
        lambda c: _with_reach(c).select("ClientId", "n_shares", "n_distinct_users", "mean_shares_per_user")
    ),
    "client_coupon": _from_campaign(lambda c: reach.client_coupon(c.influencer_edges, RULES)),
    "client_coupon_or_stop": _from_campaign(lambda c: reach.client_coupon(c.influencer_edges, STRICT)),
    "coupon_conflicts": _from_campaign(lambda c: reach.coupon_conflicts(c.influencer_edges)),
    "client_zipcodes": _from_campaign(lambda c: reach.client_zipcodes(c.influencer_edges)),
    "client_stores": _from_campaign(lambda c: reach.client_stores(c.influencer_edges)),
    "client_weeks": _from_campaign(lambda c: reach.client_weeks(c.influencer_edges)),
    "shares_by_week": _from_campaign(lambda c: reach.shares_by_week(c.influencer_edges)),
    "self_interactions": _from_campaign(_self_interactions),
    "vir_users": _from_campaign(lambda c: c.reach.select("ClientId", "vir_users")),
    "vir_physical": _from_campaign(lambda c: c.reach.select("ClientId", "vir_physical")),
    "vir_temp": _from_campaign(lambda c: c.reach.select("ClientId", "vir_temp")),
    "cumulative_uses": _from_campaign(_cumulative_uses),
    "virality_curve": _from_campaign(_virality_curve),
    "k_factor": _from_campaign(lambda c: _rounded_k(c.k_factors)),
    "k_factor_events": _k_factor_events,
    # behaviour
    "delivery_date": _from_tables(_delivery_date),
    "week_start": _from_tables(_week_start),
    "order_lines": _from_lines(lambda lines: lines),
    "customer_lifetime": _from_lines(orders.customer_lifetime),
    "customer_history": _from_campaign(lambda c: orders.customer_history(c.lines)),
    "weekly_customer_store": _from_campaign(lambda c: orders.weekly_customer_store(c.lines)),
    "daily_order_flag": _from_lines(lambda lines: orders.daily_order_flag(lines).drop("semana")),
    "weekly_frequency": _from_lines(orders.weekly_frequency),
    "store_week_customers": _from_lines(orders.store_week_customers),
    "category_flags": _from_lines(orders.category_flags),
    "active_flag": _from_lines(_active_flag),
    "behaviour": _from_campaign(lambda c: c.behaviour),
    "behaviour_once": lambda spark, sf_dir: comparable(Campaign(spark, _shop(spark, sf_dir), AS_OF, ONCE).behaviour),
    "client_means": _from_campaign(lambda c: c.means),
    # influencers and the customers they invited
    "child_sharing": _from_campaign(lambda c: family.child_sharing(c.edges, c.influencer_edges)),
    "child_behaviour": _from_campaign(lambda c: c.child_rows),
    "active_child_fraction": _from_campaign(lambda c: family.active_child_fraction(c.child_rows)),
    "self_invitations": _from_campaign(lambda c: family.self_invitations(c.edges)),
    "parent_behaviour": _from_campaign(lambda c: family.parent_behaviour(c.influencer_edges, c.means)),
    "users_metrics": _from_campaign(_users_metrics),
    "influencer_profile": _from_campaign(_influencer_profile),
    # results
    "virality_score": _from_campaign(_virality_score),
    "influencer_ranking": _from_campaign(lambda c: _rounded_k(c.stage_table("influencer"))),
    "intermediate_users": _from_campaign(lambda c: c.stage_table("intermediate")),
    "passive_users": _from_campaign(lambda c: c.stage_table("passive")),
    "user_stages": _from_campaign(lambda c: _rounded_k(c.user_stages)),
    "user_interactions": _from_campaign(lambda c: _without_similarity(c.user_interactions)),
    "sink_user_stages": _sink("user_stages"),
    "sink_user_interactions": _sink("user_interactions"),
    # forecasts
    "mape": _mape,
    "mape_shifted": _mape_shifted,
    "mape_one_row": _mape_one_row,
}
