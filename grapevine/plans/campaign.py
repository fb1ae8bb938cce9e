"""The campaign analysis: from shop tables to user stages and user interactions."""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapevine.functions.scaling import ratio
from grapevine.operators import edges as edge_ops
from grapevine.operators import family, growth, orders, reach, stages
from grapevine.operators.ranking import ranked
from grapevine.operators.redemptions import redemptions
from grapevine.operators.skew import Probe
from grapevine.rules import Rules
from grapevine.session import Workspace
from grapevine.sources.schemas import ShopTables
from grapevine.sources.tables import replace_tables, write_csv

SCORE_PARTS = ["active", "vir_users", "vir_physical", "vir_temp", "child_sharing_rate", "active_child_fracc"]

STAGES_TABLE, INTERACTIONS_TABLE = "user_stages", "user_interactions"

# Names of the exported files and of the columns.
INTERACTIONS_CSV, USERS_CSV = "referrer_referral.csv", "user_properties.csv"

STAGE_COLUMNS = {
    "id": "phone_number",
    "label": "user_name",
    "n_shares": "n_shares",
    "ClientId": "client_id",
    "n_distinct_users": "n_distinct_users",
    "mean_shares_per_user": "mean_shares_per_user",
    "vir_users": "vir_users",
    "coupon": "coupon",
    "delivery_zipcodes": "delivery_zipcodes",
    "delivery_stores": "delivery_stores",
    "vir_physical": "vir_physical",
    "n_active_weeks": "n_active_weeks",
    "vir_temp": "vir_temp",
    "k_factor": "k_factor",
    "active": "active",
    "mean_freq": "mean_freq",
    "mean_gmv": "mean_gmv",
    "mean_AOV": "mean_aov",
    "child_sharing_rate": "child_sharing_rate",
    "active_child_fracc": "active_child_fracc",
    "virality_score": "virality_score",
    "stage": "user_type",
    "stage_rank": "stage_rank",
}

INTERACTION_COLUMNS = {
    "OrderId": "order_id",
    "OrderUTC": "order_utc",
    "CouponCode": "coupon_code",
    "ClientId": "referrer_client_id",
    "from": "referrer_phone_number",
    "Referrer_Name": "referrer_name",
    "Referral_Name": "referral_name",
    "to": "referral_phone_number",
    "childId": "referral_client_id",
    "week": "week",
    "IsNewCustomer": "is_new_customer",
    "StoreName": "store_name",
    "StoreId": "store_id",
    "ZipCode": "zipcode",
    "name_similarity": "name_similarity",
    "n_interactions": "n_interactions",
    "zip_code": "zip_code",
    "store_key": "store_key",
    "referrer_type": "referrer_type",
}


def process_redemptions(redemption_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Redemptions to (interactions, users). The input is read twice: pass a written table."""
    return edge_ops.interactions(redemption_rows), edge_ops.users(redemption_rows)


def export_csv(interactions: DataFrame, users: DataFrame, folder: str) -> tuple[str, str]:
    """Write both tables as CSV, most repeated pairs and most active sharers first.

    Ids end the sort orders, so equal counts spread over several sort tasks.
    """
    paths = f"{folder}/{INTERACTIONS_CSV}", f"{folder}/{USERS_CSV}"
    write_csv(interactions.orderBy(F.desc("n_interactions"), "OrderId", "from", "to"), paths[0])
    write_csv(users.orderBy(F.desc("n_shares"), "id"), paths[1])
    return paths


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


class Campaign:
    """The steps of one analysis, each made when first asked for.

    Steps that several later ones read are written to the workspace once. ``as_of`` is the
    day on which activity is judged.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: ShopTables,
        as_of: datetime.date | str,
        rules: Rules | None = None,
        workspace: Workspace | None = None,
    ):
        self.spark = spark
        self.tables = tables
        self.as_of = as_of
        self.rules = rules or Rules()
        self.workspace = workspace or Workspace(spark)

    @cached_property
    def redemptions(self) -> DataFrame:
        return self.workspace.keep(redemptions(self.tables, self.rules), "redemptions")

    @cached_property
    def edges(self) -> DataFrame:
        return self.workspace.keep(edge_ops.lean_interactions(self.redemptions), "edges")

    @cached_property
    def people(self) -> DataFrame:
        """Users with client id and stage."""
        found = edge_ops.people(edge_ops.users(self.redemptions), self.edges)
        return stages.with_stage(self.workspace.keep(found, "people"))

    def members(self, stage: str) -> DataFrame:
        return self.people.where(F.col("stage") == stage)

    @cached_property
    def edge_probe(self) -> Probe:
        return stages.edge_probe(self.edges)

    @cached_property
    def influencer_edges(self) -> DataFrame:
        found = stages.edges_of(self.edges, self.members("influencer"), self.edge_probe)
        return self.workspace.keep(found, "influencer-edges")

    @cached_property
    def client_probe(self) -> Probe:
        return family.client_probe(self.influencer_edges)

    @cached_property
    def lines(self) -> DataFrame:
        return self.workspace.keep(orders.order_lines(self.tables, self.rules).drop("catid"), "lines")

    @cached_property
    def behaviour(self) -> DataFrame:
        return orders.behaviour(self.lines, self.as_of, self.rules, orders.visit_probe(self.tables, self.rules))

    @cached_property
    def means(self) -> DataFrame:
        if "lines" in self.__dict__:  # written already, for another step
            return self.workspace.keep(orders.client_means(self.behaviour), "means")
        lines = orders.lines_for_means(orders.order_lines(self.tables, self.rules))
        visits = orders.visit_probe(self.tables, self.rules)
        rows = orders.behaviour(self.workspace.keep(lines, "lines-for-means"), self.as_of, self.rules, visits)
        return self.workspace.keep(orders.client_means(rows), "means")

    @cached_property
    def reach(self) -> DataFrame:
        """Reach and scaled virality per influencer."""
        return reach.with_virality(self.workspace.keep(reach.reach(self.influencer_edges, self.rules), "reach"))

    @cached_property
    def k_factors(self) -> DataFrame:
        days = growth.daily_uses(self.influencer_edges, "ClientId", "OrderUTC")
        return growth.k_factor(growth.cumulative_uses(days), self.rules)

    def prepare(self) -> None:
        """Make both sides of the analysis, redemptions and behaviour, at the same time.

        Neither needs the other, and the jobs of one fill the tasks the other leaves idle.
        """
        sides = (lambda: self.reach), (lambda: self.means)
        with ThreadPoolExecutor(len(sides)) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(side)) for side in sides]:
                done.result()

    @cached_property
    def child_rows(self) -> DataFrame:
        self.prepare()
        return family.child_behaviour(self.influencer_edges, self.means, self.client_probe)

    @cached_property
    def staged_people(self) -> DataFrame:
        """Users of all stages with their mean behaviour; influencers with all their metrics.

        A client id can belong to an influencer's number and, under the billing phone, to a
        passive one, so the metrics are joined by client and stage.
        """
        self.prepare()
        metrics = (
            self.reach.join(self.k_factors, "ClientId", "left")
            .join(
                family.child_sharing(self.edges, self.influencer_edges, self.client_probe).select(
                    "ClientId", "child_sharing_rate"
                ),
                "ClientId",
                "left",
            )
            .join(family.active_child_fraction(self.child_rows), "ClientId", "left")
            .withColumn("stage", F.lit("influencer"))
        )
        return (
            self.people.join(self.means, "ClientId", "left")
            .join(metrics, ["ClientId", "stage"], "left")
            .withColumn("mean_shares_per_user", ratio(F.col("n_shares"), F.col("n_distinct_users")))
            .withColumn("virality_score", sum((F.col(c) for c in SCORE_PARTS[1:]), F.col(SCORE_PARTS[0])))
        )

    @cached_property
    def user_stages(self) -> DataFrame:
        """One row per user: influencers by score, the others by mean order value."""
        value = F.when(F.col("stage") == "influencer", F.col("virality_score")).otherwise(F.col("mean_AOV"))
        order = [value.desc_nulls_last(), F.col("id").asc()]
        return _renamed(ranked(self.staged_people, "stage", order, "stage_rank", self.workspace), STAGE_COLUMNS)

    def stage_table(self, stage: str) -> DataFrame:
        """The users of one stage with the columns that apply to it."""
        table = self.user_stages.where(F.col("user_type") == stage)
        if stage == "influencer":
            return table
        return table.select(
            "phone_number", "user_name", "n_shares", "client_id", "active", "mean_freq", "mean_gmv", "mean_aov",
            "user_type", "stage_rank",
        )

    @cached_property
    def user_interactions(self) -> DataFrame:
        """Interactions of influencers and intermediate users; passive users have none."""
        typed = stages.typed_edges(self.edges, self.people.where("stage != 'passive'"), self.edge_probe)
        return _renamed(edge_ops.with_similarity(typed), INTERACTION_COLUMNS)


def run(
    spark: SparkSession,
    tables: ShopTables,
    as_of: datetime.date | str,
    rules: Rules | None = None,
    database: str | None = None,
    workspace: Workspace | None = None,
    stages_table: str = STAGES_TABLE,
    interactions_table: str = INTERACTIONS_TABLE,
) -> tuple[DataFrame, DataFrame]:
    """Analyse a campaign; with ``database`` also replace its two result tables, both or neither.

    Pass a ``workspace`` to know the folder of the written steps (``workspace.folder``); the
    frames read from it until their tables are written, then it can be removed.
    """
    campaign = Campaign(spark, tables, as_of, rules, workspace)
    user_stages, user_interactions = campaign.user_stages, campaign.user_interactions
    if database:
        replace_tables(spark, {stages_table: user_stages, interactions_table: user_interactions}, database)
    return user_stages, user_interactions
