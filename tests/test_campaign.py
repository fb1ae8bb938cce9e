"""Whole runs on the test tables, and every query against its SQL."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from checks.compare import differences, duckdb_on
from checks.oracle import ORACLE
from checks.queries import QUERIES, RULES
from grapevine import Campaign, run
from grapevine.operators import edges
from grapevine.operators.redemptions import redemptions
from grapevine.plans.campaign import INTERACTION_COLUMNS, STAGE_COLUMNS
from grapevine.sources.testviews import AS_OF, shop_from_test_tables
from tests.frames import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duckdb_on(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, connection, name):
    assert differences(spark, connection, name, SF) == ""


def test_every_query_has_sql_but_the_python_one():
    assert set(QUERIES) - set(ORACLE) == {"name_similarity"}
    assert not set(ORACLE) - set(QUERIES)
    assert set(entry_point.queries()) >= set(QUERIES)
    assert set(entry_point.oracle_sql()) >= set(ORACLE)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_run_writes_both_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS result LOCATION '{tmp_path}'")
    try:
        stages, interactions = run(spark, shop_from_test_tables(spark, SF), AS_OF, RULES, database="result")
        assert rows_of(spark.table("result.user_stages")) == rows_of(stages)
        assert rows_of(spark.table("result.user_interactions")) == rows_of(interactions)
        assert stages.columns == list(STAGE_COLUMNS.values())
        assert interactions.columns == list(INTERACTION_COLUMNS.values())
    finally:
        spark.sql("DROP DATABASE result CASCADE")


def test_result_properties(spark):
    campaign = Campaign(spark, shop_from_test_tables(spark, SF), AS_OF, RULES)
    stages = campaign.user_stages.cache()
    assert stages.select("phone_number").distinct().count() == stages.count()
    assert stages.where("user_type <> 'influencer' AND (k_factor IS NOT NULL OR coupon IS NOT NULL)").count() == 0
    for column in ("vir_users", "vir_physical", "vir_temp", "active", "child_sharing_rate", "active_child_fracc"):
        assert stages.where(~F.col(column).between(0, 1)).count() == 0
    assert stages.where("virality_score IS NOT NULL").count() > 0
    best = stages.where("user_type = 'influencer'").orderBy("stage_rank")
    scores = [r.virality_score for r in best.collect() if r.virality_score is not None]
    assert scores == sorted(scores, reverse=True)
    edges = campaign.user_interactions
    assert edges.count() == campaign.edges.count()
    assert edges.agg(F.sum("n_interactions")).first()[0] == campaign.redemptions.count()


def test_means_write_no_column_they_do_not_need(spark):
    tables = shop_from_test_tables(spark, SF)
    lean, whole = Campaign(spark, tables, AS_OF), Campaign(spark, tables, AS_OF)
    assert whole.lines.where("Sku IS NULL").isEmpty()
    assert sorted(lean.means.collect()) == sorted(whole.means.collect())
    assert "lines" not in lean.__dict__
    (path,) = Path(lean.workspace.folder).glob("lines-for-means-*")
    written = spark.read.parquet(str(path))
    assert written.count() == whole.lines.count()
    assert written.where("coalesce(Sku, categoria, cast(costo AS string), cast(Latitude AS string)) IS NOT NULL").isEmpty()


def test_latest_interaction_holds_every_column_once(spark):
    tables = shop_from_test_tables(spark, SF)
    rows = redemptions(tables, RULES)
    found = edges.latest_interactions(rows)
    assert found.columns == ["from", "to", *[c for c in rows.columns if c not in edges.ENDS], "n_interactions"]
    assert [found.schema[c].dataType for c in rows.columns if c not in edges.ENDS] == [
        rows.schema[c].dataType for c in rows.columns if c not in edges.ENDS
    ]
    assert "max_by" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_influencer_profile_makes_both_sides_at_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(Campaign, "prepare", lambda self: made.append("prepare"))
    assert QUERIES["influencer_profile"](spark, SF).count() and made == ["prepare"]
