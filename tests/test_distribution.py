"""Hot keys, ranks and plans."""

from __future__ import annotations

import random
from functools import cached_property

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from grapevine import session
from grapevine.operators import distinct, skew
from grapevine.operators.distinct import distinct_counts
from grapevine.operators.ranking import ranked
from grapevine.session import Workspace, shared_folder
from tests.frames import rows_of

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark):
    """A third of the rows on key 0, some without a key."""
    big = spark.range(3000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 != 1, F.col("id") % 97).alias("key"),
    )
    small = spark.createDataFrame([(0, "a"), (0, "b"), (5, "c"), (None, "d"), (1000, "e")], "key long, name string")
    return big, small


@pytest.fixture
def hot_from_100(always_skewed, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)


def by_row(big, *keys):
    return skew.Probe(big, *keys)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_balanced_join_equals_the_plain_join(spark, hot_from_100, how):
    big, small = skewed(spark)
    joined = skew.balanced_join(big, small, ["key"], ["row"], by_row(big, ["key"]), how)
    assert "_salt" in plan_of(joined)
    assert joined.columns == big.join(small, ["key"], how).columns
    assert rows_of(joined) == rows_of(big.join(small, ["key"], how))


def test_balanced_join_on_two_keys_with_several_rows_each(spark, hot_from_100):
    big, small = skewed(spark)
    big, small = big.withColumn("day", F.col("row") % 2), small.withColumn("day", F.lit(0).cast("long"))
    joined = skew.balanced_join(big, small, ["key", "day"], ["row"], by_row(big, ["key", "day"]))
    assert "_salt" in plan_of(joined)
    assert rows_of(joined) == rows_of(big.join(small, ["key", "day"]))


def test_a_hot_key_is_dealt_over_many_tasks(spark, hot_from_100):
    big, small = skewed(spark)
    joined = skew.balanced_join(big, small, ["key"], ["row"], by_row(big, ["key"]))
    per_task = joined.where("key = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 6  # of 8 shuffle partitions


def test_one_probe_finds_the_hot_keys_of_several_joins(spark, hot_from_100, monkeypatch):
    big, _ = skewed(spark)
    big = big.withColumn("other", F.when(F.col("row") % 2 == 0, "x").otherwise(F.col("row").cast("string")))
    hash_of_key = big.where("key = 0").select(F.xxhash64("key")).first()[0]
    hash_of_other = big.where("other = 'x'").select(F.xxhash64("other")).first()[0]
    probe = by_row(big, ["key"], ["other"])
    assert probe.hot(["key"]) == {hash_of_key: big.where("key = 0").count()}
    assert probe.hot(["other"]) == {hash_of_other: big.where("other = 'x'").count()}
    with pytest.raises(ValueError):
        probe.hot(["row"])
    monkeypatch.setattr(skew, "HOT_ROWS", 500)
    assert list(by_row(big, ["key"]).hot(["key"])) == [hash_of_key]
    monkeypatch.setattr(skew, "HOT_ROWS", 10**6)
    assert by_row(big, ["key"]).hot(["key"]) == {}


def test_one_key_set_does_not_crowd_out_another(spark, always_skewed):
    rows = spark.range(2000).select((F.col("id") % 8).alias("a"), (F.col("id") % 20).alias("b"))
    probe = skew.Probe(rows, ["a"], ["b"])
    assert len(probe.hot(["a"])) == 8 and len(probe.hot(["b"])) == 20


def test_a_hot_key_whose_rows_are_alike_is_found_and_dealt_out(spark, tmp_path):
    """At default limits: two million of six million attributes are one customer's, all with the same code."""
    path = str(tmp_path / "codes")
    user = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    spark.range(6_000_000).select(user.alias("UserId"), F.lit("1007").alias("ZipCode")).write.parquet(path)
    codes = spark.read.parquet(path)
    probe = skew.Probe(codes, ["UserId"])
    probe.__dict__["large"] = True  # the file is small, as its rows are alike
    hot = probe.hot(["UserId"])
    assert list(hot) == [codes.where("UserId = 7").select(F.xxhash64("UserId")).first()[0]]
    people = spark.range(6_000_000).select(F.col("id").alias("UserId"), F.lit(1).alias("one"))
    joined = skew.balanced_join(codes, people, ["UserId"], None, probe)
    assert "_salt" in plan_of(joined)
    assert joined.count() == 6_000_000


def test_salts_grow_with_the_weight_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    frame = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    hashes = [r[0] for r in frame.select(F.xxhash64("k")).collect()]
    salts = skew._salts(["k"], {hashes[0]: 120, hashes[1]: 5000})
    assert [r[0] for r in frame.select(salts).collect()] == [2, 64, 1]


def test_nothing_is_counted_where_nothing_can_be_skewed(spark, monkeypatch):
    monkeypatch.setattr(skew.Probe, "_found", property(lambda self: pytest.fail("counted")))
    big, small = skewed(spark)
    tiny = spark.sql("SELECT 0L AS key")
    for side in (small, tiny):
        assert "_salt" not in plan_of(skew.balanced_join(big, side, ["key"], ["row"], by_row(big, ["key"])))


def test_unsupported_join_is_refused(spark):
    big, small = skewed(spark)
    with pytest.raises(ValueError, match="outer"):
        skew.balanced_join(big, small, ["key"], ["row"], by_row(big, ["key"]), "outer")


def test_rank_equals_a_window_over_each_group(spark):
    from pyspark.sql import Window as W

    rng = random.Random(1)
    rows = [(i, rng.choice("aaab"), rng.choice([None, 1.0, 2.0, 2.0, rng.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, grp string, value double").repartition(7)
    order = [F.col("value").desc_nulls_last(), F.col("id").asc()]
    found = ranked(df, "grp", order, "place", Workspace(spark))
    expected = df.withColumn("place", F.row_number().over(W.partitionBy("grp").orderBy(*order)))
    assert found.columns == expected.columns
    assert rows_of(found) == rows_of(expected)


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    class Conf(dict):
        def get(self, name, default=None):
            return super().get(name, default)

    class Session:
        conf = Conf({"spark.checkpoint.dir": "hdfs://shared/cp/", "spark.master": "yarn"})

    monkeypatch.setattr(session, "_trial", [])
    assert shared_folder(Session) == "hdfs://shared/cp"
    for master in ("yarn", "local[2]"):
        Session.conf = Conf({"spark.master": master})
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Session)
    session.use_trial_folder(Session)
    assert "grapevine-" in shared_folder(Session)
    monkeypatch.setattr(session, "_trial", [])
    Session.conf = Conf({"spark.master": "yarn"})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.use_trial_folder(Session)


PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow")


@pytest.mark.parametrize(
    "name", ["redemptions", "users", "latest_interaction", "behaviour", "k_factor", "child_sharing", "user_stages"]
)
def test_plans_stay_in_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not any(node in plan for node in PYTHON_NODES)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_growth_factors_shuffle_clients_once(spark):
    from grapevine.operators import growth
    from grapevine.rules import Rules

    days = spark.range(100).selectExpr("id % 9 AS ClientId", "date_add(DATE'2021-01-01', int(id)) AS day", "1L AS uses")
    plan = plan_of(growth.k_factor(growth.cumulative_uses(days), Rules()))
    assert plan.count("Exchange hashpartitioning(ClientId") == 1


def test_name_similarity_is_one_python_step_over_distinct_names(spark):
    plan = plan_of(QUERIES["name_similarity"](spark, SF))
    assert plan.count("+- ArrowEvalPython") == 1
    assert "HashAggregate" in plan[plan.index("ArrowEvalPython") :]


def test_no_written_step_holds_python(spark, monkeypatch):
    from grapevine.session import Workspace

    plans, keep = {}, Workspace.keep

    def watched(self, df, name):
        plans[name] = plan_of(df)
        return keep(self, df, name)

    monkeypatch.setattr(Workspace, "keep", watched)
    QUERIES["user_stages"](spark, SF)
    assert len(plans) > 5
    assert not [name for name, plan in plans.items() if "Python" in plan]


def test_category_flags_scan_the_lines_once(spark):
    plan = plan_of(QUERIES["category_flags"](spark, SF))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "l_extendedprice" in line]
    assert len(scans) == 1


def test_coupon_filter_and_columns_reach_the_scan(spark, tmp_path):
    from grapevine.operators.redemptions import personal_coupons
    from grapevine.rules import Rules

    path = str(tmp_path / "discount")
    spark.createDataFrame([(1, "a-1", "x")], "Id long, CouponCode string, Note string").write.parquet(path)
    plan = plan_of(personal_coupons(spark.read.parquet(path), Rules()).select("CouponCode"))
    assert "Contains(CouponCode,-)" in plan
    assert "ReadSchema: struct<CouponCode:string>" in plan


def test_distinct_counts_equal_the_plain_ones_for_small_and_heavy_groups(spark, always_skewed, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, *"abcdefgh"]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, a string, b long, n long")
    plain = df.groupBy("k").agg(
        F.sum("n").alias("total"), F.count_distinct("a").alias("as"), F.count_distinct("b").alias("bs")
    )

    def found():
        return distinct_counts(df, ["k"], {"as": "a", "bs": "b"}, {"total": F.sum("n")})

    for heavy_from in (700, 1, 10**9):  # one heavy group, all, none
        monkeypatch.setattr(distinct, "SET_ROWS", heavy_from)
        assert ("Union" in plan_of(found())) == (heavy_from < 10**9)
        assert rows_of(found(), *plain.columns) == rows_of(plain)
        assert found().schema["as"].dataType == plain.schema["as"].dataType


def test_ranked_rows_are_made_once(spark):
    """The sort samples its rows for ranges; what makes them must not run again."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(500).selectExpr("id", "id % 3 AS grp").mapInArrow(count, "id long, grp long")
    found = ranked(rows, "grp", [F.col("id")], "place", Workspace(spark))
    assert found.count() == 500 and made.value == 500


def test_a_hot_key_of_a_small_share_is_found(spark):
    """Summaries of default size: 3,000 rows of twenty million are hot when 3,000 are."""
    at = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 6667 == 1, F.lit(-2)).otherwise(F.col("id"))
    rows = spark.range(20_000_000).select(at.alias("k"))
    probe = skew.Probe(rows, ["k"], hot_rows=1800)
    probe.__dict__["large"] = True
    hashes = {r.k: r.h for r in spark.createDataFrame([(-1,), (-2,)], "k long").select("k", F.xxhash64("k").alias("h")).collect()}
    counts = {r.k: r["count"] for r in rows.where("k < 0").groupBy("k").count().collect()}
    found = probe.hot(["k"])
    assert set(found) == set(hashes.values())
    for key, n in counts.items():
        assert n <= found[hashes[key]] <= n + 450  # a quarter of what makes a key hot


def test_a_long_list_of_hot_keys_is_broadcast(spark, hot_from_100, monkeypatch):
    big, small = skewed(spark)
    listed = rows_of(skew.balanced_join(big, small, ["key"], ["row"], by_row(big, ["key"]), "left"))
    monkeypatch.setattr(skew, "LISTED", 0)
    joined = skew.balanced_join(big, small, ["key"], ["row"], by_row(big, ["key"]), "left")
    assert "BroadcastHashJoin" in plan_of(joined)
    assert rows_of(joined) == listed
    per_task = joined.where("key = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 6


def test_each_table_is_probed_by_one_job(spark, always_skewed, monkeypatch):
    from checks.queries import AS_OF, RULES
    from grapevine.plans.campaign import Campaign
    from grapevine.sources.testviews import shop_from_test_tables

    probed, found = [], skew.Probe._found.func

    def watched(self):
        probed.append(tuple(map(tuple, self.key_sets)))
        return found(self)

    counted = cached_property(watched)
    counted.__set_name__(skew.Probe, "_found")
    monkeypatch.setattr(skew.Probe, "_found", counted)
    campaign = Campaign(spark, shop_from_test_tables(spark, SF), AS_OF, RULES)
    campaign.user_stages.count()
    campaign.user_interactions.count()
    assert len(probed) == len(set(probed))
    assert {keys[0][0] for keys in probed} == {
        "DiscountId", "CustomerId", "BillingAddress_Id", "ProductId", "CategoryId",  # shop tables
        "tienda", "ClientId", "phone", "_first",  # store weeks, edges, edges of influencers, names
    }


def test_edges_without_names_and_common_pairs_are_dealt_out(spark, always_skewed, monkeypatch):
    from grapevine.operators import edges as ops

    def name(column):
        return F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("ana")).otherwise(column)

    number = F.col("id").cast("string")
    edges = spark.range(3000).select(
        F.col("id").alias("OrderId"), F.lit("a").alias("from"), number.alias("to"), name(number).alias("Referrer_Name"),
        F.when(F.col("id") % 6 != 0, name(number)).otherwise("bea").alias("Referral_Name"), F.lit("1").alias("ZipCode"),
    )
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    found = ops.with_similarity(edges)
    assert found.columns == [*edges.columns, "name_similarity"]
    assert found.count() == 3000
    assert found.where("name_similarity IS NULL").count() == 1000
    assert found.where("name_similarity = 1").count() == 2000
    for kind in ("Referrer_Name IS NULL", "Referrer_Name = 'ana'"):
        per_task = [r["count"] for r in found.where(kind).groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) >= 6 and max(per_task) < 400


def test_distinct_counts_take_empty_text_and_need_no_second_read(spark):
    df = spark.createDataFrame([(1, ""), (1, None), (1, "a"), (2, None)], "k int, a string")
    found = distinct_counts(df, ["k"], {"n": "a"})
    assert plan_of(found).count("Scan") == 1
    assert rows_of(found) == [(1, 2), (2, 0)]


def test_metrics_of_clients_are_dealt_out_sparingly(spark, always_skewed, monkeypatch):
    """Each side of the joins by client id is shuffled by it once, and the joins themselves not again."""
    from checks.queries import AS_OF, RULES
    from grapevine.plans.campaign import Campaign
    from grapevine.sources.testviews import shop_from_test_tables

    monkeypatch.setattr(skew, "HOT_ROWS", 10**9)
    monkeypatch.setattr(distinct, "SET_ROWS", 10**9)
    plan = plan_of(Campaign(spark, shop_from_test_tables(spark, SF), AS_OF, RULES).staged_people)
    assert plan.count("Exchange hashpartitioning") <= 14
