from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from grapevine.operators import edges as ops
from grapevine.operators import stages
from tests.frames import edge_frame, redemption_frame, rows_of


def test_latest_interaction_wins_and_is_old(spark):
    rows = redemption_frame(
        spark,
        {"OrderId": 1, "OrderUTC": "2021-01-01 10:00:00"},
        {"OrderId": 2, "OrderUTC": "2021-01-03 10:00:00"},
        {"OrderId": 3, "OrderUTC": "2021-01-02 10:00:00"},
        {"OrderId": 4, "Referral_num": "C"},
    )
    found = rows_of(ops.interactions(rows), "OrderId", "n_interactions", "IsNewCustomer")
    assert found == [(2, 3, "OLD"), (4, 1, "NEW CUSTOMER")]


def test_a_missing_time_counts_as_latest(spark):
    rows = redemption_frame(spark, {"OrderId": 1}, {"OrderId": 2, "OrderUTC": None})
    assert rows_of(ops.latest_interactions(rows), "OrderId") == [(2,)]


def test_equal_times_go_to_the_lowest_total_then_order(spark):
    rows = redemption_frame(
        spark,
        {"OrderId": 1, "GMV_after_discount": 9},
        {"OrderId": 3, "GMV_after_discount": 5},
        {"OrderId": 2, "GMV_after_discount": 5},
    )
    assert rows_of(ops.latest_interactions(rows), "OrderId") == [(2,)]
    same_order = redemption_frame(spark, {"ClientId": 5}, {"ClientId": 4}, {"ClientId": 6})
    assert rows_of(ops.latest_interactions(same_order), "ClientId") == [(4,)]
    with_unknown = rows.unionByName(redemption_frame(spark, {"OrderId": 9, "GMV_after_discount": None}))
    assert rows_of(ops.latest_interactions(with_unknown), "OrderId") == [(9,)]


def test_labels_and_missing_ends(spark):
    rows = redemption_frame(
        spark,
        {"OrderId": 1, "Referrer_num": None, "ZipCode": None},
        {"OrderId": 2, "Referrer_num": None, "ZipCode": None, "OrderUTC": "2022-01-01 00:00:00"},
    )
    found = rows_of(ops.interactions(rows), "OrderId", "from", "zip_code", "store_key", "StoreId", "week")
    assert found == [(2, None, "zc-nan", "SId-7", 7, "w-2101")]


def test_users_take_the_referrers_name_from_the_lowest_total(spark):
    rows = redemption_frame(
        spark,
        {"OrderId": 1, "Referrer_Name": "ana", "GMV_after_discount": 50},
        {"OrderId": 2, "Referrer_Name": "anita", "GMV_after_discount": 5},
        {"OrderId": 3, "Referrer_num": "B", "Referrer_Name": "beatriz", "Referral_num": "A", "Referral_Name": "zoe", "GMV_after_discount": 1},
        {"OrderId": 4, "Referral_num": "C", "Referral_Name": "cleo"},
    )
    assert rows_of(ops.users(rows)) == [
        ("A", "anita", "Intermediate user", 3),
        ("B", "beatriz", "Intermediate user", 1),
        ("C", "cleo", "End user", 0),
    ]


def test_a_missing_referrer_number_has_no_shares(spark):
    rows = redemption_frame(spark, {"Referrer_num": None})
    assert rows_of(ops.users(rows), "id", "user_type", "n_shares") == [
        ("B", "End user", 0),
        (None, "Intermediate user", 0),
    ]
    assert ops.share_counts(rows).count() == 0


def test_client_of_a_number_is_the_one_with_fewest_interactions(spark):
    rows = edge_frame(
        spark,
        {"OrderId": 1, "ClientId": 1, "n_interactions": 3, "to": "X", "childId": 8},
        {"OrderId": 2, "ClientId": 5, "n_interactions": 1, "to": "Y", "childId": 9},
        {"OrderId": 3, "ClientId": 1, "n_interactions": 2, "to": "Y", "childId": 7},
    )
    assert rows_of(ops.phone_clients(rows)) == [("A", 5, None), ("X", None, 8), ("Y", None, 9)]


@pytest.mark.parametrize("seed", range(3))
def test_properties_on_random_redemptions(spark, seed):
    import random

    rng = random.Random(seed)
    rows = redemption_frame(
        spark,
        *[
            {
                "OrderId": i,
                "ClientId": (c := int(rng.paretovariate(0.8)) % 20),
                "Referrer_num": f"p{c}",
                "childId": (k := rng.randrange(30)),
                "Referral_num": f"p{k}",
                "GMV_after_discount": rng.randrange(100),
                "OrderUTC": f"2021-01-{rng.randrange(1, 29):02d} 10:00:00",
            }
            for i in range(300)
        ],
    ).cache()
    interactions = ops.latest_interactions(rows).cache()
    people = stages.with_stage(ops.people(ops.users(rows), interactions)).cache()
    assert interactions.agg(F.sum("n_interactions")).first()[0] == 300
    assert interactions.select("from", "to").distinct().count() == interactions.count()
    assert people.select("id").distinct().count() == people.count()
    assert people.agg(F.sum("n_shares")).first()[0] == 300
    assert stages.sharers(people).count() == (
        stages.influencers(people).count() + stages.intermediates(people).count()
    )
    assert {r.stage: r["count"] for r in people.groupBy("stage").count().collect()} == {
        "influencer": stages.influencers(people).count(),
        "intermediate": stages.intermediates(people).count(),
        "passive": stages.non_sharers(people).count(),
    }
    assert people.where("ClientId IS NULL").count() == 0


def test_a_user_at_the_mean_is_intermediate(spark):
    users = spark.createDataFrame([("A", 2), ("B", 2), ("C", 0)], "id string, n_shares long")
    found = stages.with_stage(users).select("id", "stage")
    assert rows_of(found) == [("A", "intermediate"), ("B", "intermediate"), ("C", "passive")]
