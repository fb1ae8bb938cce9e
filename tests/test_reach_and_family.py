from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grapevine.operators import family, reach
from grapevine.rules import Rules
from tests.frames import MEANS, edge_frame, rows_of


def test_a_missing_postal_code_counts_once(spark):
    edges = edge_frame(
        spark,
        {"to": "B", "ZipCode": None, "StoreName": "s", "week": "w-nan"},
        {"to": "C", "ZipCode": None, "StoreName": "t", "week": "w-2101"},
        {"to": "D", "ZipCode": "100", "StoreName": "t", "week": "w-2101"},
    )
    found = reach.reach(edges, Rules(zipcode_weight=2.0, store_weight=0.5))
    assert rows_of(found, "n_distinct_users", "delivery_zipcodes", "delivery_stores", "n_active_weeks", "places") == [
        (3, 2, 2, 2, 5.0)
    ]
    assert rows_of(reach.client_zipcodes(edges)) == [(1, "100", 2), (1, None, 2)]
    assert rows_of(reach.client_weeks(edges)) == [(1, "2101", 2), (1, "nan", 2)]
    assert rows_of(reach.shares_by_week(edges)) == [(1, "2101", 2), (1, "nan", 1)]


def test_one_influencer_alone_has_no_scaled_virality(spark):
    found = reach.with_virality(reach.reach(edge_frame(spark, {}), Rules()))
    assert rows_of(found, "vir_users", "vir_physical", "vir_temp") == [(None, None, None)]


def test_coupon_conflicts_are_reported_or_stop_the_run(spark):
    edges = edge_frame(spark, {"to": "B"}, {"to": "C", "CouponCode": "ana-1"}, {"ClientId": 2})
    assert rows_of(reach.coupon_conflicts(edges)) == [(1, 2, 1), (2, 1, 0)]
    assert reach.client_coupon(edges, Rules()).count() == 2
    stop = Rules(stop_on_coupon_conflict=True)
    for build in (reach.client_coupon, reach.reach):
        with pytest.raises(PySparkException, match="more than one coupon"):
            build(edges, stop).collect()
    assert reach.reach(edges.where("ClientId = 2"), stop).count() == 1


def test_self_interactions(spark):
    edges = edge_frame(spark, {"to": "A", "n_interactions": 4}, {"to": "B"}, {"ClientId": 2, "from": "Z"})
    assert rows_of(reach.self_interactions(edges)) == [(1, 4), (2, 0)]


def test_child_sharing_leaves_the_parent_out(spark):
    edges = edge_frame(
        spark,
        {"to": "A", "childId": 1},
        {"to": "B", "childId": 2},
        {"to": "C", "childId": 3},
        {"ClientId": 2, "from": "B", "to": "X"},
        {"ClientId": 22, "from": "B", "to": "Y"},  # a second client behind the number B
        {"ClientId": 2, "from": "B", "to": "Z"},
    )
    mine = edges.where("ClientId = 1")
    assert rows_of(family.child_sharing(edges, mine)) == [(1, 2, 2, 1.0)]


def test_child_sharing_rate_rounds_half_to_even_and_survives_no_children(spark):
    rows = [{"to": f"c{i}", "childId": i, "OrderId": i} for i in range(32)]
    edges = edge_frame(spark, *rows, {"ClientId": 90, "from": "c0", "to": "q"}, {"ClientId": 7, "from": "S", "to": "S"})
    found = rows_of(family.child_sharing(edges, edges.where("ClientId IN (1, 7)")))
    assert found == [(1, 32, 1, 3.12 / 100), (7, 0, 0, None)]  # from 3.125 % and 0/0


def test_a_missing_child_number_counts_as_one_child(spark):
    edges = edge_frame(spark, {"to": None}, {"to": "B"}, {"ClientId": 5, "from": None, "to": "Q"})
    assert rows_of(family.child_sharing(edges, edges.where("ClientId = 1"))) == [(1, 2, 1, 0.5)]


@pytest.mark.parametrize(
    ("edges", "children"),
    [
        # own number and id among the invited: both out
        ([{"to": "A", "childId": 1}, {"to": "B", "childId": 2}], [2]),
        # own number, but another id behind it: nothing to take out
        ([{"to": "A", "childId": 9}, {"to": "B", "childId": 2}], [2, 9]),
        # own id under another number: it stays
        ([{"to": "K", "childId": 1}, {"to": "B", "childId": 2}], [1, 2]),
    ],
)
def test_children(spark, edges, children):
    found = family.children(edge_frame(spark, *edges))
    assert rows_of(found) == [(1, c) for c in children]


def test_an_own_number_under_another_id_is_reported(spark):
    edges = edge_frame(
        spark,
        {"ClientId": 1, "from": "A", "to": "A", "childId": 9},
        {"ClientId": 2, "from": "B", "to": "B", "childId": 2},
        {"ClientId": 3, "from": "C", "to": "K", "childId": 3},
    )
    assert rows_of(family.self_mismatches(edges)) == [(1,)]


def test_family_metrics(spark):
    edges = edge_frame(
        spark, {"to": "B", "childId": 2}, {"to": "C", "childId": 3}, {"to": "D", "childId": 4}, {"ClientId": 8, "from": "Z", "to": "D", "childId": 4}
    )
    means = spark.createDataFrame(
        [(1, 1.0, 2.0, 3.0, 4.0), (2, 1.0, 1.0, 1.0, None), (3, 0.0, 1.0, 5.0, 6.0)], MEANS
    )
    parents, children = family.users_metrics(edges, edges, means)
    assert rows_of(children) == [(1, 2, 1.0, 1.0, 1.0, None), (1, 3, 0.0, 1.0, 5.0, 6.0)]
    assert rows_of(parents) == [
        (1, 1.0, 2.0, 3.0, 4.0, 0.0, 0.5),
        (8, None, None, None, None, 0.0, None),
    ]


def test_rates_round_as_the_binary_value_does(spark):
    from grapevine.functions.scaling import rounded_to_cents

    pairs = [(s, n) for n in range(1, 1200) for s in range(0, n + 1, max(1, n // 40))] + [(3, 4000), (1, 32), (25, 800)]
    frame = spark.createDataFrame([(s * 100 / n,) for s, n in pairs], "v double")
    found = frame.select("v", rounded_to_cents(F.col("v")).alias("r")).collect()
    assert [(r.v, r.r) for r in found] == [(s * 100 / n, round(s * 100 / n, 2)) for s, n in pairs]
    assert (0.075, 0.07) in {(r.v, r.r) for r in found} and (3.125, 3.12) in {(r.v, r.r) for r in found}
