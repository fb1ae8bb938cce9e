from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from grapevine.functions.scaling import ratio, virality_curve, with_minmax
from grapevine.functions.text import name_similarity, store_label, untagged, week_label, zip_label


@pytest.mark.parametrize(
    ("value", "label"),
    [
        ("01000", "zc-1000"),
        (" 12 ", "zc-12"),
        ("-5", "zc--5"),
        ("12.7", "zc-nan"),
        ("x", "zc-nan"),
        ("", "zc-nan"),
        (None, "zc-nan"),
    ],
)
def test_labels(spark, value, label):
    row = spark.createDataFrame([(value, 7)], "z string, s long").select(
        zip_label(F.col("z")).alias("z"), store_label(F.col("s")).alias("s"), untagged(week_label(F.lit("0053"))).alias("w")
    )
    assert tuple(row.first()) == (label, "SId-7", "53")


def test_name_similarity_is_not_symmetric_and_keeps_missing_names(spark):
    names = [("tide", "diet"), ("diet", "tide"), ("ana", "ana"), ("", ""), (None, "ana"), ("ana", None), ("María", "maria")]
    frame = spark.createDataFrame(names, "a string, b string")
    rows = frame.select("a", "b", name_similarity("a", "b").alias("s")).collect()
    for a, b, s in rows:
        expected = None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
        assert s == expected
    assert {(r.a, r.b): r.s for r in rows}[("tide", "diet")] == 0.25


def test_ratio_of_zero_is_null(spark):
    row = spark.sql("SELECT 1 AS a, 0 AS b, CAST(0 AS DECIMAL(18,4)) AS c")
    assert row.select(ratio(F.col("a"), F.col("b")), ratio(F.col("a"), F.col("c"))).first() == (None, None)


def test_minmax_scales_and_a_single_value_is_null(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (4, 5)], "a int, b int")
    rows = with_minmax(df, {"sa": "a", "sb": "b"}).orderBy("a").collect()
    assert [r.sa for r in rows] == [0.0, 1 / 3, 1.0]
    assert [r.sb for r in rows] == [None] * 3


def test_virality_curve_at_one_and_at_day_zero(spark):
    df = spark.createDataFrame([(0.0, 2.0), (3.0, 1.0), (3.0, 2.0)], "t double, k double")
    values = [r[0] for r in df.select(virality_curve(F.col("t"), F.col("k"), F.lit(4.0))).collect()]
    assert values == [0.0, 12.0, 28.0]
