from __future__ import annotations

import os

import pytest

from grapevine.sources.testviews import BRAND_COUPON, PROMO_COUPON, shop_from_test_tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("customers", [7, 15_000, 2_097_152, 5_400_000])
def test_coupon_uses_are_exact_for_very_many_customers(spark, tmp_path, customers):
    """The cube of a customer number does not fit 64 bits above 2,097,152 customers."""
    for name in ("lineitem", "part", "supplier"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    made = spark.range(customers).selectExpr("id AS c_custkey", "1 AS c_nationkey", "'BUILDING' AS c_mktsegment")
    made.write.parquet(f"{tmp_path}/customer.parquet")
    last = pow(31, -1, customers) * (customers - 1) % customers  # its order's number of a customer is the largest
    keys = sorted({*range(50), last, *range(customers // 2, customers // 2 + 50), *(10**9 + i * 7919 for i in range(2000))})
    orders = spark.createDataFrame([(k,) for k in keys], "o_orderkey long").selectExpr(
        "o_orderkey", "0L AS o_custkey", "1.0D AS o_totalprice", "TIMESTAMP_NTZ'2000-01-01 00:00:00' AS o_orderdate"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")

    def discount(key: int) -> int:
        special = BRAND_COUPON if key % 40 == 0 else PROMO_COUPON if key % 44 == 0 else None
        return special or (key * 31 % customers) ** 3 // customers**2

    uses = shop_from_test_tables(spark, str(tmp_path)).discount_usage.select("OrderId", "DiscountId")
    assert sorted(tuple(row) for row in uses.collect()) == [(key, discount(key)) for key in keys]
