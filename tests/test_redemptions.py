from __future__ import annotations

from grapevine.operators import redemptions as ops
from grapevine.operators import skew
from grapevine.rules import Rules
from tests.frames import moment, rows_of, shop

T = moment("2021-03-05 12:00:00")
BORN = moment("2020-01-01 00:00:00")


def small_shop(spark, **more):
    tables = dict(
        discount=[(1, "ana-1"), (2, "CLUB-10"), (3, "club-9"), (4, "PROMO"), (5, "Bea-2"), (6, None)],
        customer=[
            (1, "A", "ANA-1", 11, BORN),
            (2, "B", "bea-2", 12, BORN),
            (3, "C", "CLUB-10", 13, BORN),
            (4, "D", "Ana-1", 14, BORN),  # holds the same code as 1
            (5, "E", None, 15, BORN),
        ],
        address=[(11, "ana", "A"), (12, "bea", "B2"), (13, "cleo", "C"), (14, "dan", "D"), (15, "eva", "E")],
        store=[(1, "one", "100", 1.0, 2.0)],
        order=[(100, 2, 1, 12, T, 10.0), (101, 5, 1, 15, T, 20.0), (102, 2, 9, 12, T, 30.0), (103, 1, 1, 11, T, 5.0)],
        discount_usage=[(100, 1, T), (101, 5, T), (101, 2, T), (102, 1, T), (103, 4, T), (103, 6, T), (999, 1, T)],
    )
    return shop(spark, **(tables | more))


def test_personal_coupons_ignore_case_of_the_brand(spark):
    assert [r[0] for r in rows_of(ops.personal_coupons(small_shop(spark).discount, Rules()))] == [1, 5]
    other = ops.personal_coupons(small_shop(spark).discount, Rules(brand_prefix="bea"))
    assert [r[0] for r in rows_of(other)] == [1, 2, 3]


def test_coupon_matches_holders_in_any_case_and_fans_out(spark):
    found = rows_of(ops.referrer_of_coupon(small_shop(spark), Rules()), "DiscountId", "CouponCode", "ClientId")
    assert found == [(1, "ana-1", 1), (1, "ana-1", 4), (5, "Bea-2", 2)]


def test_redemptions_drop_what_has_no_order_store_or_personal_code(spark):
    rows = ops.redemptions(small_shop(spark), Rules())
    assert rows_of(rows, "OrderId", "ClientId", "Referrer_num", "Referral_num", "childId", "IsNewCustomer", "week") == [
        (100, 1, "A", "B2", 2, "OLD", "2109"),
        (100, 4, "D", "B2", 2, "OLD", "2109"),
        (101, 2, "B", "E", 5, "OLD", "2109"),
    ]


def test_redemptions_are_the_same_with_salted_joins(spark, always_skewed, monkeypatch):
    salted = []
    join = ops.balanced_join

    def watched(*args):
        out = join(*args)
        salted.append("_salt" in out._jdf.queryExecution().analyzed().toString())
        return out

    monkeypatch.setattr(ops, "balanced_join", watched)
    found = rows_of(ops.redemptions(small_shop(spark), Rules()))
    assert len(salted) == 7 and all(salted)
    monkeypatch.setattr(skew, "HOT_ROWS", 10**9)
    assert rows_of(ops.redemptions(small_shop(spark), Rules())) == found
    assert len(salted) == 14 and not any(salted[7:])


def test_buyer_orders_show_the_buyer_at_both_ends(spark):
    rows = ops.buyer_coupon_orders(small_shop(spark), Rules())
    assert rows_of(rows, "OrderId", "ClientId", "Referrer_num", "Referrer_Name", "Referral_Name", "Referral_num") == [
        (100, 2, "B", "bea", "bea", "B2"),
        (101, 5, "E", "eva", "eva", "E"),
    ]


def test_customer_zip_takes_the_postal_attribute_only(spark):
    tables = small_shop(
        spark,
        generic_attribute=[
            (1, "Customer", "ZipPostalCode", "100"),
            (1, "Customer", "Gender", "F"),
            (2, "Vendor", "ZipPostalCode", "200"),
            (77, "Customer", "ZipPostalCode", "300"),
        ],
    )
    assert rows_of(ops.customer_zip(tables), "UserId", "PhoneNumber", "ZipCode") == [(1, "A", "100")]
