"""Coupon redemptions: who used whose personal code, on which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapevine.functions.calendar import customer_novelty, local_time, week_code
from grapevine.operators.skew import balanced_join
from grapevine.rules import Rules
from grapevine.sources.schemas import ShopTables


def _is_personal(code: Column, rules: Rules) -> Column:
    """Personal codes contain a dash and do not start with the brand prefix, in any case."""
    return code.contains("-") & ~F.lower(code).startswith(rules.brand_prefix.lower())


def personal_coupons(discount: DataFrame, rules: Rules) -> DataFrame:
    """Discounts whose code is a customer's own code."""
    return discount.where(_is_personal(F.col("CouponCode"), rules))


def referrer_of_coupon(tables: ShopTables, rules: Rules) -> DataFrame:
    """Each personal coupon with every customer holding that code, ignoring case.

    A code held by several customers yields one row per holder. Both sides keep only
    personal codes, so blank or missing codes, however many, never reach the shuffle.
    """
    coupons = personal_coupons(tables.discount, rules).select(
        F.col("Id").alias("DiscountId"), "CouponCode", F.lower("CouponCode").alias("code")
    )
    holders = tables.customer.where(_is_personal(F.col("ReferralCode"), rules)).select(
        F.col("Id").alias("ClientId"),
        F.col("username").alias("Referrer_num"),
        "BillingAddress_Id",
        F.lower("ReferralCode").alias("code"),
    )
    return balanced_join(holders, coupons, ["code"], ["ClientId"], tables.probes["customer"]).select(
        "DiscountId", "CouponCode", "ClientId", "Referrer_num", "BillingAddress_Id"
    )


def _named(rows: DataFrame, client: str, tables: ShopTables, **columns: str) -> DataFrame:
    """Rows of customers with columns of their billing address under new names."""
    addresses = tables.address.select(
        F.col("Id").alias("BillingAddress_Id"), *[F.col(old).alias(new) for new, old in columns.items()]
    )
    probe = tables.probes["customer"]
    return balanced_join(rows, addresses, ["BillingAddress_Id"], [client], probe).drop("BillingAddress_Id")


def redemptions(tables: ShopTables, rules: Rules) -> DataFrame:
    """One row per use of a personal code by an order: referrer, buyer, week, store.

    Coupons find their holders first, on the small tables; the usage rows then meet the
    orders, the buyers and the stores. No sort: the steps that need the order total's order
    take it from the values.
    """
    owners = _named(referrer_of_coupon(tables, rules), "ClientId", tables, Referrer_Name="Firstname")
    usage = tables.discount_usage.select("OrderId", "DiscountId", F.col("CreatedOnUtc").alias("OrderUTC"))
    uses = tables.probes["discount_usage"]
    used = balanced_join(usage, owners, ["DiscountId"], ["OrderId"], uses)

    orders = tables.order.select(
        F.col("Id").alias("OrderId"),
        F.col("CustomerId").alias("childId"),
        "StoreId",
        F.col("CreatedOnUtc").alias("placed"),
        F.col("OrderTotal").alias("GMV_after_discount"),
    )
    placed = balanced_join(used, orders, ["OrderId"], ["DiscountId"], uses)

    buyers = _named(
        tables.customer.select(
            F.col("Id").alias("childId"), F.col("CreatedOnUtc").alias("born"), "BillingAddress_Id"
        ),
        "childId",
        tables,
        Referral_Name="Firstname",
        Referral_num="PhoneNumber",
    )
    stores = tables.store.select(F.col("Id").alias("StoreId"), F.col("Name").alias("StoreName"), "ZipCode")
    # Buyers and stores that are hot among the coupon orders are hot among all orders.
    parties = tables.probes["order"].called({"CustomerId": "childId"})
    bought = balanced_join(placed, buyers, ["childId"], ["OrderId"], parties)
    sold = balanced_join(bought, stores, ["StoreId"], ["OrderId"], parties)
    return sold.select(
        "OrderId",
        "OrderUTC",
        "CouponCode",
        "ClientId",
        "Referrer_num",
        "Referrer_Name",
        "Referral_Name",
        "Referral_num",
        "childId",
        "GMV_after_discount",
        week_code(local_time(F.col("placed"), rules.utc_lag_hours)).alias("week"),
        customer_novelty(F.col("born"), F.col("placed"), rules.utc_lag_hours).alias("IsNewCustomer"),
        "StoreName",
        "StoreId",
        "ZipCode",
    )


def split_identities(tables: ShopTables) -> DataFrame:
    """Customers whose own number is not the phone of their billing address.

    People are told apart by number: such a customer is one person as a referrer and another as a
    buyer. A customer without a billing address is none, one who lacks either number is listed.
    """
    people = tables.customer.select(F.col("Id").alias("ClientId"), F.col("username").alias("own_number"), "BillingAddress_Id")
    known = _named(people, "ClientId", tables, billing_number="PhoneNumber")
    return known.where(~F.col("own_number").eqNullSafe(F.col("billing_number")))


def buyer_coupon_orders(tables: ShopTables, rules: Rules) -> DataFrame:
    """Orders paid with a personal code, seen from the buyer alone.

    The referrer columns hold the buyer's own number and name. Sorted by coupon; the order
    id continues the sort so that a very popular coupon still spreads over several tasks.
    """
    coupons = personal_coupons(tables.discount, rules).select(F.col("Id").alias("DiscountId"), "CouponCode")
    usage = tables.discount_usage.select("OrderId", "DiscountId", F.col("CreatedOnUtc").alias("OrderUTC"))
    orders = tables.order.select(
        F.col("Id").alias("OrderId"),
        F.col("CustomerId").alias("ClientId"),
        "StoreId",
        F.col("CreatedOnUtc").alias("placed"),
        F.col("OrderTotal").alias("GMV_after_discount"),
    )
    buyers = _named(
        tables.customer.select(
            F.col("Id").alias("ClientId"),
            F.col("username").alias("Referrer_num"),
            F.col("CreatedOnUtc").alias("born"),
            "BillingAddress_Id",
        ),
        "ClientId",
        tables,
        Referrer_Name="Firstname",
        Referral_num="PhoneNumber",
    )
    stores = tables.store.select(F.col("Id").alias("StoreId"), F.col("Name").alias("StoreName"), "ZipCode")
    uses = tables.probes["discount_usage"]
    parties = tables.probes["order"].called({"CustomerId": "ClientId"})
    used = balanced_join(usage, coupons, ["DiscountId"], ["OrderId"], uses)
    placed = balanced_join(used, orders, ["OrderId"], ["DiscountId"], uses)
    bought = balanced_join(placed, buyers, ["ClientId"], ["OrderId"], parties)
    sold = balanced_join(bought, stores, ["StoreId"], ["OrderId"], parties)
    return sold.select(
        "OrderId",
        "OrderUTC",
        "CouponCode",
        "ClientId",
        "Referrer_num",
        "Referrer_Name",
        F.col("Referrer_Name").alias("Referral_Name"),
        "Referral_num",
        "GMV_after_discount",
        week_code(local_time(F.col("placed"), rules.utc_lag_hours)).alias("week"),
        customer_novelty(F.col("born"), F.col("placed"), rules.utc_lag_hours).alias("IsNewCustomer"),
        "StoreName",
        "StoreId",
        "ZipCode",
    ).orderBy("CouponCode", "OrderId")


def customer_zip(tables: ShopTables) -> DataFrame:
    """Each customer's billing phone and the postal code among their attributes."""
    wanted = (F.col("KeyGroup") == "Customer") & (F.col("Key") == "ZipPostalCode")
    codes = tables.generic_attribute.where(wanted).select(
        F.col("EntityId").alias("UserId"), "EntityId", F.col("Value").alias("ZipCode")
    )
    phones = tables.address.select(F.col("Id").alias("BillingAddress_Id"), F.col("Id").alias("AddressId"), "PhoneNumber")
    people = tables.customer.select(F.col("Id").alias("UserId"), "BillingAddress_Id")
    located = balanced_join(people, phones, ["BillingAddress_Id"], ["UserId"], tables.probes["customer"])
    owned = tables.probes["generic_attribute"].called({"EntityId": "UserId"})
    return balanced_join(codes, located, ["UserId"], None, owned).select(
        "AddressId", "PhoneNumber", "UserId", "BillingAddress_Id", "EntityId", "ZipCode"
    )
