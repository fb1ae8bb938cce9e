"""Shop tables derived from the shared test tables by integer arithmetic.

The test tables hold no coupons; these views give every shop table a value that SQL engines
agree on. The rules are those of FIXTURES.md, section 3, but every order uses a coupon, so that
all rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapevine.sources.schemas import CATEGORY_FLAGS, ShopTables

BRAND_COUPON, PROMO_COUPON = -1, -2
BRAND_CODE_HOLDER = 11  # a customer whose own code is the brand coupon's
AS_OF = "2001-08-10"


# The columns used here; a declared schema spares a look into every file.
TEST_TABLES = {
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double",
    "part": "p_partkey long, p_name string, p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int",
}


def shop_from_test_tables(spark: SparkSession, sf_dir: str) -> ShopTables:
    def table(name: str) -> DataFrame:
        return spark.read.schema(TEST_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    customers, orders, lines = table("customer"), table("orders"), table("lineitem")
    parts, suppliers = table("part"), table("supplier")

    def size(df: DataFrame):
        return df.agg(F.count(F.lit(1))).scalar()

    key = F.col("c_custkey")
    own_code = F.when(key == BRAND_CODE_HOLDER, "CLUB-10").otherwise(
        F.concat(F.upper(F.substring("c_mktsegment", 1, 4)), F.lit("-"), key.cast("string"))
    )
    phone = F.concat(F.lit("55"), F.lpad(key.cast("string"), 8, "0"))

    customer = customers.select(
        key.alias("Id"),
        F.when(key % 50 == 7, F.concat(F.lit("user"), key.cast("string"))).otherwise(phone).alias("username"),
        own_code.alias("ReferralCode"),
        key.alias("BillingAddress_Id"),
        F.date_add(F.lit("1995-01-01").cast("date"), (key * 37 % 2400).cast("int")).alias("CreatedOnUtc"),
    )

    address = (
        customers.select(key.alias("Id"), phone.alias("PhoneNumber"), (key % size(parts)).alias("p_partkey"))
        .join(parts.select("p_partkey", F.col("p_name").alias("Firstname")), "p_partkey")
        .select("Id", "Firstname", "PhoneNumber")
    )

    placed = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(F.col("o_orderkey") * 7919 % 86400).cast("decimal(18,6)")
    )
    order = orders.select(
        F.col("o_orderkey").alias("Id"),
        F.col("o_custkey").alias("CustomerId"),
        ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % size(suppliers)).alias("StoreId"),
        F.col("o_custkey").alias("BillingAddressId"),
        placed.alias("CreatedOnUtc"),
        F.col("o_totalprice").alias("OrderTotal"),
    )

    n = size(customers)
    spread = F.col("o_orderkey") * 31 % n
    # The cube of spread by the square of n. Every product is divided at once, and what that leaves is added at the
    # end: the cube itself outgrows 64 bits above 2,097,152 customers, the largest number here above 2 billion.
    heavy_tailed = F.expr("cube + (cube_rest * n + square_rest * spread) div (n * n)")
    usage = (
        orders.select("o_orderkey", placed.alias("CreatedOnUtc"), spread.alias("spread"), n.alias("n"))
        .withColumns({"square": F.expr("spread * spread div n"), "square_rest": F.expr("spread * spread % n")})
        .withColumns({"cube": F.expr("square * spread div n"), "cube_rest": F.expr("square * spread % n")})
        .select(
            F.col("o_orderkey").alias("OrderId"),
            F.when(F.col("o_orderkey") % 40 == 0, BRAND_COUPON)
            .when(F.col("o_orderkey") % 44 == 0, PROMO_COUPON)
            .otherwise(heavy_tailed)
            .alias("DiscountId"),
            "CreatedOnUtc",
        )
    )

    personal = customers.where(key != BRAND_CODE_HOLDER).select(
        key.alias("Id"), F.when(key % 2 == 1, F.lower(own_code)).otherwise(own_code).alias("CouponCode")
    )
    campaign = spark.sql(
        f"SELECT * FROM VALUES ({BRAND_COUPON}L, 'CLUB-10'), ({PROMO_COUPON}L, 'PROMO') AS t(Id, CouponCode)"
    )

    nation = F.col("s_nationkey")
    store = suppliers.select(
        F.col("s_suppkey").alias("Id"),
        F.col("s_name").alias("Name"),
        F.when(F.col("s_suppkey") % 10 != 0, (nation + 1000).cast("string")).alias("ZipCode"),
        (19 + F.col("s_suppkey") % 100 / F.lit(100.0)).alias("Latitud"),
        (-99 - nation / F.lit(100.0)).alias("Longitud"),
    )

    order_item = lines.join(
        parts.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey"
    ).select(
        F.col("l_orderkey").alias("OrderId"),
        F.col("l_partkey").alias("ProductId"),
        F.col("l_quantity").alias("Quantity"),
        F.when(F.col("l_orderkey") % 97 == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("PriceExclTax"),
        (F.col("p_retailprice").cast("decimal(18,4)") * F.lit("0.6").cast("decimal(2,1)")).alias(
            "OriginalProductCost"
        ),
    )

    part = F.col("p_partkey")
    product = parts.select(part.alias("Id"), F.concat(F.lit("SKU-"), part.cast("string")).alias("Sku"))
    ids = F.array(*[F.lit(i) for i in CATEGORY_FLAGS])
    numbers = F.when(part % 13 == 0, F.array().cast("array<bigint>")).otherwise(
        F.when(part % 11 == 0, F.array(part % 20, (part + 7) % 20)).otherwise(F.array(part % 20))
    )
    product_category = parts.select(part.alias("ProductId"), F.explode(numbers).alias("number")).select(
        "ProductId", F.element_at(ids, (F.col("number") + 1).cast("int")).alias("CategoryId")
    )
    names = ", ".join(f"({i}, '{name}')" for i, name in CATEGORY_FLAGS.items())
    category = spark.sql(f"SELECT * FROM VALUES {names} AS t(Id, Name)")

    attribute = customers.select(
        key.alias("EntityId"),
        F.lit("Customer").alias("KeyGroup"),
        F.explode(
            F.array(
                F.struct(
                    F.lit("ZipPostalCode").alias("Key"),
                    (F.col("c_nationkey") + 1000).cast("string").alias("Value"),
                ),
                F.struct(F.lit("Gender").alias("Key"), F.lit("X").alias("Value")),
            )
        ).alias("pair"),
    ).select("EntityId", "KeyGroup", "pair.Key", "pair.Value")

    return ShopTables.of(
        {
            "discount_usage": usage,
            "discount": personal.unionByName(campaign),
            "order": order,
            "customer": customer,
            "address": address,
            "store": store,
            "order_item": order_item,
            "product": product,
            "product_category": product_category,
            "category": category,
            "generic_attribute": attribute,
        }
    )
