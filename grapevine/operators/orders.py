"""Order lines and the weekly customer behaviour built from them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grapevine.functions.calendar import delivery_date, week_start
from grapevine.functions.scaling import ratio
from grapevine.operators.distinct import distinct_counts
from grapevine.operators.skew import Probe, balanced_join
from grapevine.rules import Rules
from grapevine.sources.schemas import CATEGORY_FLAGS, ShopTables


def order_lines(tables: ShopTables, rules: Rules) -> DataFrame:
    """Order lines with cost, category, store place, delivery date and week.

    A line appears once per category of its product, and not at all if the product has none
    or if the order lacks its customer, address or store. Orders and products are completed
    on their own side first, so each line crosses the network at most twice. Orders come
    last: that leaves an order's lines side by side, and the aggregates that follow combine
    them before they shuffle. With ``dedupe_lines``, ``main_filing`` marks the repetition with
    the product's lowest category, and the aggregates below count the money of that one alone.
    """
    orders = tables.order
    heads = orders.select(
        F.col("Id").alias("OrderId"),
        F.col("CustomerId").alias("cliente"),
        F.col("StoreId").alias("storeid"),
        "BillingAddressId",
        delivery_date(F.col("CreatedOnUtc"), rules.utc_lag_hours, rules.cutoff_hour).alias("fecha"),
    ).withColumn("semana", week_start(F.col("fecha"), rules.strict_week))
    customers = tables.customer.select(F.col("Id").alias("cliente"))
    addresses = tables.address.select(F.col("Id").alias("BillingAddressId"))
    stores = tables.store.select(
        F.col("Id").alias("storeid"),
        F.col("ZipCode").alias("ZipCode_tienda"),
        F.col("Latitud").alias("Latitude"),
        F.col("Longitud").alias("Longitude"),
    )
    parties = tables.probes["order"].called({"CustomerId": "cliente", "StoreId": "storeid"})
    heads = balanced_join(heads, customers, ["cliente"], ["OrderId"], parties)
    heads = balanced_join(heads, addresses, ["BillingAddressId"], ["OrderId"], parties)
    heads = balanced_join(heads, stores, ["storeid"], ["OrderId"], parties)

    # Few categories share all products, so their names are joined with the same care.
    categories = tables.category.select(F.col("Id").alias("catid"), F.col("Name").alias("categoria"))
    filed = tables.product_category.select("ProductId", F.col("CategoryId").alias("catid"))
    filings = tables.probes["product_category"].called({"CategoryId": "catid"})
    named = balanced_join(filed, categories, ["catid"], ["ProductId"], filings)
    goods = named.join(tables.product.select(F.col("Id").alias("ProductId"), "Sku"), "ProductId")
    marks = []
    if rules.dedupe_lines:  # a product has few categories
        of_product = Window.partitionBy("ProductId").orderBy("catid")
        goods = goods.withColumn("main_filing", F.row_number().over(of_product) == 1)
        marks = ["main_filing"]
    items = tables.order_item.select(
        "OrderId",
        "ProductId",
        "PriceExclTax",
        (F.col("Quantity") * F.col("OriginalProductCost")).alias("costo"),
    )
    item_keys = tables.probes["order_item"]
    sold = balanced_join(items, goods, ["ProductId"], ["OrderId"], item_keys)
    return balanced_join(sold, heads, ["OrderId"], ["ProductId"], item_keys).select(
        "storeid",
        "cliente",
        "Sku",
        "PriceExclTax",
        "costo",
        "categoria",
        "catid",
        "ZipCode_tienda",
        "Latitude",
        "Longitude",
        "fecha",
        "semana",
        *marks,
    )


def _money(lines: DataFrame, column: str) -> Column:
    """Total of an amount, without the repetitions of lines where they are marked."""
    return F.sum(F.when(F.col("main_filing"), F.col(column)) if "main_filing" in lines.columns else F.col(column))


def _customer_totals(lines: DataFrame) -> DataFrame:
    # One pass for both lifetime and history.
    return distinct_counts(
        lines,
        ["cliente"],
        {"skuhistoricos": "Sku", "catshistoricas": "categoria"},
        {"nacimiento": F.min("semana"), "ultimopedido": F.max("semana")},
    )


def customer_lifetime(lines: DataFrame) -> DataFrame:
    """First and last order week per customer."""
    return lines.groupBy("cliente").agg(
        F.min("semana").alias("nacimiento"), F.max("semana").alias("ultimopedido")
    )


def customer_history(lines: DataFrame) -> DataFrame:
    """Distinct products and categories a customer ever ordered."""
    return _customer_totals(lines).select("cliente", "skuhistoricos", "catshistoricas")


def weekly_customer_store(lines: DataFrame) -> DataFrame:
    """Spend, cost, margin and breadth per week, store and customer.

    The postal code belongs to the store and is carried as a grouping column.
    """
    return distinct_counts(
        lines.withColumnRenamed("storeid", "tienda"),
        ["semana", "tienda", "cliente", "ZipCode_tienda"],
        {"skus": "Sku", "categorias": "categoria"},
        {"gmv": _money(lines, "PriceExclTax"), "costo": _money(lines, "costo")},
        finest="cliente",
    ).withColumn("gm", ratio(F.col("gmv") - F.col("costo"), F.col("gmv")))


def _spent(total: Column) -> Column:
    return F.when(total > 0, 1).otherwise(0)


def daily_order_flag(lines: DataFrame) -> DataFrame:
    """1 per delivery day on which a customer spent anything, else 0."""
    return lines.groupBy("fecha", "semana", "cliente").agg(_spent(_money(lines, "PriceExclTax")).alias("pedido"))


def weekly_frequency(lines: DataFrame) -> DataFrame:
    """Ordering days per week and customer."""
    return daily_order_flag(lines).groupBy("semana", "cliente").agg(F.sum("pedido").alias("frecuencia"))


def store_week_customers(lines: DataFrame) -> DataFrame:
    """Active customers per store and week, with the store's place."""
    return lines.groupBy("semana", F.col("storeid").alias("tienda"), "ZipCode_tienda").agg(
        F.min("Latitude").alias("Latitude"),
        F.min("Longitude").alias("Longitude"),
        F.count_distinct("cliente").alias("clientesactivos"),
    )


def category_flags(lines: DataFrame) -> DataFrame:
    """Per week and customer one column per category: 1 if spent there, 0 if not, NULL if no line.

    The lines are read once and summed before the shuffle. A customer's week is then two numbers, a
    bit for each category of the fixed list, and not a column of sums for each.
    """
    bits = {i: 1 << place for place, i in enumerate(CATEGORY_FLAGS)}
    bit = F.create_map(*[F.lit(x) for i, b in bits.items() for x in (i, b)])[F.col("catid").cast("int")].cast("long")
    sums = lines.groupBy("semana", "cliente", "catid").agg(F.sum("PriceExclTax").alias("spent"))
    weeks = sums.groupBy("semana", "cliente").agg(
        F.bit_or(F.when(F.col("spent") > 0, bit)).alias("paid"),
        F.bit_or(F.when(F.col("spent").isNotNull(), bit)).alias("known"),
    )

    def has(column: str, i: int) -> Column:
        return F.col(column).bitwiseAND(F.lit(bits[i]).cast("long")) != 0

    return weeks.select(
        "semana",
        "cliente",
        *[F.when(has("paid", i), 1).when(has("known", i), 0).alias(name) for i, name in CATEGORY_FLAGS.items()],
    )


def active_flag(last_week: Column, as_of: datetime.date | str, rules: Rules) -> Column:
    """1 if the last order week began fewer than ``active_days`` days before ``as_of``."""
    days = F.date_diff(F.lit(str(as_of)).cast("date"), last_week)
    return F.when(days < rules.active_days, 1).otherwise(0)


def visit_probe(tables: ShopTables, rules: Rules) -> Probe:
    """Finds stores and weeks with very many orders, from the orders alone: no customer visits a store without one."""
    day = delivery_date(F.col("CreatedOnUtc"), rules.utc_lag_hours, rules.cutoff_hour)
    visits = tables.order.select(F.col("StoreId").alias("tienda"), week_start(day, rules.strict_week).alias("semana"))
    return Probe(visits, ["tienda", "semana"])


def behaviour(
    lines: DataFrame, as_of: datetime.date | str, rules: Rules, visits: Probe | None = None
) -> DataFrame:
    """One row per week and customer: spend, frequency, breadth, store activity, history.

    ``lines`` is read by four aggregates, so pass a written table, and with ``visit_probe`` they
    need not be read for hot stores. A customer who used several stores in a week is shown with the
    lowest store id, and so with that store's spend only.
    """
    weekly = weekly_customer_store(lines)
    shown = [c for c in weekly.columns if c not in ("semana", "cliente")]
    # All columns are of the same row, as each is chosen by the same comparisons; those not used later are not made.
    one_store = weekly.groupBy("semana", "cliente").agg(*[F.min_by(c, "tienda").alias(c) for c in shown])
    stores = store_week_customers(lines).drop("ZipCode_tienda")
    with_frequency = one_store.join(weekly_frequency(lines), ["semana", "cliente"])
    with_totals = with_frequency.join(_customer_totals(lines), "cliente")
    visits = visits or Probe(lines.withColumnRenamed("storeid", "tienda"), ["tienda", "semana"])
    joined = balanced_join(with_totals, stores, ["tienda", "semana"], ["cliente"], visits)
    return joined.select(
        "semana",
        "nacimiento",
        "ultimopedido",
        active_flag(F.col("ultimopedido"), as_of, rules).alias("activo1"),
        "cliente",
        "tienda",
        "ZipCode_tienda",
        "gmv",
        "frecuencia",
        "clientesactivos",
        "Latitude",
        "Longitude",
        "skus",
        "categorias",
        "costo",
        "gm",
        "skuhistoricos",
        "catshistoricas",
        ratio(F.col("gmv"), F.col("frecuencia")).alias("AOV"),
    )


UNUSED_BY_MEANS = ["Sku", "costo", "categoria", "catid", "Latitude", "Longitude"]


def lines_for_means(lines: DataFrame) -> DataFrame:
    """Order lines with NULL in the columns that ``client_means`` does not need of ``behaviour``.

    The same rows, so that ``behaviour`` can be made of them; the columns are not shuffled or written. Only
    the means are right then, not the counts of products and categories, costs and places.
    """
    kinds = {f.name: f.dataType for f in lines.schema.fields}
    return lines.withColumns({c: F.lit(None).cast(kinds[c]) for c in UNUSED_BY_MEANS if c in kinds})


def client_means(behaviour_rows: DataFrame) -> DataFrame:
    """A client's mean activity, frequency, spend and order value over their weeks.

    Money is averaged in decimals: sums of doubles depend on the order of the rows, and users
    with equal means would change places from run to run.
    """

    def mean_money(column: str, kind: str) -> Column:
        return F.avg(F.col(column).cast(kind)).cast("double")

    return behaviour_rows.groupBy(F.col("cliente").alias("ClientId")).agg(
        F.avg("activo1").alias("active"),
        F.avg("frecuencia").alias("mean_freq"),
        mean_money("gmv", "decimal(28,4)").alias("mean_gmv"),
        mean_money("AOV", "decimal(28,8)").alias("mean_AOV"),
    )
