"""The shop tables a run reads, with the columns it uses."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grapevine.operators.skew import Probe

LONG, INT, TEXT, REAL = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
MONEY, MOMENT = T.DecimalType(18, 4), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "discount_usage": _schema(OrderId=LONG, DiscountId=LONG, CreatedOnUtc=MOMENT),
    "discount": _schema(Id=LONG, CouponCode=TEXT),
    "order": _schema(
        Id=LONG, CustomerId=LONG, StoreId=LONG, BillingAddressId=LONG, CreatedOnUtc=MOMENT, OrderTotal=MONEY
    ),
    "customer": _schema(
        Id=LONG, username=TEXT, ReferralCode=TEXT, BillingAddress_Id=LONG, CreatedOnUtc=MOMENT
    ),
    "address": _schema(Id=LONG, Firstname=TEXT, PhoneNumber=TEXT),
    "store": _schema(Id=LONG, Name=TEXT, ZipCode=TEXT, Latitud=REAL, Longitud=REAL),
    "order_item": _schema(
        OrderId=LONG, ProductId=LONG, Quantity=INT, PriceExclTax=MONEY, OriginalProductCost=MONEY
    ),
    "product": _schema(Id=LONG, Sku=TEXT),
    "product_category": _schema(ProductId=LONG, CategoryId=INT),
    "category": _schema(Id=INT, Name=TEXT),
    "generic_attribute": _schema(EntityId=LONG, KeyGroup=TEXT, Key=TEXT, Value=TEXT),
}

# Category id -> name of its flag column.
CATEGORY_FLAGS: dict[int, str] = {
    2: "cuidadopersonal",
    3: "despensa",
    7: "fruver",
    11: "oficina",
    12: "tecnologia",
    13: "bazar",
    14: "mascotas",
    15: "bebidas",
    68: "licoresycig",
    69: "dulcesybotanas",
    70: "lacteosyrefri",
    71: "cuidadosalud",
    72: "cuidadodelhogar",
    73: "canastabasica",
    74: "bebesyninos",
    75: "juguetes",
    76: "electrodomesticos",
    77: "hogarycocina",
    78: "belleza",
    79: "saludybelleza",
}


# The columns by which tables are joined with smaller ones, where few keys may hold most rows.
JOINED_BY = {
    "discount_usage": ["DiscountId", "OrderId"],
    "order": ["CustomerId", "StoreId", "BillingAddressId"],
    "customer": ["BillingAddress_Id", "code"],
    "order_item": ["ProductId", "OrderId"],
    "product_category": ["CategoryId"],
    "generic_attribute": ["EntityId"],
}


@dataclass(frozen=True)
class ShopTables:
    """One frame per shop table, in the declared schema."""

    discount_usage: DataFrame
    discount: DataFrame
    order: DataFrame
    customer: DataFrame
    address: DataFrame
    store: DataFrame
    order_item: DataFrame
    product: DataFrame
    product_category: DataFrame
    category: DataFrame
    generic_attribute: DataFrame

    @cached_property
    def probes(self) -> dict[str, Probe]:
        """Per joined table what finds its hot keys: for all operators together one job a table at most."""
        frames = {name: getattr(self, name) for name in JOINED_BY}
        frames["customer"] = self.customer.withColumn("code", F.lower("ReferralCode"))
        return {name: Probe(frames[name], *[[c] for c in keys]) for name, keys in JOINED_BY.items()}

    @classmethod
    def of(cls, frames: dict[str, DataFrame]) -> ShopTables:
        """Bring each frame to its declared columns and types."""
        return cls(**{f.name: conform(frames[f.name], f.name) for f in fields(cls)})


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project a table to the columns used and cast them; zoned instants become naive UTC."""
    # Column names match case-insensitively, as everywhere in Spark.
    kinds = {f.name.lower(): f.dataType for f in df.schema.fields}
    columns = []
    for field in SCHEMAS[table].fields:
        column = F.col(field.name)
        if field.dataType == MOMENT and kinds[field.name.lower()] == T.TimestampType():
            column = F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast(MOMENT))
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)
