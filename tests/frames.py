"""Small hand-made frames."""

from __future__ import annotations

import datetime as dt

from grapevine.sources.schemas import SCHEMAS, ShopTables

REDEMPTIONS = (
    "OrderId long, OrderUTC timestamp_ntz, CouponCode string, ClientId long, Referrer_num string, "
    "Referrer_Name string, Referral_Name string, Referral_num string, childId long, "
    "GMV_after_discount decimal(18,4), week string, IsNewCustomer string, StoreName string, StoreId long, "
    "ZipCode string"
)
EDGES = (
    "OrderId long, OrderUTC timestamp_ntz, CouponCode string, ClientId long, `from` string, `to` string, "
    "childId long, week string, StoreName string, ZipCode string, n_interactions long"
)
MEANS = "ClientId long, active double, mean_freq double, mean_gmv double, mean_AOV double"


def moment(text: str | None) -> dt.datetime | None:
    return text and dt.datetime.fromisoformat(text)


def rows_of(df, *columns: str) -> list[tuple]:
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def redemption_frame(spark, *rows: dict):
    base = {
        "OrderId": 1, "OrderUTC": "2021-01-01 10:00:00", "CouponCode": "ANA-1", "ClientId": 1,
        "Referrer_num": "A", "Referrer_Name": "ana", "Referral_Name": "bea", "Referral_num": "B", "childId": 2,
        "GMV_after_discount": 10, "week": "2101", "IsNewCustomer": "NEW CUSTOMER", "StoreName": "s", "StoreId": 7,
        "ZipCode": "100",
    }
    import decimal

    data = []
    for row in rows:
        full = base | row
        full["OrderUTC"] = moment(full["OrderUTC"])
        total = full["GMV_after_discount"]
        full["GMV_after_discount"] = None if total is None else decimal.Decimal(str(total))
        data.append(tuple(full.values()))
    return spark.createDataFrame(data, REDEMPTIONS)


def edge_frame(spark, *rows: dict):
    base = {
        "OrderId": 1, "OrderUTC": "2021-01-01 10:00:00", "CouponCode": "ANA-1", "ClientId": 1, "from": "A",
        "to": "B", "childId": 2, "week": "w-2101", "StoreName": "s", "ZipCode": "100", "n_interactions": 1,
    }
    data = []
    for row in rows:
        full = base | row
        full["OrderUTC"] = moment(full["OrderUTC"])
        data.append(tuple(full.values()))
    return spark.createDataFrame(data, EDGES)


def shop(spark, **tables: list[tuple]) -> ShopTables:
    """Shop tables from rows given as plain values; tables not named are empty."""
    frames = {}
    for name, schema in SCHEMAS.items():
        loose = ", ".join(
            f"{f.name} {'double' if f.dataType.typeName() == 'decimal' else f.dataType.simpleString()}"
            for f in schema.fields
        )
        frames[name] = spark.createDataFrame(tables.get(name, []), loose)
    return ShopTables.of(frames)
