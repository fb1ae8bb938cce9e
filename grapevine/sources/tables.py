"""Reading shop tables and writing results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from grapevine.sources.schemas import ShopTables


def read_shop_parquet(spark: SparkSession, folder: str) -> ShopTables:
    """Shop tables from ``<folder>/<table>`` parquet."""
    return _collected(lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}"))


def read_shop_catalog(spark: SparkSession, database: str) -> ShopTables:
    """Shop tables from a catalog database."""
    return _collected(lambda name: spark.read.table(f"`{database}`.`{name}`"))


def read_shop_jdbc(
    spark: SparkSession,
    options: dict[str, str],
    table_names: dict[str, str] | None = None,
    slices: dict[str, dict[str, str]] | None = None,
) -> ShopTables:
    """Shop tables from a database.

    ``options`` holds url, user and so on; ``table_names`` maps our table names to the
    database's. ``slices`` gives per table the reader's partitionColumn, lowerBound,
    upperBound and numPartitions; without them a table comes through one connection.
    """

    def read(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(**options, preferTimestampNTZ="true")
        reader = reader.option("dbtable", (table_names or {}).get(name, name))
        return reader.options(**(slices or {}).get(name, {})).load()

    return _collected(read)


def _collected(read) -> ShopTables:
    return ShopTables.of({f.name: read(f.name) for f in fields(ShopTables)})


CSV_OPTIONS = {"header": "true", "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, in a declared schema. Empty text comes back as missing."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition, replacing what was there."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_table(df: DataFrame, name: str, database: str | None = None, if_exists: str = "replace") -> None:
    """Save as a catalog table; ``if_exists`` is replace, append or fail."""
    target = f"`{database}`.`{name}`" if database else f"`{name}`"
    df.write.mode(_mode(if_exists)).format("parquet").saveAsTable(target)


STAGED, PREVIOUS = "__staged", "__previous"  # ends of the names of tables on their way in and out


def replace_tables(spark: SparkSession, frames: dict[str, DataFrame], database: str) -> None:
    """Save catalog tables that belong together so that readers get all new ones or all old ones.

    All are written under other names first; a run that fails by then leaves the old tables as they
    were. Then they change places by renaming, and the old tables are dropped when the last one has. A
    failure between two tables puts the old ones back: at once, or, if the driver was lost, at
    the beginning of the next call (or by ``restore_tables``).
    """
    restore_tables(spark, list(frames), database)
    for name, df in frames.items():
        write_table(df, name + STAGED, database, "fail")
    try:
        for name in frames:
            if _exists(spark, name, database):
                _rename(spark, name, name + PREVIOUS, database)
            _rename(spark, name + STAGED, name, database)
    except BaseException:
        restore_tables(spark, list(frames), database)
        raise
    _drop(spark, [name + PREVIOUS for name in frames], database)


def restore_tables(spark: SparkSession, names: Sequence[str], database: str) -> None:
    """Undo, or finish, a replacement that stopped on its way.

    While a new table still waits, the old ones come back; else all are new, and the old ones go. If there
    was no old table, what was put in its place stays.
    """
    waiting = any(_exists(spark, name + STAGED, database) for name in names)
    for name in names:
        if waiting and _exists(spark, name + PREVIOUS, database):
            _drop(spark, [name], database)
            _rename(spark, name + PREVIOUS, name, database)
    _drop(spark, [name + end for name in names for end in (STAGED, PREVIOUS)], database)


def _exists(spark: SparkSession, name: str, database: str) -> bool:
    return spark.catalog.tableExists(f"`{database}`.`{name}`")


def _rename(spark: SparkSession, name: str, new_name: str, database: str) -> None:
    spark.sql(f"ALTER TABLE `{database}`.`{name}` RENAME TO `{database}`.`{new_name}`")


def _drop(spark: SparkSession, names: Sequence[str], database: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")


def write_parquet(df: DataFrame, path: str, if_exists: str = "replace") -> None:
    df.write.mode(_mode(if_exists)).parquet(path)


def write_jdbc(df: DataFrame, name: str, options: dict[str, str], if_exists: str = "replace") -> None:
    """Write to a database table over JDBC, each partition through its own connection."""
    df.write.mode(_mode(if_exists)).format("jdbc").options(**options).option("dbtable", name).save()


def _mode(if_exists: str) -> str:
    modes = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}
    if if_exists not in modes:
        raise ValueError(f"if_exists must be one of {sorted(modes)}, not {if_exists!r}")
    return modes[if_exists]
