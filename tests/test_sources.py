from __future__ import annotations

import datetime as dt

import pytest

from grapevine.operators import edges
from grapevine.plans.campaign import export_csv, process_redemptions
from grapevine.sources import tables as io
from grapevine.sources.schemas import SCHEMAS, ShopTables, conform
from tests.frames import moment, redemption_frame, rows_of, shop


def test_zoned_instants_become_naive_utc(spark):
    raw = spark.sql("SELECT 1 AS id, 'A' AS USERNAME, 'c' AS ReferralCode, 2 AS BillingAddress_Id, TIMESTAMP'2021-01-01 00:00:00+03:00' AS CreatedOnUtc, 5 AS other")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = conform(raw, "customer")
            assert found.schema.names == SCHEMAS["customer"].names
            assert rows_of(found) == [(1, "A", "c", 2, dt.datetime(2020, 12, 31, 21))]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_shop_tables_from_parquet_and_catalog(spark, tmp_path):
    tables = shop(spark, store=[(1, "one", "100", 1.0, 2.0), (2, "two", None, 1.0, 2.0)])
    for name in SCHEMAS:
        getattr(tables, name).write.parquet(f"{tmp_path}/{name}")
    read = io.read_shop_parquet(spark, str(tmp_path))
    assert isinstance(read, ShopTables)
    assert rows_of(read.store) == rows_of(tables.store)
    assert read.order.schema == tables.order.schema


def test_tables_are_replaced_appended_or_kept(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop_out LOCATION '{tmp_path}'")
    try:
        one, two = spark.range(1), spark.range(2)
        io.write_table(one, "t", "shop_out")
        io.write_table(two, "t", "shop_out")
        assert spark.table("shop_out.t").count() == 2
        io.write_table(one, "t", "shop_out", if_exists="append")
        assert spark.table("shop_out.t").count() == 3
        with pytest.raises(Exception, match="already exists"):
            io.write_table(one, "t", "shop_out", if_exists="fail")
        with pytest.raises(ValueError, match="if_exists"):
            io.write_table(one, "t", "shop_out", if_exists="upsert")
    finally:
        spark.sql("DROP DATABASE shop_out CASCADE")


@pytest.fixture
def pair(spark, tmp_path):
    """Two result tables of an earlier run."""
    spark.sql(f"CREATE DATABASE pair_out LOCATION '{tmp_path}'")
    io.replace_tables(spark, {"a": spark.range(1), "b": spark.range(2)}, "pair_out")

    def sizes() -> dict[str, int]:
        names = [t.name for t in spark.catalog.listTables("pair_out")]
        return {name: spark.table(f"pair_out.{name}").count() for name in sorted(names)}

    yield sizes
    spark.sql("DROP DATABASE pair_out CASCADE")


def test_tables_that_belong_together_are_replaced_together(spark, pair):
    assert pair() == {"a": 1, "b": 2}
    io.replace_tables(spark, {"a": spark.range(3), "b": spark.range(4)}, "pair_out")
    assert pair() == {"a": 3, "b": 4}


@pytest.mark.parametrize("fails_at", ["a", "a__staged", "b", "b__staged"])
def test_a_run_that_fails_between_the_tables_leaves_both_old_ones(spark, pair, monkeypatch, fails_at):
    rename = io._rename
    failed = []

    def failing(session, name, new_name, database):
        if name == fails_at and not failed:
            failed.append(name)
            raise RuntimeError("lost")
        rename(session, name, new_name, database)

    monkeypatch.setattr(io, "_rename", failing)
    with pytest.raises(RuntimeError, match="lost"):
        io.replace_tables(spark, {"a": spark.range(3), "b": spark.range(4)}, "pair_out")
    assert failed and pair() == {"a": 1, "b": 2}


def test_a_failure_while_writing_leaves_both_old_ones(spark, pair):
    broken = spark.range(4).selectExpr("id", "assert_true(id < 3) AS checked")
    with pytest.raises(Exception, match="not true"):
        io.replace_tables(spark, {"a": spark.range(3), "b": broken}, "pair_out")
    assert {name: n for name, n in pair().items() if "__" not in name} == {"a": 1, "b": 2}
    io.replace_tables(spark, {"a": spark.range(5), "b": spark.range(6)}, "pair_out")
    assert pair() == {"a": 5, "b": 6}


@pytest.mark.parametrize("renamed", [1, 2, 3, 4])
def test_the_next_run_puts_a_lost_driver_s_tables_right(spark, pair, monkeypatch, renamed):
    """The driver is gone after so many of the four renamings: nothing puts the tables back at once."""
    rename, done = io._rename, []

    def lost(session, name, new_name, database):
        if len(done) == renamed:
            raise KeyboardInterrupt
        done.append(name)
        rename(session, name, new_name, database)

    restore = io.restore_tables
    with monkeypatch.context() as patch:
        patch.setattr(io, "_rename", lost)
        patch.setattr(io, "_drop", lambda *_: None)
        patch.setattr(io, "restore_tables", lambda *_: None)
        if renamed < 4:
            with pytest.raises(KeyboardInterrupt):
                io.replace_tables(spark, {"a": spark.range(3), "b": spark.range(4)}, "pair_out")
        else:
            io.replace_tables(spark, {"a": spark.range(3), "b": spark.range(4)}, "pair_out")
    restore(spark, ["a", "b"], "pair_out")
    assert pair() == ({"a": 1, "b": 2} if renamed < 4 else {"a": 3, "b": 4})


def test_csv_round_trip_keeps_quotes_microseconds_and_missing_values(spark, tmp_path):
    rows = redemption_frame(
        spark,
        {"OrderId": 1, "Referral_Name": 'be"a, \\ x', "OrderUTC": "2021-01-01 10:00:00.123456"},
        {"OrderId": 2, "Referral_num": "C", "Referral_Name": None, "ZipCode": None, "OrderUTC": None},
    )
    interactions, users = process_redemptions(rows)
    paths = export_csv(interactions, users, str(tmp_path))
    back = io.read_csv(spark, paths[0], interactions.schema)
    assert rows_of(back) == rows_of(interactions)
    assert rows_of(io.read_csv(spark, paths[1], users.schema)) == rows_of(users)


def test_csv_is_ordered(spark, tmp_path):
    rows = redemption_frame(spark, {"OrderId": 1}, {"OrderId": 2, "Referral_num": "C"}, {"OrderId": 3, "Referral_num": "C"})
    paths = export_csv(*process_redemptions(rows), str(tmp_path))
    counts = [r.n_interactions for r in io.read_csv(spark, paths[0], edges.interactions(rows).schema).collect()]
    assert counts == sorted(counts, reverse=True)


def test_input_frames_stay_as_they_were(spark):
    rows = redemption_frame(spark, {"OrderUTC": "2021-01-01 10:00:00"})
    before = rows.columns
    process_redemptions(rows)
    assert rows.columns == before
    assert rows.first().OrderUTC == moment("2021-01-01 10:00:00")
