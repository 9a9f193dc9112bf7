"""Sectors of addresses, and queries that would prove nothing because they give no rows."""

import os

import duckdb

from panelry import catalog
from panelry.operators import risk
from panelry.plans import trading

SF = "/root/testdata/sf0.01"


def test_five_sectors_occur(spark):
    found = trading.sectors(spark, SF)
    assert found.select("sector").distinct().count() == 5 and found.count() == found.select("address").distinct().count()
    known = spark.createDataFrame([("A000000001.X", "ASIA")], "address string, sector string")
    rows = trading.with_sector(spark.createDataFrame([("A000000001.X",), ("A000000002.X",)], "address string"), known)
    assert {(r.address, r.sector) for r in rows.collect()} == {("A000000001.X", "ASIA"), ("A000000002.X", "other")}


def test_no_query_compares_nothing():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    empty = [name for name, sql in catalog.SQL.items() if not con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]]
    assert not empty


def test_an_address_without_a_margin_is_not_traded(spark):
    rows = spark.createDataFrame([("d", "a", "s", 0.0, 0.3), ("d", "b", "s", 5000.0, 0.2), ("d", "c", "s", None, 0.2), ("d", "e", "s", 20000.0, 0.2)], "date string, address string, sector string, margin double, target_weight double")
    assert [r.address for r in risk.small_capital_topn(rows, 50000.0, 4).collect()] == ["b"]
