"""The queries of the monthly factor panel over rows made here: their results, and how much the driver has to plan at once."""

import datetime as dt
import random

import pytest
from oracle_check import compare

import __spark_entry__ as entry
from marketframe import session
from marketframe.plans import registry
from marketframe.sources import market

QUERIES = ["a09_coverage_counts", "g10_availability_audit", "g10_factor_panel", "x03_group_scores"]
#: Most shuffles of one plan; as a single plan the panel had 121.
SHUFFLES = 30


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Five brands (two of them warned each year), traded on most of 430 days by four brokers."""
    at, rng = str(tmp_path_factory.mktemp("panel")), random.Random(4)
    days = [dt.datetime(1995, 1, 2) + dt.timedelta(days=2 * i) for i in range(430)]
    parts = [(k, f"Brand#{11 + k % 5}", ("PROMO", "SMALL", "LARGE")[k % 3]) for k in range(30)]
    orders = [(k, day) for k, day in enumerate(days)]
    lines = []
    for k, _ in orders:
        for number in range(24):
            quantity = float(rng.randint(1, 50))
            lines.append((k, rng.randrange(30), rng.randrange(8), number % 7 + 1, quantity, round(quantity * rng.uniform(900, 1100), 2),
                          rng.randint(0, 10) / 100, rng.randint(0, 8) / 100, rng.choice("RNA")))
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(k, k % 4) for k in range(8)], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    ).write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.fixture(scope="module")
def con(folder):
    import duckdb

    made = duckdb.connect()
    for t in ("part", "supplier", "orders", "lineitem"):
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return made


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count(" Exchange ")


def test_panel_queries_equal_their_twins_and_are_planned_in_parts(spark, folder, con, monkeypatch):
    """The four share one market here, so that the parts are written once; each alone writes them as well."""
    joined, planned = [], []
    trades, write, cut = market.Market.__dict__["trades"].func, session.write_once, session.cut_lineage
    monkeypatch.setattr(market.Market, "trades", property(
        lambda m: m._memo.get(("stored", "trades")) or joined.append(1) or trades(m), lambda m, df: None))
    monkeypatch.setattr(market, "write_once", lambda df, key: planned.append(shuffles(df)) or write(df, key))
    monkeypatch.setattr(market, "cut_lineage", lambda df: planned.append(shuffles(df)) or cut(df))
    shared = market.Market(spark, folder)
    monkeypatch.setattr(registry, "Market", lambda spark, at: shared)
    for name in QUERIES:
        df = entry.queries()[name](spark, folder)
        planned.append(shuffles(df))
        text, ok = compare(spark, con, name, folder, {name: lambda spark, at: df}, entry.oracle_sql())
        assert ok and "rows=0" not in text, f"{name}: {text}"
    assert max(planned) <= SHUFFLES, planned
    assert len(joined) == 1
