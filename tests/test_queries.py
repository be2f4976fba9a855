"""A sample of registered queries beside their SQL twins on the smallest tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "p03_rolling_statistics", "p16_share_flow", "j03_asof_tolerance", "j05_known_versions", "j11_membership_on_date", "a02_analyst_revision",
    "x05_rank_ic", "x09_quantile_spread", "k03_water_fill", "m01_m05_performance", "b03_block_mean_interval", "l01_account_nav", "q12_changed_tables",
    "k19_cash_limited_orders", "a12_trade_statistics", "s06_landed_pages",
]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, con, name):
    text, ok = compare(spark, con, name, FOLDER, entry.queries(), entry.oracle_sql())
    assert ok, text


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "symbol", "score", "rank"]


def reads_of(monkeypatch, spark, name):
    """How often a query joins the trades."""
    from marketframe.sources import market

    made = []
    plain = market.Market.__dict__["trades"].func
    monkeypatch.setattr(market.Market, "trades", property(lambda m: m._memo.get(("stored", "trades")) or made.append(name) or plain(m), lambda m, df: None))
    entry.queries()[name](spark, FOLDER)
    return len(made)


def test_trade_statistics_join_the_trades_once(spark, monkeypatch):
    assert reads_of(monkeypatch, spark, "a12_trade_statistics") == 1


def test_tilted_allocation_settles_its_bars_and_rates(spark, monkeypatch):
    from marketframe.sources import market

    kept, plain = [], market.Market.settle
    monkeypatch.setattr(market.Market, "settle", lambda m, key, build: kept.append(key) or plain(m, key, build))
    entry.queries()["k07_adaptive_tilted"](spark, FOLDER)
    assert kept == [("bars", "p_type"), "rates"]
