"""Known values of small inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.functions import scalar, solvers
from marketframe.operators import accounting, allocation, dedup, fundamentals as G, orders

D = dt.date


def one(df):
    return df.collect()[0]


def test_fee_floor_and_rate(spark):
    df = spark.createDataFrame([(3000.0,), (100000.0,)], "n double")
    assert [r[0] for r in df.select(scalar.fee(F.col("n"), 1.5, 5.0)).collect()] == [5.0, 15.0]


def test_stock_taxes_change_on_their_dates(spark):
    df = spark.createDataFrame(
        [(10000.0, 100.0, "600000.SH", "SELL", D(2023, 8, 25)), (10000.0, 100.0, "600000.SH", "SELL", D(2023, 8, 28)),
         (10000.0, 100.0, "600000.SH", "BUY", D(2015, 7, 31)), (10000.0, 100.0, "000001.SZ", "BUY", D(2015, 7, 31))],
        "n double, q double, s string, side string, d date")
    rows = df.select(scalar.stamp_tax(F.col("n"), F.col("side"), F.col("d")).alias("stamp"),
                     scalar.transfer_fee(F.col("n"), F.col("q"), F.col("s"), F.col("d")).alias("transfer")).collect()
    assert [pytest.approx(tuple(r)) for r in rows] == [(10.0, 0.1), (5.0, 0.1), (0.0, 0.03), (0.0, 0.255)]


def test_price_limits_are_direction_aware(spark):
    df = spark.createDataFrame([(11.0, 11.0, 9.0), (9.0, 11.0, 9.0), (None, 11.0, 9.0)], "p double, up double, down double")
    c = [F.col(x) for x in ("p", "up", "down")]
    rows = df.select(scalar.tradable_at_open(*c, F.lit("BUY")), scalar.tradable_at_open(*c, F.lit("SELL"))).collect()
    assert [tuple(r) for r in rows] == [(False, True), (True, False), (False, False)]


def test_drift_band(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (0.0, 0.1), (0.20, 0.21), (0.20, 0.17)], "t double, c double")
    assert [r[0] for r in df.select(scalar.rebalance_needed(F.col("t"), F.col("c"), 0.02)).collect()] == [False, True, True, False, True]


def test_water_fill_with_caps(spark):
    df = spark.createDataFrame([("x", "a", 100.0), ("x", "b", 1.0), ("x", "c", 1.0), ("y", "a", 0.0)], "k string, s string, score double")
    out = allocation.water_fill(df, ["k"], "score", F.lit(0.3), F.lit(0.8), "s", "w")
    got = {(r.k, r.s): r.w for r in out.collect()}
    assert got == pytest.approx({("x", "a"): 0.3, ("x", "b"): 0.25, ("x", "c"): 0.25, ("y", "a"): 0.0})


def test_water_fill_equals_bisection(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(40):
        n = int(rng.integers(1, 7))
        score = np.where(rng.random(n) < 0.2, 0.0, rng.random(n) * 10 ** rng.uniform(-2, 2, n))
        cap, budget = rng.uniform(0.05, 0.4, n), float(rng.uniform(0.1, 1.2))
        lo, hi = 0.0, 1e9
        goal = min(budget, cap[score > 0].sum())
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.minimum(score * mid, cap).sum() < goal else (lo, mid)
        for i in range(n):
            rows.append((k, i, float(score[i]), float(cap[i]), budget))
            want[k, i] = min(score[i] * hi, cap[i])
    df = spark.createDataFrame(rows, "k int, i int, score double, cap double, budget double")
    out = allocation.water_fill(df, ["k"], "score", F.col("cap"), F.col("budget"), "i", "w")
    assert {(r.k, r.i): r.w for r in out.collect()} == pytest.approx(want, abs=1e-9)


def test_equal_risk_of_a_diagonal_matrix():
    x = solvers.equal_risk(np.diag([0.01, 0.04, 0.16])[None], 40)
    assert x[0] == pytest.approx([4 / 7, 2 / 7, 1 / 7])


def test_equal_risk_contributions_and_missing_class():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3, 50, 4))
    cov = np.einsum("rki,rkj->rij", a, a) / 50
    x = solvers.equal_risk(cov.copy(), 200)
    risk = x * np.einsum("rij,rj->ri", cov, x)
    assert risk / risk.sum(axis=1, keepdims=True) == pytest.approx(np.full((3, 4), 0.25), abs=1e-6)
    hole = cov.copy()
    hole[:, 2, :] = hole[:, :, 2] = np.nan
    y = solvers.equal_risk(hole, 200)
    keep = [0, 1, 3]
    assert np.isnan(y[:, 2]).all()
    assert y[:, keep] == pytest.approx(solvers.equal_risk(cov[:, keep][:, :, keep].copy(), 200), abs=1e-9)


def test_cash_limits_the_lots(spark):
    req = spark.createDataFrame([(1, "a", 1, 4500.0, 10.0, 1000.0, False)],
                                "account int, symbol string, position int, cash double, close double, delta double, cost_exempt boolean")
    plan = orders.plan_cash_orders(req, lot=100, commission_bps=1.5, minimum_commission=5.0, slippage_bps=5.0)
    assert one(plan).delta == 400.0


def test_orders_sell_first_and_small_exits_pass(spark):
    rows = [(1, "buy", 1, 0.0, 10.0, 500.0, False), (1, "exit", 2, 0.0, 10.0, -100.0, True), (1, "trim", 3, 0.0, 10.0, -100.0, False), (1, "big", 4, 0.0, 10.0, -700.0, False)]
    req = spark.createDataFrame(rows, "account int, symbol string, position int, cash double, close double, delta double, cost_exempt boolean")
    plan = orders.plan_cash_orders(req, lot=100, commission_bps=1.5, minimum_commission=5.0, slippage_bps=0.0, minimum_trade=5000)
    got = {r.symbol: r.delta for r in plan.collect()}
    assert got == {"exit": -100.0, "big": -700.0, "buy": 500.0}


def test_trailing_year_needs_every_part(spark):
    rows = [(1, "a", D(2022, 6, 30), 80.0), (1, "a", D(2022, 12, 31), 200.0), (1, "a", D(2023, 6, 30), 50.0), (1, "b", D(2022, 12, 31), 200.0), (1, "b", D(2023, 6, 30), 50.0)]
    df = spark.createDataFrame(rows, "cutoff int, ts_code string, end_date date, v double")
    got = {(r.ts_code, r.end_date): r.ttm for r in df.select("ts_code", "end_date", G.ttm(F.col("v")).alias("ttm")).collect()}
    assert got["a", D(2023, 6, 30)] == 170.0 and got["a", D(2022, 12, 31)] == 200.0 and got["b", D(2023, 6, 30)] is None


def test_dividend_versions_are_reconciled(spark):
    rows = [("a", D(2020, 7, 1), D(2020, 5, 1), 0.1, None), ("a", D(2020, 7, 1), D(2020, 6, 1), 0.3, 0.5), ("a", D(2020, 7, 1), D(2020, 6, 20), None, None),
            ("b", D(2020, 7, 1), D(2020, 6, 1), 0.1, None), ("b", D(2020, 7, 1), D(2020, 6, 1), 0.2, None)]
    df = spark.createDataFrame(rows, "symbol string, ex_date date, ann date, cash double, bonus double")
    got = {r.symbol: r for r in dedup.reconcile_fields(df, ["symbol", "ex_date"], "ann", ["cash", "bonus"]).collect()}
    assert (got["a"].cash, got["a"].bonus, got["a"].reconciliation_error) == (0.3, 0.5, False)
    assert (got["b"].cash, got["b"].reconciliation_error) == (None, True)


def test_units_and_cash_follow_the_factor_and_the_rate(spark):
    days = [D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 3)]
    sessions = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "date date, session_no int")
    panel = spark.createDataFrame([("a", days[0], 10.0, 1.0), ("a", days[1], 5.0, 2.0), ("a", days[2], None, None)], "symbol string, date date, close double, adj_factor double")
    fills = spark.createDataFrame([("x", "a", days[0], "BUY", 100.0, 1000.0, 5.0)], "account string, symbol string, date date, side string, quantity double, notional double, commission double")
    nav = {r.date: r for r in accounting.account_nav(fills, panel, sessions, 2000.0, 0.1, reinvest=True).collect()}
    assert nav[days[1]].holdings == pytest.approx(200 * 5.0) and nav[days[2]].holdings == pytest.approx(1000.0)
    assert nav[days[2]].cash == pytest.approx(995.0 * 1.1 ** (2 / 365.25))


def test_themes_are_ordered_and_exclusion_comes_first(spark):
    from marketframe.functions.themes import theme

    names = ["国债ETF", "芯片科技ETF", "ai人工智能", "红利低波", "黄金股ETF", "沪深300ETF", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.t for r in df.orderBy("i").select(theme(F.col("n")).alias("t")).collect()]
    assert got == [None, "semiconductor", "technology", "dividend", "resources", None, None]
