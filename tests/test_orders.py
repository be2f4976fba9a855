"""Account positions on accounts and plans that the given tables have few of."""

import math

from marketframe.operators.orders import account_positions, order_requests


def tables(spark):
    accounts = spark.createDataFrame([(1, 100.0), (2, 0.0), (3, 0.0)], "account long, cash double")
    holdings = spark.createDataFrame([(1, "A", 10.0), (3, "B", 4.0)], "account long, symbol string, quantity double")
    targets = spark.createDataFrame([(a, s, p, 0.5) for a in (1, 2, 3) for p, s in enumerate("AB")], "account long, symbol string, position int, weight double")
    prices = spark.createDataFrame([("A", 10.0, 1000.0), ("B", 5.0, 1000.0)], "symbol string, close double, volume double")
    return accounts, holdings, targets, prices


def test_account_worth_nothing(spark):
    got = {(r.account, r.symbol): r.current for r in account_positions(*tables(spark)).collect()}
    assert len(got) == 6 and got[1, "A"] == 0.5 and got[1, "B"] == 0 and got[3, "A"] == 0 and got[3, "B"] == 1
    assert math.isnan(got[2, "A"]) and math.isnan(got[2, "B"])
    orders = order_requests(account_positions(*tables(spark)), lot=1, participation=1.0, band=0.02)
    assert sorted((r.account, r.symbol, r.delta) for r in orders.collect()) == [(1, "B", 20.0), (3, "A", 1.0), (3, "B", -2.0)]


def test_account_tables_are_not_broadcast(spark):
    got = account_positions(*tables(spark))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [account" in plan and "BroadcastHashJoin [account" not in plan
