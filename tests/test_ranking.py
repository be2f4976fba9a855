"""Ranks of groups of any size equal the ranks that a sort of the whole group gives."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.functions.ranks import percent_rank_average
from marketframe.operators import xsection as X
from marketframe.operators.ranking import average_ranks, bucket, with_spread_ranks, with_subset_ranks

ODD = [0.0, -0.0, math.inf, -math.inf, math.nan, math.nan, 5e-324, -5e-324, 1.7e308, -1.7e308, None, None, 1.0, 1.0, -1.0]


def test_one_key_for_all_rows(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 0.02) for _ in range(6_000)] + [0.01] * 2_500 + [round(rng.gauss(21, 1), 1) for _ in range(1_500)] + [None] * 40
    rng.shuffle(values)
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(values)], "date string, n int, v double")
    got = {r.n: r.v_rank for r in with_spread_ranks(df, ["v"], ["date"]).collect()}
    want = pd.Series(values, dtype=float).rank(pct=True)
    assert len(got) == len(values)
    assert all(got[i] is None if v is None else got[i] == pytest.approx(want[i], abs=1e-12) for i, v in enumerate(values))
    largest = average_ranks(df, "v", ["date"]).groupBy(bucket(F.col("__v"))).count().agg(F.max("count")).first()[0]
    assert largest < 100  # of 6,000 distinct values, what one task orders together


def test_same_as_the_window(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([1, 2, None]), i, rng.choice(ODD + [rng.uniform(-3, 3)]), rng.choice([None, 1, 2, 2**60, 2**60 + 1]))
            for i, k in enumerate(["a", "b", None, "c"] * 60)]
    df = spark.createDataFrame(rows, "k string, m int, n int, x double, y long")
    for keys in (["k"], ["k", "m"]):
        plain = df.withColumns({c + "_rank": percent_rank_average(F.col(c), *keys) for c in ("x", "y")})
        spread = with_spread_ranks(df, ["x", "y"], keys)
        assert spread.columns == plain.columns
        a, b = ({r.n: (r.x_rank, r.y_rank) for r in d.collect()} for d in (spread, plain))
        assert a == b


def test_empty(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert with_spread_ranks(df, ["x"], ["k"]).columns == ["k", "x", "x_rank"]
    assert with_spread_ranks(df, ["x"], ["k"]).count() == 0


def test_buckets_never_fall(spark):
    rng = random.Random(7)
    values = sorted([v for v in ODD if v is not None and v == v] + [rng.gauss(0, 1) * 10 ** rng.randint(-12, 12) for _ in range(3_000)])
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


def factor_rows(seed, dates):
    rng = random.Random(seed)
    out = []
    for d in dates:
        for i in range(rng.choice([15, 40, 90])):
            out.append((d, rng.choice(["a", "b", "c", None]), rng.choice([None, math.nan, float(rng.randint(0, 5)), rng.gauss(0, 1)]), rng.choice([None, rng.gauss(0, 1)] + [0.5] * 2),
                        rng.choice([None] + [rng.gauss(12, 1)] * 6), rng.choice([None, 0.0, -0.0] + [rng.gauss(0, 0.1)] * 6)))
    return out


def test_subset_ranks_are_the_window_of_the_subset(spark):
    rows = [(i, *r) for i, r in enumerate(factor_rows(3, ["x", None, "y"] * 3))]
    df = spark.createDataFrame(rows, "i int, d string, industry string, value double, forward double, log_market_cap double, momentum_raw double")
    df = df.withColumn("g", F.struct("d"))
    inside = F.col("industry").isNotNull()
    got = with_subset_ranks(df, df, "value", {"a": F.lit(True), "b": inside}, "g")
    got = {r.i: (r.a, r.b) for r in with_subset_ranks(got, df, "momentum_raw", {"m": inside}, "g").collect()}
    want = {r.i: [r.a, None] for r in df.withColumn("a", percent_rank_average(F.col("value"), "d")).collect()}
    for r in df.where(inside).withColumn("b", percent_rank_average(F.col("value"), "d")).collect():
        want[r.i][1] = r.b
    assert got == {i: tuple(w) for i, w in want.items()} and any(b is not None for _, b in got.values())


def test_factor_tests_shuffle_rows_by_bucket(spark):
    rows = factor_rows(4, ["x"])
    df = spark.createDataFrame(rows, "d string, industry string, value double, forward double, log_market_cap double, momentum_raw double")
    plan = X.factor_tests(df, ["d"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "__ties" not in line and "__upto" not in line]
    assert not [line for line in windows if "rank(" in line or "industry" in line.split("Window [")[1].split("]")[0]]
