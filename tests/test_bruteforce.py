"""Distributed forms against plain loops on small inputs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.functions import solvers
from marketframe.operators import allocation as A, bootstrap as B, metrics, quantiles, ridge as R, xsection as X
from marketframe.operators.retention import pair_correlations, retention_picks

DAYS = [d.date() for d in pd.bdate_range("2020-01-01", periods=400)]


def test_cap_and_redistribute(spark):
    """What any right distribution of the excess must satisfy, asset by asset and in sum."""
    rng = np.random.default_rng(11)
    buckets = {"hk": "hk_equity", "c1": "cn_equity", "c2": "cn_equity", "u1": "us_equity", "g": "gold"}
    prior = {"hk": 0.05, "c1": 0.12, "c2": 0.08, "u1": 0.15, "g": 0.2}
    limit = {"cn_equity": 0.35, "us_equity": 0.30}
    before = pd.DataFrame([{s: float(rng.choice([0.0, rng.uniform(0, 0.16)])) for s in buckets} for _ in DAYS[:240]], index=DAYS[:240])
    rows = [("x", d, s, buckets[s], prior[s], w) for d, day in before.iterrows() for s, w in day.items()]
    df = spark.createDataFrame(rows, "strategy_id string, date date, symbol string, bucket string, prior double, weight double")
    got = A.cap_and_redistribute(df, "hk", 0.05, ("cn_equity", "us_equity"))
    after = pd.DataFrame([r.asDict() for r in got.collect()]).pivot(index="date", columns="symbol", values="weight").loc[before.index, list(buckets)]
    gain = after - before
    assert np.allclose(after.hk, before.hk.clip(upper=0.05)) and np.allclose(gain.g, 0)
    assert (gain.drop(columns="hk") >= -1e-12).all().all() and (gain.sum(axis=1) <= 1e-9).all()
    assert (gain.where(before == 0, 0).drop(columns="hk").abs() < 1e-12).all().all()  # what is not held gets nothing
    assert (after[["c1", "c2", "u1"]] <= 0.30 + 1e-9).all().all()
    excess = (before.hk - 0.05).clip(lower=0)
    lost = -gain.sum(axis=1)
    for bucket, top in limit.items():
        own = [s for s in buckets if buckets[s] == bucket]
        assert (after[own].sum(axis=1) <= np.maximum(top, before[own].sum(axis=1)) + 1e-9).all()
        # excess is lost only if every class with a held asset is full
        held = (before[own] > 0).any(axis=1)
        full = (after[own].sum(axis=1) >= top - 1e-9) | ((after[own] >= 0.30 - 1e-9) | (before[own] == 0)).all(axis=1)
        assert full[(lost > 1e-6) & held].all()
    assert (lost <= excess + 1e-9).all() and (excess > 0).sum() > 20
    # two uncapped assets of a class gain in proportion to their priors
    both = (gain.c1 > 1e-9) & (gain.c2 > 1e-9) & (after.c1 < 0.30 - 1e-6) & (after.c2 < 0.30 - 1e-6)
    assert both.sum() > 5 and np.allclose(gain.c1[both] / gain.c2[both], prior["c1"] / prior["c2"])


def test_bootstrap_equals_spelled_out_resamples(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, 263)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(r)], "k string, date int, ret double")
    got = B.bootstrap_sharpe(df, ["k"], resamples=50, block=20, seed=9).collect()[0]
    n, values = len(r), []
    for k in range(50):
        sample = []
        for b in range(-(-n // 20)):
            x = (k * 7919 + b * 104729 + 9) % 2147483647
            x = x * 48271 % 2147483647
            x = x * 48271 % 2147483647
            sample += [r[(x % n + o) % n] for o in range(20)]
        s = np.array(sample[:n])
        values.append((s.mean() - metrics.daily_rate(0.02)) / s.std(ddof=1) * 252**0.5)
    assert [got.lower_95, got.median, got.upper_95] == pytest.approx(np.quantile(values, [0.025, 0.5, 0.975]))


def test_quantile_of_a_hot_group(spark):
    rng = np.random.default_rng(4)
    v = {"hot": np.round(np.exp(rng.normal(5, 2, 3001)), 2) + 0.01, "cold": np.array([1.0, 2.0, 2.0, 10.0])}
    df = spark.createDataFrame([(k, float(x)) for k, a in v.items() for x in a], "k string, x double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: r.v for r in quantiles.positive_quantile(df, ["k"], "x", q, "v").collect()}
        assert got == pytest.approx({k: np.quantile(a, q) for k, a in v.items()})


def test_controlled_ic_equals_least_squares_with_dummies(spark):
    rng = np.random.default_rng(8)
    n = 60
    d = pd.DataFrame({"d": 1, "value": np.round(rng.normal(size=n), 1), "forward": rng.normal(size=n), "industry": rng.choice(list("xyzw"), n),
                      "log_market_cap": rng.normal(size=n), "momentum_raw": np.round(rng.normal(size=n), 1)})
    got = X.factor_tests(spark.createDataFrame(d), ["d"]).collect()[0]
    rank = lambda c: d[c].rank(pct=True)
    z = np.column_stack([np.ones(n), rank("log_market_cap"), rank("momentum_raw"), pd.get_dummies(d.industry, drop_first=True, dtype=float)])
    res = [y - z @ np.linalg.lstsq(z, y, rcond=None)[0] for y in (rank("value").to_numpy(), rank("forward").to_numpy())]
    assert got.controlled_ic == pytest.approx(np.corrcoef(*res)[0, 1])
    assert got.raw_ic == pytest.approx(np.corrcoef(rank("value"), rank("forward"))[0, 1])


def test_rank_equals_pandas(spark):
    s = pd.Series([3.0, 1.0, None, 3.0, 2.0, None, 3.0])
    df = spark.createDataFrame([(i, 1, None if pd.isna(v) else v) for i, v in enumerate(s)], "i int, d int, x double")
    got = {r.i: r.x_rank for r in X.with_ranks(df, ["x"], ["d"]).collect()}
    assert got == {i: None if pd.isna(v) else pytest.approx(v) for i, v in s.rank(pct=True).items()}


def test_portfolio_risk_equals_matrix_form(spark):
    rng = np.random.default_rng(6)
    r = rng.normal(0, 0.02, (80, 3))
    w = np.array([0.5, 0.3, 0.0])
    returns = spark.createDataFrame([(s, DAYS[i], i + 1, float(r[i, j])) for i in range(80) for j, s in enumerate("abc")], "symbol string, date date, session_no int, ret double")
    weights = spark.createDataFrame([("x", DAYS[79], 80, s, float(v)) for s, v in zip("abc", w)], "strategy_id string, date date, session_no int, symbol string, weight double")
    got = A.portfolio_risk(weights, returns, 60).collect()[0]
    c = np.cov(r[20:], rowvar=False) * 252
    assert got.complete and got.risk == pytest.approx(np.sqrt(w @ c @ w))


def test_ridge_fits_equal_numpy(spark):
    rng = np.random.default_rng(10)
    sessions = spark.createDataFrame([(d, i + 1) for i, d in enumerate(DAYS)], "date date, session_no int")
    rows = []
    for s in range(20):
        for i, d in enumerate(DAYS):
            x = rng.normal(size=8)
            rows.append((f"s{s:02d}", d, i, bool(rng.random() < 0.9), float(x[0] * 0.1 + rng.normal() * 0.3), *map(float, x)))
    samples = spark.createDataFrame(rows, "symbol string, date date, i int, valid boolean, y double, " + ", ".join(f"{c} double" for c in R.FEATURES))
    from marketframe.operators.panel import month_firsts

    training = R.training_rows(samples, R.fit_dates(month_firsts(sessions)), sessions)
    fits = {r.fit_date: r for r in R.fit_ridge(training, R.fit_moments(training)).collect()}
    d = pd.DataFrame(rows, columns=["symbol", "date", "i", "valid", "y", *R.FEATURES])
    first = {}
    for i, day in enumerate(DAYS):
        first.setdefault((day.year, day.month), i)
    checked = 0
    for i in first.values():
        t = d[d.valid & (d.i % 21 == 0) & (d.i >= max(0, i - 756)) & (d.i < max(0, i - 21))]
        if len(t) < 150:
            assert DAYS[i] not in fits
            continue
        # the penalty is ten more observations of a zero per feature: plain least squares over the extended rows
        standard = (t[R.FEATURES] - t[R.FEATURES].mean()) / t[R.FEATURES].std(ddof=0).clip(lower=0.05)
        design = standard.clip(-5, 5).assign(one=1.0)[["one", *R.FEATURES]].to_numpy()
        extra = np.sqrt(10.0) * np.eye(9)[1:]
        beta = np.linalg.lstsq(np.vstack([design, extra]), np.concatenate([t.y.clip(-1, 1), np.zeros(8)]), rcond=None)[0]
        assert fits[DAYS[i]].samples == len(t) and fits[DAYS[i]].coefficients == pytest.approx(beta)
        checked += 1
    assert checked == len(fits) > 3


def test_retention_keeps_incumbents_and_diversifies(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(0, 0.01, 150)
    r = {"a": base, "twin": base + rng.normal(0, 0.0005, 150), "b": rng.normal(0, 0.01, 150), "c": rng.normal(0, 0.01, 150), "d": rng.normal(0, 0.01, 150)}
    returns = spark.createDataFrame([(i + 1, s, float(x)) for s, a in r.items() for i, x in enumerate(a)], "session_no int, symbol string, ret double")

    def day(no, scores):
        return [("v", DAYS[no], no, s, k, "i" + s, "t" + s, sc, 1.0) for k, (s, sc) in enumerate(scores.items())]

    rows = day(130, {"a": 5.0, "twin": 4.0, "b": 3.0, "c": 2.0, "d": 1.0}) + day(140, {"c": 9.0, "d": 8.0, "a": 3.0, "b": 2.0, "twin": 1.0})
    cand = spark.createDataFrame(rows, "variant string, date date, session_no int, symbol string, position int, index_key string, theme string, score double, amount20 double")
    got = {}
    pairs = pair_correlations(cand.select("date", "session_no", "symbol", "theme"), returns, 126, 100)
    for x in retention_picks(cand, pairs).orderBy("date", "place").collect():
        got.setdefault(x.date, []).append(x.symbol)
    assert got == {DAYS[130]: ["a", "b"], DAYS[140]: ["a", "b"]}


def test_pair_correlations_equal_pandas(spark):
    rng = np.random.default_rng(13)
    wide = pd.DataFrame(rng.normal(size=(60, 4)), columns=list("abcd"), index=range(1, 61)).mask(rng.random((60, 4)) < 0.2)
    returns = spark.createDataFrame([(int(i), s, float(v)) for (i, s), v in wide.stack().items() if not pd.isna(v)], "session_no int, symbol string, ret double")
    decisions = spark.createDataFrame([(DAYS[n], n, s, "t" + ("x" if s in "ab" else s)) for n in (30, 55) for s in "abcd"],
                                      "date date, session_no int, symbol string, theme string")
    got = {(r.date, r.symbol_a, r.symbol_b): r.correlation for r in pair_correlations(decisions, returns, 20, 12).collect()}
    want = {}
    for n in (30, 55):
        table = wide.loc[n - 19 : n].corr(min_periods=12)
        want |= {(DAYS[n], a, b): table.loc[a, b] for a in "abcd" for b in "abcd" if a < b and a + b != "ab" and not pd.isna(table.loc[a, b])}
    assert got == pytest.approx(want) and len(want) > 5
