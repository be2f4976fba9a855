"""The ridge family of the rotation scores."""

import datetime as dt
import random

import pytest

from marketframe.operators import xsection as X

COLUMNS = ["vol", "trend60", "trend120", "trend200", "mom21", "mom63", "mom126", "mom252", "efficiency", "drawdown", "ret"]


def test_ridge_family_blends_prediction_ranks(spark):
    rng = random.Random(7)
    days = [dt.date(2022, 1, 3 + n) for n in range(6)]
    rows = [(f"s{k}", d, rng.random() < 0.8, *[rng.uniform(-1, 1) for _ in COLUMNS]) for d in days for k in range(9)]
    features = spark.createDataFrame(rows, "symbol string, date date, eligible boolean, " + ", ".join(f"{c} double" for c in COLUMNS))
    # no prediction on the last day, none for one symbol, ties on the others
    told = [(s, d, float(rng.randint(0, 3))) for s, d, *_ in rows if d != days[-1] and s != "s4"]
    predictions = spark.createDataFrame(told, "symbol string, date date, prediction double")
    got = {(r.family, r.sleeve, r.symbol, r.date): r for r in X.rotation_scores(features, predictions).collect()}
    assert {k[0] for k in got} == {"dual", "quality", "ensemble", "ridge"}
    value = {(s, d): p for s, d, p in told}
    for (family, sleeve, symbol, date), r in got.items():
        if family != "ridge":
            continue
        plain = got["ensemble", sleeve, symbol, date]
        same_day = [p for (_, d), p in value.items() if d == date]
        p = value.get((symbol, date))
        rank = plain.score if p is None else (sum(v < p for v in same_day) + (same_day.count(p) + 1) / 2) / len(same_day)
        assert r.allowed == plain.allowed
        assert (r.score is None) == (plain.score is None)
        if r.score is not None:
            assert r.score == pytest.approx(0.75 * plain.score + 0.25 * rank)
    assert {r.family for r in X.rotation_scores(features).select("family").distinct().collect()} == {"dual", "quality", "ensemble"}
