"""Removing or changing later input never changes earlier results."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import change, forward_fill_limited, rolling_mean
from marketframe.operators import allocation as A, guards, metrics, panel as P, quality as Q, xsection as X

CUTOFF = "2020-12-31"


@pytest.fixture(scope="module")
def bars(spark):
    """Four symbols, 420 business days, gaps, a late listing and a factor step."""
    rng = np.random.default_rng(7)
    days = np.arange("2020-01-01", "2021-10-01", dtype="datetime64[D]")
    days = [d.astype(object) for d in days if np.is_busday(d)][:420]
    rows = []
    for k, s in enumerate("abcd"):
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days))))
        for i, (d, c) in enumerate(zip(days, close.tolist())):
            if (s == "d" and i < 60) or (s == "b" and i % 37 == 5):
                continue
            rows.append((s, d, c * 0.997, c * 1.02, c * 0.98, c, 1e6 + k, 2e7, 1.0 if i < 45 else 1.1))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, amount double, adj_factor double").cache()


def sessions_of(bars):
    return P.number_sessions(bars.select("date"))


def pipelines():
    def features(b):
        return P.rotation_features(P.complete_panel(P.rebase_to_first_factor(b), sessions_of(b)), 60, 1e7)

    def ceiling(b):
        s = sessions_of(b)
        panel = P.complete_panel(P.rebase_to_first_factor(b), s)
        assets = b.sparkSession.createDataFrame([("a", "bond", 1, 0.3), ("b", "gold", 2, 0.2), ("c", "cn_equity", 3, 0.3), ("d", "cn_equity", 4, 0.1)], "symbol string, bucket string, position int, weight double")
        w = A.fixed_budget(panel, assets, P.fixed_eligibility(60, 1e6), None)
        return A.volatility_ceiling(w, P.mark_prices(panel), 30, 0.05).drop("risk")

    def breadth(b):
        p = P.mark_prices(P.complete_panel(b, sessions_of(b)))
        return X.rotation_scores(P.rotation_features(P.complete_panel(b, sessions_of(b)), 60, 0)).select("symbol", "date", "family", "sleeve", "score")

    def flow(b):
        p = P.mark_prices(P.complete_panel(b, sessions_of(b)))
        return guards.factor_multipliers(p.withColumn("total_share", F.col("volume") + F.dayofyear("date")))

    return {
        "features": (features, ["symbol", "date", "vol", "mom63", "trend60", "efficiency", "drawdown", "eligible"]),
        "ceiling": (ceiling, ["symbol", "date", "weight"]),
        "scores": (breadth, ["symbol", "date", "family", "sleeve", "score"]),
        "multipliers": (flow, ["symbol", "date", "trend_quality", "downside_guard", "volume_confirmation", "share_flow"]),
    }


@pytest.mark.parametrize("name", list(pipelines()))
def test_prefix_invariance(bars, name):
    pipeline, columns = pipelines()[name]
    assert pipeline(bars).where(F.col("date") <= F.lit(CUTOFF).cast("date")).count() > 100
    assert Q.causality_breaks(pipeline, bars, CUTOFF, columns).count() == 0


def test_audit_finds_a_pipeline_that_looks_ahead(bars):
    def ahead(b):
        w = Window.partitionBy("symbol").orderBy("date")
        return b.select("symbol", "date", F.lead("close").over(w).alias("v"))

    assert Q.causality_breaks(ahead, bars, CUTOFF, ["symbol", "date", "v"]).count() > 0


def test_future_prices_do_not_move_past_features(bars):
    later = F.col("date") > F.lit(CUTOFF).cast("date")
    bent = bars.withColumns({c: F.when(later, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    pipeline, columns = pipelines()["features"]
    past = lambda b: pipeline(b).where(~later).select(*[F.round(c, 9).alias(c) if c not in ("symbol", "date", "eligible") else F.col(c) for c in columns])
    assert past(bars).exceptAll(past(bent)).count() == 0


def test_panel_keeps_gaps_and_fill_is_bounded(spark, bars):
    p = P.complete_panel(bars, sessions_of(bars))
    assert p.count() == 4 * bars.select("date").distinct().count()
    assert p.where("close IS NULL").count() == p.count() - bars.count()
    f = p.where("symbol = 'd'").select("session_no", "close", forward_fill_limited(F.col("close"), 3).alias("f")).orderBy("session_no").collect()
    assert all(r.f is None for r in f[:60]) and f[60].f == f[60].close


def test_too_few_values_give_no_statistic(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, d), float(d) if d != 3 else None) for d in range(1, 8)], "symbol string, date date, x double")
    got = [r[0] for r in df.orderBy("date").select(rolling_mean(F.col("x"), 3)).collect()]
    assert [v is None for v in got] == [True, True, True, True, True, False, False]


def test_decision_masks(spark):
    days = [dt.date(2021, 1, 1), dt.date(2021, 1, 4), dt.date(2021, 1, 29), dt.date(2021, 2, 1), dt.date(2021, 2, 2)]
    s = P.number_sessions(spark.createDataFrame([(d,) for d in days], "date date"))
    assert [r.decision for r in P.first_of("month", s).orderBy("date").collect()] == [True, False, False, True, False]
    assert [r.decision for r in P.first_of("week", s).orderBy("date").collect()] == [True, True, True, True, False]


def test_short_curves_give_only_a_count(spark):
    nav = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 2), 1.1)], "strategy_id string, date date, equity double")
    r = metrics.performance(nav, ["strategy_id"]).collect()[0]
    assert r.observations == 2 and r.cagr is None
