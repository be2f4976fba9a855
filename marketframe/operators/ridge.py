"""Monthly rolling ridge regression on matured labels, all fit dates in one job.

A sample is used by the months whose training window covers it. Two aggregations
give the moments of every fit: means and spreads, then the products of the clipped
scores. Only one 9 × 9 system per fit date is solved outside SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the protocol.
TRAIN, STEP, MATURITY, PENALTY, MIN_SAMPLES = 756, 21, 22, 10.0, 150
MIN_SPREAD, CLIP, MIN_VOLATILITY = 0.05, 5.0, 0.05
FEATURES = ["x_mom21", "x_mom63", "x_mom126", "x_mom252", "x_trend", "x_efficiency", "x_drawdown", "x_downside"]


def ridge_samples(features: DataFrame) -> DataFrame:
    """Scaled features, the label from the next open to the 22nd after, and validity."""
    from marketframe.functions.timeseries import by_symbol, divide

    vol = F.greatest("vol", F.lit(MIN_VOLATILITY))
    w = by_symbol()
    label = (divide(F.lead("open", MATURITY).over(w), F.lead("open", 1).over(w)) - 1) / vol
    x = {
        "x_mom21": F.col("mom21") / vol, "x_mom63": F.col("mom63") / vol, "x_mom126": F.col("mom126") / vol,
        "x_mom252": F.col("mom252") / vol, "x_trend": F.col("trend120") / vol, "x_efficiency": F.col("efficiency"),
        "x_drawdown": F.col("drawdown") / vol, "x_downside": F.col("downside") / vol,
    }
    d = features.select("symbol", "date", (F.col("session_no") - 1).alias("i"), "eligible", label.alias("y"), *[v.alias(k) for k, v in x.items()])
    known = F.col("eligible")
    for c in FEATURES:
        known = known & F.col(c).isNotNull()
    return d.withColumn("valid", known)


def fit_dates(month_firsts: DataFrame) -> DataFrame:
    """Fit sessions with their position ``f`` and the month they start."""
    return month_firsts.select(F.col("date").alias("fit_date"), F.col("month"), (F.col("session_no") - 1).alias("f"))


def training_rows(samples: DataFrame, fits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each usable sample once per fit whose window [f-756, f-21) contains it.

    A sample can serve the fits up to 756 sessions after it. Those sessions' months are
    looked up in the calendar (at most 366 rows a year), so the join is on the month.
    """
    d = samples.where(F.col("valid") & F.col("y").isNotNull() & (F.col("i") % STEP == 0))
    end = sessions.agg(F.max("session_no")).scalar()
    d = d.withColumn("_end", end).withColumn("_last", F.least(F.col("i") + 1 + TRAIN, F.col("_end")))
    until = sessions.select(F.col("session_no").alias("_last"), F.col("date").alias("_until"))
    d = d.join(F.broadcast(until), "_last").withColumn(
        "month", F.explode(F.sequence(F.trunc("date", "MM"), F.trunc("_until", "MM"), F.expr("INTERVAL 1 MONTH"))))
    j = d.drop("_end", "_last", "_until").join(fits, "month")
    return j.where((F.col("i") >= F.greatest(F.lit(0), F.col("f") - TRAIN)) & (F.col("i") < F.greatest(F.lit(0), F.col("f") - STEP)))


def fit_moments(rows: DataFrame) -> DataFrame:
    """Per fit: sample count, last dates, feature means and spreads; needs 150 samples."""
    return rows.groupBy("fit_date", "month").agg(
        F.count(F.lit(1)).alias("samples"), F.max("i").alias("last_i"),
        *[F.avg(c).alias(f"m_{c}") for c in FEATURES],
        *[F.greatest(F.stddev_pop(c), F.lit(MIN_SPREAD)).alias(f"s_{c}") for c in FEATURES],
    ).where(F.col("samples") >= MIN_SAMPLES)


def _score(c: str):
    z = (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")
    return F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP))


def fit_ridge(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """Coefficients per fit date beside the moments."""
    z = {"z0": F.lit(1.0), **{f"z{k}": _score(c) for k, c in enumerate(FEATURES, 1)}}
    y = F.greatest(F.least(F.col("y"), F.lit(1.0)), F.lit(-1.0))
    d = rows.join(moments, ["fit_date", "month"]).select("fit_date", y.alias("y"), *[v.alias(k) for k, v in z.items()])
    names = list(z)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = d.groupBy("fit_date").agg(
        *[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in pairs], *[F.sum(F.col(a) * F.col("y")).alias(f"{a}y") for a in names])
    columns, targets = [f"{a}{b}" for a, b in pairs], [f"{a}y" for a in names]

    def solve(batches):
        import pandas as pd

        from marketframe.functions.solvers import ridge, symmetric

        for pdf in batches:
            if len(pdf):
                beta = ridge(symmetric(pdf[columns].to_numpy(float), len(names)), pdf[targets].to_numpy(float), PENALTY)
                yield pd.DataFrame({"fit_date": pdf["fit_date"].to_numpy(), "coefficients": list(beta)})

    fitted = sums.mapInPandas(solve, "fit_date date, coefficients array<double>")
    return moments.join(fitted, "fit_date")


def ridge_predictions(samples: DataFrame, model: DataFrame) -> DataFrame:
    """Score of every valid row under the model of its month."""
    d = samples.where("valid").withColumn("month", F.trunc("date", "MM")).join(model, "month")
    total = F.col("coefficients")[0]
    for k, c in enumerate(FEATURES, 1):
        total = total + F.col("coefficients")[k] * _score(c)
    return d.select("date", "symbol", total.alias("prediction"))


def fit_audit(model: DataFrame, sessions: DataFrame) -> DataFrame:
    """Samples, last feature date and last label date of each fit."""
    s = sessions.select((F.col("session_no") - 1).alias("i"), "date")
    return (
        model.join(s.select(F.col("i").alias("last_i"), F.col("date").alias("last_feature_date")), "last_i")
        .withColumn("_e", F.col("last_i") + MATURITY)
        .join(s.select(F.col("i").alias("_e"), F.col("date").alias("last_label_date")), "_e")
        .select("fit_date", "samples", "last_feature_date", "last_label_date"))
