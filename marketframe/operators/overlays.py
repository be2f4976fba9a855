"""Regime and overlay flags from curves, leaders and published fund values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import by_symbol, holds, rolling, rolling_mean
from marketframe.operators.asof import asof_backward, lag_one_session
from marketframe.operators.dedup import keep_last
from marketframe.operators.panel import calendar_grid


def yield_flags(yields: DataFrame, series: str = "series") -> DataFrame:
    """Four fixed rules on aligned curves: rising, rising and high, steepening, credit stress."""
    w = Window.partitionBy(series).orderBy("date")
    y = F.col("gov_10y")
    d = yields.withColumns({"slope": y - F.col("gov_1y"), "spread": F.col("aaa_3y") - F.col("gov_3y")})

    def rise(c):
        return F.col(c) - F.lag(c, 63).over(w)

    high = rolling(lambda x: F.percentile(x, 0.75), F.col("spread"), 252, 126, w)
    return d.withColumns({
        "rising_10y": holds(rise("gov_10y") > 0.25),
        "rising_and_high_10y": holds((rise("gov_10y") > 0.15) & (y > rolling_mean(y, 126, over=w))),
        "steepening_curve": holds((rise("slope") > 0.25) & (rise("gov_10y") > 0.10)),
        "credit_stress": holds((rise("spread") > 0.20) & (F.col("spread") > high)),
    })


def bull_caps(leaders: DataFrame, average: int = 252, back: int = 126, normal: float = 0.30, bull: float | None = 0.20) -> DataFrame:
    """Cap per date: lower while at least two leaders are above average and above their past."""
    c = F.col("close")
    up = holds(c > rolling_mean(c, average)) & holds(c > F.lag(c, back).over(by_symbol()))
    strong = leaders.select("date", up.cast("bigint").alias("up")).groupBy("date").agg(F.sum("up").alias("strong"))
    cap = F.lit(normal) if bull is None else F.when(F.col("strong") >= 2, bull).otherwise(normal)
    return strong.withColumn("bond_cap", cap)


def published_premiums(bars: DataFrame, values: DataFrame, sessions: DataFrame) -> DataFrame:
    """Premium of the close on the valuation date, visible one session after its announcement."""
    usable = values.where("ann_date >= nav_date AND unit_nav > 0")
    last = keep_last(usable, ["symbol", "ann_date"], ["nav_date"])
    close = bars.select("symbol", F.col("date").alias("nav_date"), "close")
    known = (
        last.join(close, ["symbol", "nav_date"])
        .select("symbol", "ann_date", (F.col("close") / F.col("unit_nav") - 1).alias("premium"))
        .where(F.col("premium").between(-0.5, 0.5))
    )
    grid = calendar_grid(values.select("symbol").distinct(), sessions)
    found = asof_backward(grid, known, ["symbol"], "date", "ann_date", ["premium"], bucket="year", tolerance="INTERVAL 7 DAY")
    return lag_one_session(found.drop("matched_at"), ["premium"], ["symbol"])
