"""Market breadth of the members in force on each date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import by_symbol, holds, rolling_count, rolling_mean
from marketframe.operators.asof import members_on


def breadth_signals(panel: DataFrame, members: DataFrame, sessions: DataFrame, *, min_members: int = 200,
                    fall: float = -2.0, window: int = 126, observed: int = 110, mean: int = 20) -> DataFrame:
    """Traded members, advancing share, large declines and share above the average.

    ``panel`` has ``pct_chg`` on the shared calendar. The index of each stock is built
    from its changes only; a thin date gives no signal, and averages need all their
    sessions.
    """
    r = F.col("pct_chg")
    step = panel.withColumn("_log", F.coalesce(F.log1p(r / 100), F.lit(0.0)))
    index = step.withColumn("_index", F.exp(F.sum("_log").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))))
    average = rolling_mean(F.col("_index"), window)
    warmed = holds((F.count(F.lit(1)).over(by_symbol().rowsBetween(1 - window, 0)) >= window) & (rolling_count(r, window) >= observed))
    own = index.select("symbol", "date", "pct_chg", warmed.alias("_warm"), holds(F.col("_index") > average).alias("_above"))
    inside = own.join(members_on(sessions.select("date"), members).select("date", "symbol"), ["date", "symbol"]).where("pct_chg IS NOT NULL")
    day = inside.groupBy("date").agg(
        F.count(F.lit(1)).alias("constituents_traded"),
        F.avg((r > 0).cast("double")).alias("_up"), F.avg((r <= fall).cast("double")).alias("_down"),
        F.count_if("_warm").alias("_n"), F.count_if(F.col("_warm") & F.col("_above")).alias("_a"))
    all_days = sessions.select("date").join(day, "date", "left")
    wide = holds(F.col("constituents_traded") >= min_members)
    shares = all_days.select(
        "date", F.coalesce("constituents_traded", F.lit(0)).alias("constituents_traded"),
        F.when(wide, F.col("_up")).alias("advancing_share"), F.when(wide, F.col("_down")).alias("_drop"),
        F.when(F.col("_n") >= min_members, F.col("_a") / F.col("_n")).alias("above_126"))
    w = Window.orderBy("date")
    return shares.select(
        "date", "constituents_traded", "advancing_share",
        rolling_mean(F.col("advancing_share"), mean, over=w).alias("advancing_20"),
        rolling_mean(F.col("_drop"), mean, over=w).alias("large_decline_20"), "above_126")
