"""Performance statistics of NAV tables (keys…, date, equity).

One curve has one row per session, so a window partition is bounded by the
calendar; many curves run side by side through their keys.
"""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import YEAR_SESSIONS, divide

Windows = list[tuple[str, str, str | None]]


def daily_rate(rf: float) -> float:
    return (1 + rf) ** (1 / YEAR_SESSIONS) - 1


def normalized(nav: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Each curve divided by its first value."""
    w = Window.partitionBy(key)
    return nav.withColumn("curve", F.col("equity") / F.min_by("equity", "date").over(w))


def drawdown_curve(nav: DataFrame, keys: list[str]) -> DataFrame:
    """Return, running peak, drawdown and normalized curve of each row."""
    w = Window.partitionBy(*keys).orderBy("date")
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return nav.withColumns({
        "ret": divide(F.col("equity"), F.lag("equity").over(w)) - 1,
        "drawdown": F.col("equity") / peak - 1,
        "curve": F.col("equity") / F.first("equity").over(w),
    })


def performance(nav: DataFrame, keys: list[str], rf: float = 0.02) -> DataFrame:
    """Return, risk, drawdown and tail statistics per key; fewer than 3 values give only a count."""
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    below = F.col("drawdown") < -1e-10
    d = drawdown_curve(nav.where("equity IS NOT NULL"), keys).withColumns({
        "island": F.count(F.when(~below, 1)).over(running),
        "q05": F.percentile("ret", 0.05).over(whole),
        "excess": F.col("ret") - daily_rate(rf),
    })
    d = d.withColumn("under", F.count(F.when(below, 1)).over(Window.partitionBy(*keys, "island")))
    loss = F.least(F.col("excess"), F.lit(0.0))
    g = d.groupBy(*keys).agg(
        F.count("equity").alias("n"), F.count("ret").alias("returns"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"),
        F.stddev_samp("ret").alias("sd"), F.avg("excess").alias("mean_excess"),
        F.sqrt(F.avg(F.when(F.col("excess").isNotNull(), loss * loss))).alias("down"),
        F.min("drawdown").alias("max_drawdown"), F.max_by("drawdown", "date").alias("current_drawdown"),
        F.max("under").alias("max_underwater_sessions"),
        F.min("ret").alias("worst_day"), F.max("ret").alias("best_day"),
        F.avg(F.when(F.col("ret") <= F.col("q05"), F.col("ret"))).alias("cvar_95"),
    )
    annual = YEAR_SESSIONS**0.5
    days = F.greatest(F.datediff("last_date", "first_date"), F.lit(1))
    vol, down = F.col("sd") * annual, F.col("down") * annual
    cagr = F.pow(F.col("last") / F.col("first"), F.lit(365.25) / days) - 1
    mdd = F.col("max_drawdown")
    values = {
        "total_return": F.col("last") / F.col("first") - 1,
        "cagr": cagr,
        "volatility": vol,
        "sharpe": F.when(vol > 1e-12, F.col("mean_excess") * YEAR_SESSIONS / vol),
        "sortino": F.when(down > 1e-12, F.col("mean_excess") * YEAR_SESSIONS / down),
        "max_drawdown": mdd,
        "current_drawdown": F.col("current_drawdown"),
        "max_underwater_sessions": F.col("max_underwater_sessions"),
        "calmar": F.when(mdd < 0, cagr / F.abs(mdd)),
        "worst_day": F.col("worst_day"),
        "best_day": F.col("best_day"),
        "cvar_95": F.col("cvar_95"),
    }
    enough = F.col("n") >= 3
    return g.select(
        *keys,
        F.when(enough, F.col("returns")).otherwise(F.col("n")).alias("observations"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("first_date", "last_date")],
        *[F.when(enough, v).alias(c) for c, v in values.items()],
    )


def in_windows(nav: DataFrame, windows: Windows, key: str = "strategy_id") -> DataFrame:
    """Repeat NAV rows for the named windows they belong to.

    A window also takes the last value before its start. The windows are a short
    parameter list, so they are filtered row by row and need no join.
    """
    def literal(name: str, start: str, end: str | None) -> Column:
        stop = F.lit(end).cast("date") if end else F.lit(Date(9999, 12, 31))
        return F.struct(F.lit(name).alias("period"), F.lit(start).cast("date").alias("a"), stop.alias("b"))

    nxt = F.lead("date").over(Window.partitionBy(key).orderBy("date"))
    listed = F.array(*[literal(*w) for w in windows])
    mine = F.filter(listed, lambda w: (
        ((F.col("date") >= w["a"]) & (F.col("date") <= w["b"]))
        | ((F.col("date") < w["a"]) & (F.col("_next") >= w["a"]) & (F.col("_next") <= w["b"]))
    ))
    return (nav.withColumn("_next", nxt).withColumn("_w", F.explode(mine))
            .withColumn("period", F.col("_w.period")).drop("_next", "_w"))


def in_years(nav: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Repeat NAV rows for their year and, as the value before the start, for the next one."""
    nxt = F.lead("date").over(Window.partitionBy(key).orderBy("date"))
    years = F.array_distinct(F.array_compact(F.array(F.year("date"), F.year("_next"))))
    return nav.withColumn("_next", nxt).withColumn("year", F.explode(years)).drop("_next")


def window_performance(nav: DataFrame, windows: Windows, rf: float = 0.02, key: str = "strategy_id") -> DataFrame:
    return performance(in_windows(nav, windows, key), [key, "period"], rf)


def yearly(nav: DataFrame, rf: float = 0.02, key: str = "strategy_id") -> DataFrame:
    return performance(in_years(nav, key), [key, "year"], rf)


def exposure(nav: DataFrame, keys: list[str]) -> DataFrame:
    """Average exposure and cash share of account curves (equity, cash)."""
    return nav.groupBy(*keys).agg(
        F.avg(1 - F.col("cash") / F.col("equity")).alias("average_exposure"),
        F.avg(F.col("cash") / F.col("equity")).alias("average_cash_weight"))


def cost_drag(nav: DataFrame, costs: DataFrame, multiples: tuple[int, ...], key: str = "strategy_id") -> DataFrame:
    """The same fills at a multiple of their cost: equity less the running extra cost."""
    daily = costs.groupBy(key, "date").agg(F.sum("cost").alias("cost"))
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    spent = nav.join(daily, [key, "date"], "left").withColumn("spent", F.coalesce(F.sum("cost").over(w), F.lit(0.0)))
    k = F.explode(F.array(*[F.lit(x) for x in multiples]))
    return spent.withColumn("multiple", k).select(
        key, "multiple", "date", (F.col("equity") - F.col("spent") * (F.col("multiple") - 1)).alias("equity"))


def weighted_returns(weights: DataFrame, returns: DataFrame, keys: list[str]) -> DataFrame:
    """Return of fixed weights on every date: the sum of weight times return."""
    return weights.join(returns, "symbol").groupBy(*keys, "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
