"""Choosing rows: per key, per date with caps, and among candidate strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key; an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(order)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, "_r.*")


def top_n(df: DataFrame, score: str, n: int, keys: list[str], tie: list[str], all_or_nothing: bool = False) -> DataFrame:
    """Best ``n`` rows per key by score, ties by ``tie``; optionally none if fewer exist."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *tie)
    ranked = df.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    if all_or_nothing:  # counted after the limit, which Spark then applies before the shuffle
        ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= n).drop("_n")
    return ranked


def top_n_capped(
    df: DataFrame, score: str, group: str, cap: int, n: int, keys: list[str], tie: list[str],
    min_distinct: int = 1, all_or_nothing: bool = False,
) -> DataFrame:
    """Best ``n`` per key with at most ``cap`` per group.

    Taking rows greedily from the top while a group has room is the same as ranking
    inside the groups first and then among the rows that are left.
    """
    usable = df.where(F.col(score).isNotNull() & F.col(group).isNotNull())
    if min_distinct > 1:
        level = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(score)))
        usable = usable.withColumn("_d", level).withColumn("_d", F.max("_d").over(Window.partitionBy(*keys)))
        usable = usable.where(F.col("_d") >= min_distinct).drop("_d")
    inside = Window.partitionBy(*keys, group).orderBy(F.desc(score), *tie)
    room = usable.withColumn("_g", F.row_number().over(inside)).where(F.col("_g") <= cap).drop("_g")
    return top_n(room, score, n, keys, tie, all_or_nothing)


def representatives(df: DataFrame, keys: list[str], index: str, group: str, liquidity: str, score: str,
                    incumbent: str, tie: list[str]) -> DataFrame:
    """One row per index (incumbent, then most liquid), then one per group (incumbent, then strongest)."""
    by_index = Window.partitionBy(*keys, index).orderBy(F.desc(incumbent), F.desc(liquidity), *tie)
    by_group = Window.partitionBy(*keys, group).orderBy(F.desc(incumbent), F.desc(score), F.desc(liquidity), *tie)
    one = df.withColumn("_i", F.row_number().over(by_index)).where("_i = 1").drop("_i")
    return one.withColumn("_g", F.row_number().over(by_group)).where("_g = 1").drop("_g")


def score_candidates(stats: DataFrame, min_observations: int, max_drawdown: float, worst_year: float | None = None) -> DataFrame:
    """Gate and score of each candidate: Sharpe + a quarter of Calmar, the latter bounded at 3."""
    ok = (F.col("observations") >= min_observations) & (F.col("max_drawdown") >= -max_drawdown)
    if worst_year is not None:
        ok = ok & (F.col("worst_year") >= worst_year)
    missing = F.lit(-99.0)
    score = F.coalesce("sharpe", missing) + 0.25 * F.least(F.lit(3.0), F.coalesce("calmar", missing))
    return stats.withColumns({"passed": F.coalesce(ok, F.lit(False)), "score": score})


def choose(scored: DataFrame, fallback: str, position: str | None = None) -> DataFrame:
    """Best passing candidate, the fallback if none passes; ties go to the first position."""
    passing = F.col("passed")
    order = F.struct("score", -F.col(position)) if position else F.struct("score")
    best = F.max_by(F.when(passing, F.col("strategy_id")), F.when(passing, order))
    return scored.agg(
        F.coalesce(best, F.lit(fallback)).alias("chosen"), F.count_if(passing).alias("passing"), F.max("score").alias("top"))


def acceptance(stats: DataFrame, baseline: str, sharpe_gain: float, drawdown_slack: float) -> DataFrame:
    """Gates of every candidate against the baseline's row."""
    b = stats.where(F.col("strategy_id") == baseline).select(
        "period", F.col("cagr").alias("b_cagr"), F.col("sharpe").alias("b_sharpe"), F.col("max_drawdown").alias("b_dd"))
    gates = {
        "better_return": F.col("cagr") > F.col("b_cagr"),
        "better_sharpe": F.col("sharpe") >= F.col("b_sharpe") + sharpe_gain,
        "bounded_drawdown": F.col("max_drawdown") >= F.col("b_dd") - drawdown_slack,
    }
    everything = gates["better_return"] & gates["better_sharpe"] & gates["bounded_drawdown"]
    return stats.where(F.col("strategy_id") != baseline).join(b, "period").select(
        "strategy_id", *[v.cast("int").alias(k) for k, v in gates.items()], everything.cast("int").alias("accepted"))


def stitch_by_year(rows: DataFrame, chosen: DataFrame, fallback: str) -> DataFrame:
    """Follow each year's chosen candidate; years without a choice follow the fallback."""
    tagged = rows.withColumn("year", F.year("date")).join(chosen, "year", "left")
    return tagged.where(F.col("strategy_id") == F.coalesce("chosen", F.lit(fallback))).drop("year", "chosen")


def reduction_test(rows: DataFrame, base: str, cagr: float = 0.002, sharpe: float = 0.03, drawdown: float = 0.01, reduction: float = 0.20) -> DataFrame:
    """Candidates within tolerance of the base in every capital size that trade enough less."""
    b = rows.where(F.col("model") == base).select(
        "capital", F.col("trades").alias("b_trades"), F.col("cagr").alias("b_cagr"), F.col("sharpe").alias("b_sharpe"), F.col("max_drawdown").alias("b_dd"))
    ok = (
        (F.col("cagr") >= F.col("b_cagr") - cagr) & (F.col("sharpe") >= F.col("b_sharpe") - sharpe)
        & (F.col("max_drawdown") >= F.col("b_dd") - drawdown))
    g = rows.where(F.col("model") != base).join(b, "capital").groupBy("model").agg(
        F.bool_and(ok).alias("_ok"), F.avg(1 - F.col("trades") / F.col("b_trades")).alias("mean_trade_reduction"))
    return g.select("model", F.col("_ok").cast("int").alias("tolerances"), "mean_trade_reduction",
                    (F.col("_ok") & (F.col("mean_trade_reduction") >= reduction)).cast("int").alias("eligible"))
