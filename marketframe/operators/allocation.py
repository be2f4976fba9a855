"""From scores and budgets to weights.

Weights are long tables (strategy_id, date, symbol, weight). A group of one strategy
and date has as many rows as the allocation universe has assets, which the asset
table bounds; variants run side by side through ``strategy_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import YEAR_SESSIONS, flag, rolling_count, ts_mean
from marketframe.session import cut_lineage

# Largest share of each asset class, of one asset, and of all equity.
GROUP_CAPS = {
    "cn_equity": 0.35, "us_equity": 0.30, "hk_equity": 0.15, "gold": 0.30, "bond": 0.30, "commodity": 0.20,
}
ASSET_CAP, EQUITY_CAP = 0.30, 0.60

DAY = ["strategy_id", "date"]


def group_cap(bucket: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in GROUP_CAPS.items() for x in kv])[bucket]


# --- budgets --------------------------------------------------------------------------


def own_row_trend(own: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Share of moving averages the close is at or above, on each symbol's own rows."""
    c = F.col("close")
    votes = [flag(c / ts_mean(c, w) - 1 >= 0) for w in windows]
    return own.select("symbol", "date", (sum(votes[1:], votes[0]) / len(windows)).alias("trend"))


def fixed_budget(panel: DataFrame, assets: DataFrame, eligible: Column, trend: DataFrame | None,
                 cash_buffer: float = 0.01, trend_floor: float = 0.5, strategy: str = "fixed") -> DataFrame:
    """Asset budget times trend scale times eligibility; bonds and baselines have no trend scale."""
    d = panel.select("symbol", "date", "session_no", eligible.alias("eligible")).join(assets, "symbol")
    if trend is None:
        scale = F.lit(1.0)
    else:
        d = d.join(trend, ["symbol", "date"], "left")
        scaled = trend_floor + (1 - trend_floor) * F.coalesce("trend", F.lit(0.0))
        scale = F.when(F.col("bucket") == "bond", 1.0).otherwise(scaled)
    weight = F.col("weight") * (1 - cash_buffer) * scale * F.col("eligible").cast("double")
    return d.select(F.lit(strategy).alias("strategy_id"), "date", "session_no", "symbol", "bucket", "position", weight.alias("weight"))


def explode_history(weights: DataFrame, returns: DataFrame, window: int, carry: list[str]) -> DataFrame:
    """Join each positive weight to the returns of its last ``window`` sessions.

    The history is addressed by session number, so it is an equi-join whose size is
    linear in weights times window; no pair of assets is ever formed.
    """
    back = F.explode(F.sequence(F.lit(0), F.lit(window - 1)))
    past = weights.withColumn("_k", back).withColumn("_s", F.col("session_no") - F.col("_k")).select(*carry, "_s")
    r = returns.select("symbol", F.col("session_no").alias("_s"), "ret")
    return past.join(r, ["symbol", "_s"], "left")


def portfolio_risk(weights: DataFrame, returns: DataFrame, window: int) -> DataFrame:
    """Annual volatility of today's weights over the last ``window`` sessions.

    ``complete`` says whether every held asset has a return on every session. The
    result equals the square root of w'Cw with the sample covariance C.
    """
    held = weights.where("weight > 0").select("strategy_id", "date", "session_no", "symbol", "weight")
    h = explode_history(held, returns, window, ["strategy_id", "date", "session_no", "symbol", "weight"])
    daily = h.groupBy(*DAY, "_s").agg(
        F.sum(F.col("weight") * F.col("ret")).alias("_p"), F.count("ret").alias("_known"), F.count(F.lit(1)).alias("_all"))
    return daily.groupBy(*DAY).agg(
        (F.stddev_samp("_p") * YEAR_SESSIONS**0.5).alias("risk"),
        (F.min(F.col("_known") - F.col("_all")) == 0).alias("complete"))


def volatility_ceiling(weights: DataFrame, returns: DataFrame, window: int, target: float) -> DataFrame:
    """Scale a day's weights down to a volatility target; an incomplete history gives zero.

    The first ``window`` sessions have no full history and stay as they are.
    """
    j = weights.join(portfolio_risk(weights, returns, window), DAY, "left")
    due = F.col("session_no") > window
    scale = (
        F.when(~due | F.col("risk").isNull() & F.col("complete").isNull(), 1.0)
        .when(~F.col("complete"), 0.0)
        .when(F.col("risk") > target, target / F.col("risk")).otherwise(1.0)
    )
    return j.withColumn("weight", F.col("weight") * scale).drop("complete")


# --- water filling ---------------------------------------------------------------------


def water_fill(df: DataFrame, keys: list[str], score: str, cap: Column, budget: Column, tie: str, out: str) -> DataFrame:
    """Add ``out`` = min(score × λ, cap) with λ chosen so that a key's rows sum to its budget.

    In order of cap/score the assets reach their caps one after the other, so λ
    follows from running sums: it belongs to the first row whose own candidate does
    not exceed its cap. The budget is at most the sum of the active caps.
    """
    whole = Window.partitionBy(*keys)
    d = df.withColumns({"_s": F.greatest(F.coalesce(F.col(score), F.lit(0.0)), F.lit(0.0)), "_cap": cap, "_b": budget})
    active = F.col("_s") > 0
    d = d.withColumns({
        "_ratio": F.when(active, F.col("_cap") / F.col("_s")),
        "_active_cap": F.when(active, F.col("_cap")).otherwise(0.0),
    })
    order = whole.orderBy(F.col("_ratio").asc_nulls_last(), tie)
    d = d.withColumns({
        "_n": F.row_number().over(order),
        "_total": F.sum("_active_cap").over(whole),
        "_before": F.coalesce(F.sum("_active_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_s").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.least("_b", "_total") - F.col("_before")) / F.when(active, F.col("_rest"))
    d = d.withColumn("_level", level)
    reached = F.col("_level") <= F.col("_ratio") * (1 + 1e-12)
    crossing = F.min(F.when(reached, F.struct("_ratio", "_n", "_level"))).over(whole)
    d = d.withColumn("_lambda", F.coalesce(crossing["_level"], F.max("_ratio").over(whole), F.lit(0.0)))
    return d.withColumn(out, F.greatest(F.least(F.col("_s") * F.col("_lambda"), F.col("_cap")), F.lit(0.0))).drop(
        "_s", "_cap", "_b", "_ratio", "_active_cap", "_n", "_total", "_before", "_rest", "_level", "_lambda")


# --- group risk --------------------------------------------------------------------------


def pair_names(groups: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(groups) for b in groups[i:]]


def group_mixing(panel: DataFrame, assets: DataFrame, eligible: Column, window: int, min_history: int) -> DataFrame:
    """Base ratios inside each asset class over the assets usable on a date.

    ``panel`` carries ``ret`` and ``trend``. An asset with a hole in its risk window
    leaves the allocation for that day.
    """
    usable = eligible & (rolling_count(F.col("ret"), window) >= window)
    d = panel.select("symbol", "date", "session_no", F.coalesce("trend", F.lit(0.0)).alias("trend"), usable.alias("ok"))
    d = d.where("ok").where(F.col("session_no") > max(window, min_history - 1)).join(assets, "symbol")
    mix = F.col("weight") / F.sum("weight").over(Window.partitionBy("date", "bucket"))
    return d.select("date", "session_no", "symbol", "bucket", "position", "trend", mix.alias("mixing"))


def group_covariance(mixing: DataFrame, returns: DataFrame, window: int, shrinkage: float) -> DataFrame:
    """Annual covariance of the class returns per date, shrunk to its diagonal.

    One column per unordered pair of the six classes; a class without usable assets
    has missing entries.
    """
    groups = list(GROUP_CAPS)
    h = explode_history(mixing, returns, window, ["date", "session_no", "symbol", "bucket", "mixing"])
    value = F.col("mixing") * F.col("ret")
    daily = h.groupBy("date", "_s").agg(*[F.sum(F.when(F.col("bucket") == g, value)).alias(g) for g in groups])
    def entry(a: str, b: str) -> Column:
        c = F.covar_samp(a, b) * YEAR_SESSIONS
        return (c + 1e-8) if a == b else c * (1 - shrinkage)
    return daily.groupBy("date").agg(*[entry(a, b).alias(f"{a}__{b}") for a, b in pair_names(groups)])


def inverse_volatility_scores(cov: DataFrame) -> DataFrame:
    """(date, bucket, score): 1/volatility, normalized over the classes present."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(g).alias("bucket"), F.col(f"{g}__{g}").alias("variance")) for g in GROUP_CAPS]))
    d = cov.select("date", rows.alias("r")).select("date", "r.*").where("variance IS NOT NULL")
    raw = 1 / F.sqrt("variance")
    return d.select("date", "bucket", (raw / F.sum(raw).over(Window.partitionBy("date"))).alias("score"))


def equal_risk_scores(cov: DataFrame, sweeps: int = 40) -> DataFrame:
    """(date, bucket, score): classes with equal contributions to risk.

    Coordinate descent has no closed SQL form; it runs over Arrow batches of dates,
    all dates of a batch at once, and a date's matrix is one row.
    """
    groups = list(GROUP_CAPS)
    columns = [f"{a}__{b}" for a, b in pair_names(groups)]

    def solve(batches):
        import pandas as pd

        from marketframe.functions.solvers import equal_risk, symmetric

        for pdf in batches:
            x = equal_risk(symmetric(pdf[columns].to_numpy(float), len(groups)), sweeps)
            out = pd.DataFrame(x, columns=groups)
            out.insert(0, "date", pdf["date"].to_numpy())
            yield out

    schema = "date date, " + ", ".join(f"{g} double" for g in groups)
    wide = cov.select("date", *columns).mapInPandas(solve, schema)
    long = wide.unpivot(["date"], groups, "bucket", "score")
    return long.where(F.col("score").isNotNull() & ~F.isnan("score"))


def adaptive_weights(
    mixing: DataFrame, returns: DataFrame, assets: DataFrame, scores: DataFrame, *, window: int, target: float,
    mix: float = 1.0, trend_budget: bool = False, cash_buffer: float = 0.01, tilts: DataFrame | None = None,
    bond_caps: DataFrame | None = None, strategy: str = "adaptive",
) -> DataFrame:
    """Class scores → caps and budget → asset weights → volatility ceiling.

    ``tilts`` may carry ``value_tilt`` (mean value score) and ``rate_change`` per date;
    ``bond_caps`` a ``bond_cap`` per date.
    """
    priors = assets.groupBy("bucket").agg(F.sum("weight").alias("prior"))
    per_group = mixing.groupBy("date", "session_no", "bucket").agg(
        F.sum(F.col("trend") * F.col("mixing")).alias("trend"), F.count(F.lit(1)).alias("members"))
    d = per_group.join(scores, ["date", "bucket"]).join(priors, "bucket")
    total = F.sum("prior").over(Window.partitionBy("date"))
    score = mix * F.col("score") + (1 - mix) * F.col("prior") / total
    if trend_budget:
        score = score * (0.5 + F.col("trend"))
    if tilts is not None:
        d = d.join(tilts, "date", "left")
        score = score * F.when(
            (F.col("bucket") == "cn_equity") & F.col("value_tilt").isNotNull(), 1 + 0.25 * F.col("value_tilt")).otherwise(1.0)
        score = score * F.when(
            F.col("bucket").isin("cn_equity", "bond") & F.col("rate_change").isNotNull(), 1 - 0.20 * F.tanh("rate_change")).otherwise(1.0)
    d = d.withColumn("score", score)
    cap = F.least(group_cap(F.col("bucket")), ASSET_CAP * F.col("members"))
    if bond_caps is not None:
        d = d.join(bond_caps, "date", "left")
        cap = F.when(F.col("bucket") == "bond", F.least(cap, F.col("bond_cap"))).otherwise(cap)
    filled = water_fill(d, ["date"], "score", cap, F.lit(1 - cash_buffer), "bucket", "allocation")
    is_equity = F.col("bucket").endswith("equity")
    equity = F.sum(F.when(is_equity, F.col("allocation")).otherwise(0.0)).over(Window.partitionBy("date"))
    bounded = F.when(is_equity & (equity > EQUITY_CAP), F.col("allocation") * EQUITY_CAP / equity).otherwise(F.col("allocation"))
    groups = filled.select("date", "bucket", bounded.alias("allocation"))
    w = mixing.join(groups, ["date", "bucket"]).select(
        F.lit(strategy).alias("strategy_id"), "date", "session_no", "symbol", "bucket",
        F.least(F.col("mixing") * F.col("allocation"), F.lit(ASSET_CAP)).alias("weight"))
    w = cut_lineage(w)  # used by the risk estimate and by the result
    risk = portfolio_risk(w, returns, window).select(*DAY, "risk")
    scale = F.least(F.lit(1.0), target / F.greatest("risk", F.lit(1e-12)))
    return w.join(risk, DAY, "left").withColumn("scale", scale).withColumn("weight", F.col("weight") * F.coalesce("scale", F.lit(1.0)))


# --- named pairs ------------------------------------------------------------


def rolling_pairs(returns: DataFrame, pairs: list[tuple[str, str]], window: int, needed: int, shrinkage: float = 0.0) -> DataFrame:
    """Rolling correlation and annual covariance of the pairs the caller names.

    Each return goes to the named pairs that hold its symbol, and the two sides of a pair
    and date meet in one aggregate: as many rows as named pairs have dates, whatever the
    size of the universe. ``returns`` has a row per symbol and session, so a date on which
    one side is missing keeps its slot in the window.
    """
    sides = [(s, side, a, b) for a, b in pairs for s, side in ((a, 0), (b, 1))]
    legs = returns.sparkSession.createDataFrame(sides, "symbol string, side int, a string, b string")
    leg = returns.select("symbol", "date", "ret").join(legs, "symbol")
    met = leg.groupBy("a", "b", "date").agg(
        F.max(F.when(F.col("side") == 0, F.col("ret"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("ret"))).alias("y"))
    slots = met.select("date", "a", "b", F.when(F.col("y").isNotNull(), F.col("x")).alias("x"), F.when(F.col("x").isNotNull(), F.col("y")).alias("y"))
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(1 - window, 0)
    x, y = F.col("x"), F.col("y")
    shrink = F.when(F.col("a") == F.col("b"), 1.0).otherwise(1 - shrinkage)
    return slots.select(
        "date", "a", "b", F.count(x).over(w).alias("n"), F.corr(x, y).over(w).alias("correlation"),
        (F.covar_samp(x, y).over(w) * YEAR_SESSIONS * shrink).alias("covariance")).where(F.col("n") >= needed)


# --- rotation -----------------------------------------------------------------------------


def rotation_weights(
    scores: DataFrame, assets: DataFrame, returns: DataFrame, sessions: DataFrame, *, top_n: int, max_asset: float,
    max_group: float, cash_buffer: float, window: int, targets: list[float],
) -> DataFrame:
    """Picks per sleeve with class limits, averaged, bonds filled in, then the shrunk ceiling.

    Each family is a variant for each of the target volatilities: the picks and the risk are
    worked out once, and only the last step differs.

    ``scores`` has one row per family, sleeve, symbol and date. Ranking, sizing, class
    limits and the bond fill are windows inside one (family, date) partition, so the
    scores are shuffled once.
    """
    day = ["family", "date"]
    per_group = max(1, -int(-(top_n * max_group) // 1))
    bond = F.col("bucket") == "bond"
    s = scores.join(assets.select("symbol", "bucket", "position"), "symbol").repartition(*day)
    s = s.withColumn("_c", F.col("allowed") & ~bond & F.col("score").isNotNull())
    best = [F.desc("score"), "position"]
    s = s.withColumn("_g", F.row_number().over(Window.partitionBy(*day, "sleeve", "bucket", "_c").orderBy(*best)))
    s = s.withColumn("_c", F.col("_c") & (F.col("_g") <= per_group))
    s = s.withColumn("_r", F.row_number().over(Window.partitionBy(*day, "sleeve", "_c").orderBy(*best)))
    picked = F.col("_c") & (F.col("_r") <= top_n)
    raw = F.when(F.col("family") == "dual", 1.0).otherwise(1 / F.greatest("vol", F.lit(0.08)))
    s = s.withColumn("_raw", F.when(picked, raw))
    share = F.col("_raw") / F.sum("_raw").over(Window.partitionBy(*day, "sleeve"))
    s = s.withColumn("_w", F.least(share * (1 - cash_buffer), F.when(picked, F.lit(max_asset))))
    total = F.sum("_w").over(Window.partitionBy(*day, "sleeve", "bucket"))
    s = s.withColumn("_w", F.when(total > max_group, F.col("_w") * max_group / total).otherwise(F.col("_w")))
    fill = bond & F.col("eligible") & (F.col("trend60") > 0)
    mean = s.groupBy(*day, "symbol").agg(
        (F.coalesce(F.sum("_w"), F.lit(0.0)) / F.count_distinct("sleeve")).alias("weight"),
        F.max(F.coalesce(fill, F.lit(False))).alias("_fill"), F.first("position").alias("position"))
    whole = Window.partitionBy(*day)
    room = F.greatest(F.lit(0.0), 1 - cash_buffer - F.sum("weight").over(whole))
    earlier = (F.row_number().over(Window.partitionBy(*day, "_fill").orderBy("position")) - 1) * max_asset
    added = F.when(F.col("_fill"), F.least(F.lit(max_asset), F.greatest(F.lit(0.0), room - earlier))).otherwise(0.0)
    w = mean.withColumn("weight", F.col("weight") + added).where("weight > 0").select(
        F.col("family").alias("strategy_id"), "date", "symbol", "weight").join(sessions, "date")
    return shrunk_ceiling(cut_lineage(w), returns, window, targets, 0.25)


def shrunk_ceiling(weights: DataFrame, returns: DataFrame, window: int, targets: list[float], shrinkage: float) -> DataFrame:
    """Volatility ceiling with the covariance shrunk to its diagonal, for each target volatility.

    w'((1-s)C + s·diag C)w = (1-s)·var(portfolio) + s·Σ w²·var(asset), so the pairs
    are not needed. Without a full history of every held asset the weights are zero.
    """
    over = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - window, 0)
    own = returns.select("symbol", "date", (F.var_samp("ret").over(over) * YEAR_SESSIONS).alias("variance"))
    alone = weights.join(own, ["symbol", "date"]).groupBy(*DAY).agg(F.sum(F.col("weight") * F.col("weight") * F.col("variance")).alias("alone"))
    j = weights.join(portfolio_risk(weights, returns, window), DAY).join(alone, DAY)
    risk = F.sqrt(F.greatest(F.lit(0.0), (1 - shrinkage) * F.col("risk") * F.col("risk") + shrinkage * F.col("alone")))
    ready = F.col("complete") & (F.col("session_no") >= window)
    each = j.withColumn("target_vol", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    target = F.col("target_vol")
    scale = F.when(~ready, 0.0).when(risk > target, target / risk).otherwise(1.0)
    return each.withColumn("weight", F.col("weight") * scale).select("strategy_id", "target_vol", "date", "symbol", "weight")


# --- combining weights ------------------------------------------------------------------


def blend(a: DataFrame, b: DataFrame, fraction: float, strategy: str) -> DataFrame:
    """(1 - fraction)·a + fraction·b on all dates and symbols of either side."""
    j = a.select("date", "symbol", F.col("weight").alias("wa")).join(
        b.select("date", "symbol", F.col("weight").alias("wb")), ["date", "symbol"], "full_outer")
    zero = F.lit(0.0)
    w = (1 - fraction) * F.coalesce("wa", zero) + fraction * F.coalesce("wb", zero)
    return j.select(F.lit(strategy).alias("strategy_id"), "date", "symbol", w.alias("weight"))


def carry_decisions(weights: DataFrame, decisions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Hold the weights of the last decision date on every session up to the next one."""
    w = Window.orderBy("date")
    day = sessions.join(decisions.select("date", F.lit(True).alias("_d")), "date", "left").select(
        "date", F.last(F.when(F.col("_d"), F.col("date")), ignorenulls=True).over(w).alias("decided"))
    held = weights.withColumnRenamed("date", "decided")
    return day.join(held, "decided").drop("decided")


def stock_sleeve(core: DataFrame, picks: DataFrame, regime: DataFrame, sessions: DataFrame, fraction: float, n: int, strategy: str) -> DataFrame:
    """Give fraction × regime to the month's picks in equal parts; the core keeps the rest."""
    month = F.trunc("date", "MM")
    held = picks.select(month.alias("month"), "symbol").distinct()
    budget = sessions.select("date", month.alias("month")).join(held.select("month").distinct(), "month", "left_semi").join(
        regime, "date").select("date", "month", (fraction * F.col("regime")).alias("budget"))
    kept = core.join(budget.select("date", "budget"), "date", "left").select(
        "date", "symbol", (F.col("weight") * (1 - F.coalesce("budget", F.lit(0.0)))).alias("weight"))
    bought = budget.join(held, "month").select("date", "symbol", (F.col("budget") / n).alias("weight"))
    return kept.unionByName(bought).select(F.lit(strategy).alias("strategy_id"), "date", "symbol", "weight")


def joint_targets(core: DataFrame, picks: DataFrame, sessions: DataFrame, fraction: float, control: tuple[str, str] | None = None) -> DataFrame:
    """Core scaled by what the sector picks take; plus masks for planned and forced changes.

    The budget is half the fraction per pick. A changed budget forces the core, the
    month's first session plans it, the week's first session plans the sectors.
    """
    n = picks.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("date")
    day = sessions.join(n, "date", "left").select("date", (fraction * F.coalesce("_n", F.lit(0)) / 2).alias("budget"))
    before = F.lag("date").over(w)
    day = day.select(
        "date", "budget", (F.abs(F.col("budget") - F.coalesce(F.lag("budget").over(w), F.lit(0.0))) > 1e-10).alias("forced"),
        (before.isNull() | (F.trunc("date", "MM") != F.trunc(before, "MM"))).alias("month"),
        (before.isNull() | (F.trunc("date", "week") != F.trunc(before, "week"))).alias("week"))
    c = core.join(day, "date")
    own = F.col("weight") * (1 - F.col("budget"))
    if control:
        own = own + F.when(F.col("symbol").isin(*control), F.col("budget") / 2).otherwise(0.0)
    planned = F.col("month") | F.col("forced")
    if control:
        planned = planned | (F.col("symbol").isin(*control) & F.col("week"))
    rows = c.select("date", "symbol", own.alias("weight"), planned.cast("int").alias("planned"), F.col("forced").cast("int").alias("forced"))
    if control:
        return rows
    sectors = picks.join(day, "date").select(
        "date", "symbol", F.lit(fraction / 2).alias("weight"), F.col("week").cast("int").alias("planned"), F.lit(0).alias("forced"))
    return rows.unionByName(sectors)


def matched_budget(weights: DataFrame, core_symbols: DataFrame, fund: str, strategy: str) -> DataFrame:
    """Control: what the strategy puts outside the core goes into one index fund."""
    tagged = weights.join(core_symbols.select("symbol", F.lit(1).alias("_core")), "symbol", "left")
    target = F.when(F.col("_core").isNull(), F.lit(fund)).otherwise(F.col("symbol"))
    return tagged.groupBy("date", target.alias("symbol")).agg(F.sum("weight").alias("weight")).select(
        F.lit(strategy).alias("strategy_id"), "date", "symbol", "weight")


def cap_and_redistribute(weights: DataFrame, capped: str, cap: float, receivers: tuple[str, str], asset_cap: float = ASSET_CAP) -> DataFrame:
    """Cap one asset; give the excess to two classes inside their own and their assets' room.

    The first pass splits the excess by the classes' budgets, the second uses what
    room is left. All four steps work inside one (strategy, date) partition.
    ``weights`` carries bucket and prior.
    """
    day = Window.partitionBy(*DAY)
    over = F.when(F.col("symbol") == capped, F.greatest(F.col("weight") - cap, F.lit(0.0))).otherwise(0.0)
    d = weights.withColumns({"_over": over, "_active": F.when(F.col("weight") > 0, F.col("prior")).otherwise(0.0)})
    d = d.withColumns({"_left": F.sum("_over").over(day), "weight": F.col("weight") - F.col("_over")})
    budgets = {b: F.sum(F.when(F.col("bucket") == b, F.col("prior")).otherwise(0.0)).over(day) for b in receivers}
    d = d.withColumns({f"_prior_{i}": budgets[b] for i, b in enumerate(receivers)})
    both = F.col("_prior_0") + F.col("_prior_1")
    for first in (True, False):
        for i, b in enumerate(receivers):
            mine = F.col("bucket") == b
            room = F.greatest(asset_cap - F.col("weight"), F.lit(0.0))
            d = d.withColumns({
                "_room": F.when(mine, room).otherwise(0.0),
                "_score": F.when(mine, F.col("_active")).otherwise(0.0),
            })
            used = F.sum(F.when(mine, F.col("weight")).otherwise(0.0)).over(day)
            free = F.sum(F.when(F.col("_score") > 0, F.col("_room")).otherwise(0.0)).over(day)
            d = d.withColumn("_group_room", F.greatest(F.lit(0.0), F.least(GROUP_CAPS[b] - used, free)))
            share = F.col("_left") * F.col(f"_prior_{i}") / both if first else F.col("_left")
            d = d.withColumn("_budget", F.least(share, F.col("_group_room")))
            d = d.withColumn("_budget", F.when(F.col("_budget") > 1e-12, F.col("_budget")).otherwise(0.0))
            d = water_fill(d, DAY, "_score", F.col("_room"), F.col("_budget"), "symbol", "_added")
            d = d.withColumns({"weight": F.col("weight") + F.col("_added"), "_left": F.col("_left") - F.sum("_added").over(day)})
    return d.select(*weights.columns)


def scaled(weights: DataFrame, flags: DataFrame, on: list[str], cut: Column, only: Column | None = None) -> DataFrame:
    """weight × (1 − cut) on the rows ``only`` selects; a missing cut is none."""
    j = weights.join(flags, on, "left")
    factor = 1 - F.coalesce(cut, F.lit(0.0))
    w = F.col("weight") * factor if only is None else F.when(only, F.col("weight") * factor).otherwise(F.col("weight"))
    return j.withColumn("weight", w).select(*weights.columns)


def combine_guards(base: DataFrame, guards: list[DataFrame]) -> DataFrame:
    """Multiply the base by each guard's ratio to it, bounded to 0…1."""
    d = base.withColumn("_w", F.col("weight"))
    for g in guards:
        r = g.select("strategy_id", "date", "symbol", F.col("weight").alias("_g"))
        ratio = F.least(F.greatest(F.coalesce(F.col("_g") / F.when(F.col("_w") > 0, F.col("_w")), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
        d = d.join(r, ["strategy_id", "date", "symbol"], "left").withColumn("weight", F.col("weight") * ratio).drop("_g")
    return d.drop("_w")


def cash_sleeve(weights: DataFrame, money: DataFrame, cash_buffer: float = 0.01) -> DataFrame:
    """Put the idle budget, at most 30 %, into a money fund on the dates it is liquid."""
    spare = weights.groupBy(*DAY).agg((1 - cash_buffer - F.sum("weight")).alias("spare"))
    room = F.least(F.greatest(F.col("spare"), F.lit(0.0)), F.lit(ASSET_CAP))
    row = spare.join(money, "date").select(*DAY, "symbol", F.when(F.col("liquid"), room).otherwise(0.0).alias("weight"))
    return weights.select(*DAY, "symbol", "weight").unionByName(row)


def resplit(assets: DataFrame, added: DataFrame) -> DataFrame:
    """Keep each class's budget and split it equally where new members joined."""
    both = assets.withColumn("_new", F.lit(0)).unionByName(added.withColumn("weight", F.lit(0.0)).withColumn("_new", F.lit(1)), allowMissingColumns=True)
    b = Window.partitionBy("bucket")
    grown = F.max("_new").over(b) > 0
    equal = F.sum("weight").over(b) / F.count(F.lit(1)).over(b)
    return both.select("symbol", "bucket", F.when(grown, equal).otherwise(F.col("weight")).alias("weight"))


def collapse_bucket(assets: DataFrame, bucket: str, into: str) -> DataFrame:
    """Give a class's whole budget to one of its assets."""
    total = F.sum("weight").over(Window.partitionBy("bucket"))
    mine = F.col("bucket") == bucket
    return assets.select("symbol", "bucket", F.when(mine, total).otherwise(F.col("weight")).alias("weight")).where(
        ~mine | (F.col("symbol") == into))


def constant_benchmark(assets: DataFrame, sessions: DataFrame, strategy_weights: DataFrame, strategy: str = "benchmark") -> DataFrame:
    """Constant weights, zero until the strategy first invests."""
    start = strategy_weights.where("weight > 0").agg(F.min("date")).scalar()
    days = sessions.select("date", F.year("date").alias("y")).withColumn("start", start)
    years = sessions.agg(F.array_sort(F.collect_set(F.year("date")))).scalar()
    rows = assets.withColumn("y", F.explode(years)).join(days, "y")
    w = F.when(F.col("date") >= F.col("start"), F.col("weight")).otherwise(0.0)
    return rows.select(F.lit(strategy).alias("strategy_id"), "date", "symbol", w.alias("weight"))


def trained_mean(weights: DataFrame, start: str, end: str, live: DataFrame) -> DataFrame:
    """Average weights of a training span, held where the base weight is positive."""
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    mean = weights.where(inside).groupBy("strategy_id", "symbol").agg(F.avg("weight").alias("mean"))
    j = live.join(mean, ["strategy_id", "symbol"], "left")
    return j.select("strategy_id", "date", "symbol", F.when(F.col("weight") > 0, F.col("mean")).otherwise(0.0).alias("weight"))
