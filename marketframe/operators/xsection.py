"""Cross-section tests and scores: ranks, rank IC, quantile spreads, controlled IC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.ranks import percent_rank_average
from marketframe.functions.timeseries import by_symbol, divide
from marketframe.operators.ranking import with_spread_ranks, with_subset_ranks

# Weights of the composite families.
FAMILIES = {
    "quality_value": {"value": 0.4, "quality": 0.4, "low_vol": 0.2},
    "momentum_defensive": {"momentum": 0.5, "low_vol": 0.3, "quality": 0.2},
    "ensemble": {"value": 0.25, "quality": 0.25, "momentum": 0.25, "low_vol": 0.25},
}
# Factor groups and the members each needs.
GROUPS = {
    "revision": (["np_revision_63", "revision_breadth_63"], 2),
    "surprise": (["incremental_surprise", "seasonal_sue"], 1),
    "cash_quality": (
        ["cash_profitability", "negative_accruals", "gross_profitability", "working_capital_discipline"], 3),
}
RAW_FACTORS = [c for cols, _ in GROUPS.values() for c in cols]


def with_ranks(df: DataFrame, columns: list[str], keys: list[str], suffix: str = "_rank") -> DataFrame:
    """Average-tie percentile rank of each column among a key's rows."""
    return df.withColumns({c + suffix: percent_rank_average(F.col(c), *keys) for c in columns})


def composite(df: DataFrame, families: dict[str, dict[str, float]] = FAMILIES) -> DataFrame:
    """Weighted sums of component scores."""
    def total(weights: dict[str, float]) -> Column:
        parts = [F.col(c) * w for c, w in weights.items()]
        return sum(parts[1:], parts[0])

    return df.withColumns({name: total(w) for name, w in families.items()})


def mean_present(columns: list[str], needed: int) -> Column:
    """Average of the values that exist, if there are enough; a missing one is not a zero."""
    known = [F.col(c).isNotNull().cast("int") for c in columns]
    n = sum(known[1:], known[0])
    values = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    return F.when(n >= needed, sum(values[1:], values[0]) / n)


def factor_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of the raw factors, group scores and the balanced score (two groups or more)."""
    ranked = with_ranks(df, RAW_FACTORS, keys)
    grouped = ranked.withColumns({
        name: mean_present([c + "_rank" for c in cols], needed) for name, (cols, needed) in GROUPS.items()
    })
    return grouped.withColumn("balanced", mean_present(list(GROUPS), 2))


def forward_label(price: Column, horizon: int, over=None) -> Column:
    """Return from the next session's price to the one ``horizon`` later, on the shared calendar."""
    w = over or by_symbol()
    return divide(F.lead(price, horizon + 1).over(w), F.lead(price, 1).over(w)) - 1


def terminal_label(label: Column, entry: Column, entry_date: Column, exit_date: Column, delisting: Column) -> Column:
    """A total loss if the delisting falls after the entry session and up to the exit session."""
    lost = entry.isNotNull() & (entry_date < delisting) & (delisting <= exit_date)
    return F.when(F.coalesce(lost, F.lit(False)), -1.0).otherwise(label)


def safe_corr(n: Column, xy: Column, xx: Column, yy: Column) -> Column:
    """Correlation from centred sums; none for fewer than three rows or a flat side."""
    flat = (xx / n < 1e-24) | (yy / n < 1e-24)
    return F.when((n >= 3) & ~flat, xy / F.sqrt(F.when(~flat, xx * yy)))


def rank_ic(pairs: DataFrame, keys: list[str], value: str = "value", label: str = "label", needed: int = 4) -> DataFrame:
    """Spearman correlation per key over the rows with both sides known."""
    both = pairs.select(*keys, F.col(value).alias("_v"), F.col(label).alias("_l")).where("_v IS NOT NULL AND _l IS NOT NULL")
    ranked = with_spread_ranks(both, ["_v", "_l"], keys).withColumnsRenamed({"_v_rank": "_x", "_l_rank": "_y"})
    g = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("assets"),
        F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"),
        F.corr("_x", "_y").alias("rank_ic"))
    varied = (F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))
    return g.where(varied & (F.col("assets") >= needed)).select(*keys, "rank_ic", "assets")


def positive(r: Column) -> Column:
    """Share-of-positives vote; twelve digits keep a zero from counting by its rounding noise."""
    return (F.round(r, 12) > 0).cast("double")


def ic_summary(ic: DataFrame, horizon: int) -> DataFrame:
    r = F.col("rank_ic")
    return ic.where(r.isNotNull()).groupBy("factor").agg(
        F.avg(r).alias("mean_rank_ic"), F.stddev_samp(r).alias("ic_std"),
        F.avg(positive(r)).alias("positive_fraction"), F.count(r).alias("observations"),
    ).withColumn("horizon", F.lit(horizon))


#: Products of ranks that the controlled IC sums: factor x, label y, size c, momentum m.
PRODUCTS = [("x", "x"), ("y", "y"), ("x", "y"), ("x", "c"), ("x", "m"), ("y", "c"), ("y", "m"), ("c", "c"), ("c", "m"), ("m", "m")]


def factor_tests(long: DataFrame, keys: list[str]) -> DataFrame:
    """Raw IC, quantile spread and controlled IC per key.

    ``long`` carries ``value``, ``forward``, ``industry``, ``log_market_cap`` and
    ``momentum_raw``. The controlled IC correlates what is left of the factor's and
    the label's ranks after industry dummies, size rank and momentum rank: ranks are
    centred inside the industry, then the two slopes are taken out through sums of
    products. A row is shuffled once for each of the four ranked columns, by key and
    bucket of the value, so no task holds a key's rows; then each key and industry
    leaves its moments, combined before the shuffle. A key with a null has no
    controlled IC. ``long`` is read five times: settle it if it is dear.
    """
    known = ["industry", "log_market_cap", "momentum_raw"]
    control = " AND ".join(f"{c} IS NOT NULL" for c in known)
    d = long.where("value IS NOT NULL AND forward IS NOT NULL").select(
        F.struct(*keys).alias("_key"), "value", "forward", *known, F.expr(control).alias("_control"))
    inside, every = F.col("_control"), F.lit(True)
    r = with_subset_ranks(d, d, "value", {"_x": every, "x": inside}, "_key")
    r = with_subset_ranks(r, d, "forward", {"_y": every, "y": inside}, "_key")
    r = with_subset_ranks(r, d, "log_market_cap", {"c": inside}, "_key")
    r = with_subset_ranks(r, d, "momentum_raw", {"m": inside}, "_key")
    x, y, f = F.col("_x"), F.col("_y"), F.col("forward")
    top, bottom = F.when(x >= 0.8, f), F.when(x <= 0.2, f)
    n = F.count(F.lit(1))
    parts = r.groupBy("_key", "industry").agg(
        n.alias("_n"), F.avg(x).alias("_ax"), F.avg(y).alias("_ay"), F.min(x).alias("_x0"), F.max(x).alias("_x1"),
        (F.covar_pop(x, x) * n).alias("_xx"), (F.covar_pop(y, y) * n).alias("_yy"), (F.covar_pop(x, y) * n).alias("_xy"),
        F.sum(top).alias("_top"), F.sum(bottom).alias("_bottom"), F.count(top).alias("_nt"), F.count(bottom).alias("_nb"),
        F.count("x").alias("_cn"), *[(F.covar_pop(F.col(a), F.col(b)) * F.count("x")).alias(a + b) for a, b in PRODUCTS])
    # a row per key and industry from here on; moments about an industry's mean become moments about the key's
    w = Window.partitionBy("_key")
    mean = {a: F.sum(F.col(a) * F.col("_n")).over(w) / F.sum("_n").over(w) for a in ("_ax", "_ay")}
    parts = parts.withColumns({"_dx": F.col("_ax") - mean["_ax"], "_dy": F.col("_ay") - mean["_ay"]})

    def about(moment: str, a: str, b: str) -> Column:
        return F.sum(F.col(moment) + F.col("_n") * F.col(a) * F.col(b))

    s = parts.groupBy("_key").agg(
        F.sum("_n").alias("observations"), about("_xx", "_dx", "_dx").alias("_xx"), about("_yy", "_dy", "_dy").alias("_yy"),
        about("_xy", "_dx", "_dy").alias("_xy"), F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"),
        *[F.sum(c).alias(c) for c in ("_top", "_bottom", "_nt", "_nb")], F.sum("_cn").alias("controlled_observations"),
        F.count(F.when(F.col("_cn") > 0, 1)).alias("_k"), *[F.sum(a + b).alias(a + b) for a, b in PRODUCTS])
    count, wide = F.col("observations"), F.col("observations") >= 20
    # the lowest and the highest rank tell how many rows tie there; a third level is what is left
    at_ends = F.round(2 * F.col("_x0") * count) - 1 + F.round(2 * (1 - F.col("_x1")) * count) + 1
    spread = wide & (F.col("_nt") >= 3) & (F.col("_nb") >= 3) & (F.col("_x0") < F.col("_x1")) & (at_ends < count)
    sloped = wide & (F.sqrt(F.col("_xx") / count) >= 1e-12) & (F.sqrt(F.col("_yy") / count) >= 1e-12)
    s = controlled_ic(s).withColumns({
        "raw_ic": F.when(sloped, F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))),
        "top_mean": F.when(spread, F.col("_top") / F.col("_nt")), "bottom_mean": F.when(spread, F.col("_bottom") / F.col("_nb"))})
    named = wide & ~F.greatest(*[F.col(f"_key.{k}").isNull() for k in keys], F.lit(False))
    return s.select(
        *[F.col(f"_key.{k}").alias(k) for k in keys], "observations", "raw_ic", "top_mean", "bottom_mean",
        (F.col("top_mean") - F.col("bottom_mean")).alias("top_minus_bottom"), F.when(named, F.col("controlled_ic")).alias("controlled_ic"),
        F.when(named, F.col("controlled_observations")).otherwise(F.lit(0).cast("bigint")).alias("controlled_observations"))


def controlled_ic(s: DataFrame) -> DataFrame:
    """Correlation of rank residuals after industry, size and momentum, from the sums of centred products."""

    def share(a: Column, b: Column, size: Column) -> Column:
        return F.when(size > 1e-12, a * b / size).otherwise(0.0)

    size_slope = F.when(F.col("cc") > 1e-12, F.col("cm") / F.col("cc")).otherwise(0.0)
    s = s.withColumns({
        "xm_": F.col("xm") - F.col("xc") * size_slope, "ym_": F.col("ym") - F.col("yc") * size_slope,
        "mm_": F.col("mm") - F.col("cm") * size_slope})

    def left_over(total, ac, bc, am, bm):
        return F.col(total) - share(F.col(ac), F.col(bc), F.col("cc")) - share(F.col(am), F.col(bm), F.col("mm_"))

    s = s.withColumns({
        "rxx": left_over("xx", "xc", "xc", "xm_", "xm_"), "ryy": left_over("yy", "yc", "yc", "ym_", "ym_"),
        "rxy": left_over("xy", "xc", "yc", "xm_", "ym_")})
    n = F.col("controlled_observations")
    enough = n >= F.greatest(F.lit(30), F.col("_k") + 2 + 10)
    return s.withColumn("controlled_ic", F.when(enough, safe_corr(n, F.col("rxy"), F.col("rxx"), F.col("ryy"))))


def factor_summary(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, months, positive share and median cross-section by factor, horizon and metric."""
    long = monthly.unpivot([*keys, "date", "observations"], ["raw_ic", "controlled_ic", "top_minus_bottom"], "metric", "v")
    return long.groupBy(*keys, "metric").agg(
        F.count("v").alias("months"), F.avg("v").alias("mean"),
        F.avg(F.when(F.col("v").isNotNull(), positive(F.col("v")))).alias("positive_fraction"),
        F.median("observations").alias("median_cross_section"))


def price_control(momentum: str, volatility: str, keys: list[str]) -> Column:
    """Price-only control score: 60 % momentum rank, 40 % low-volatility rank."""
    return 0.6 * percent_rank_average(F.col(momentum), *keys) + 0.4 * percent_rank_average(-F.col(volatility), *keys)


#: Share of the prediction's rank in the scores of the ridge family.
RIDGE_SHARE = 0.25


def rotation_scores(features: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Scores, gates and trend tests of the rotation families, one row per sleeve.

    Ranks are taken among eligible symbols of a date. ``dual`` has one sleeve,
    ``quality`` one, ``ensemble`` three with their own gate and trend window. With
    ``predictions`` (symbol, date, prediction) there is a family ``ridge``: the sleeves of
    ``ensemble``, a quarter of whose score is the prediction's rank on that date, if there is one.
    """
    ok = F.col("eligible")
    masked = {f"e{k}": F.when(ok, F.col(f"mom{k}")) for k in (21, 63, 126, 252)}
    vol = F.greatest("vol", F.lit(0.05))
    quality = (F.col("mom63") + F.col("mom126") + F.col("mom252")) / (3 * vol)
    masked.update({
        "eq": F.when(ok, quality), "ee": F.when(ok, F.col("efficiency")), "ed": F.when(ok, F.col("drawdown"))})
    scored = features.withColumns(masked)
    if predictions is not None:
        scored = scored.join(predictions.select("symbol", "date", F.col("prediction").alias("ep")), ["symbol", "date"], "left")
        masked["ep"] = F.col("ep")
    r = with_ranks(scored, list(masked), ["date"])
    slow = (F.col("mom126") + F.col("mom252")) / 2 > 0
    base = (F.col("e63_rank") + F.col("e126_rank") + F.col("e252_rank")) / 3
    mixed = 0.7 * F.col("eq_rank") + 0.15 * F.col("ee_rank") + 0.15 * F.col("ed_rank")
    sleeves = [
        ("dual", 1, base, slow, "trend200"),
        ("quality", 1, mixed, F.col("mom126") > 0, "trend120"),
        ("ensemble", 1, (F.col("e21_rank") + F.col("e63_rank")) / 2, F.col("mom63") > 0, "trend60"),
        ("ensemble", 2, (F.col("e63_rank") + F.col("e126_rank")) / 2, F.col("mom126") > 0, "trend120"),
        ("ensemble", 3, base, slow, "trend200"),
    ]
    if predictions is not None:
        sleeves += [("ridge", i, (1 - RIDGE_SHARE) * s + RIDGE_SHARE * F.coalesce("ep_rank", s), g, t) for f, i, s, g, t in sleeves if f == "ensemble"]
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(i).alias("sleeve"), s.alias("score"),
                 F.coalesce(ok & g & (F.col(t) > 0), F.lit(False)).alias("allowed"))
        for f, i, s, g, t in sleeves]))
    return r.withColumn("_s", rows).select("symbol", "date", "eligible", "vol", "trend60", "ret", "_s.*")
