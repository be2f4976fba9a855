"""Cross-section queries: ranks, scores, factor tests, selection per date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import change, divide, rolling_std
from marketframe.operators import panel as P, ridge as R, selection, xsection as X
from marketframe.operators.ranking import with_spread_ranks
from marketframe.plans.features import DEFAULT_FACTORS, LISTING, default_factors, listings
from marketframe.plans.registry import lag, part, query, roll
from marketframe.sources.market import Market, priced, traded


def rank_sql(x: str, keys: str = "date", desc: bool = False) -> str:
    """Average-tie percentile rank of rows whose value is known, by counting."""
    order = f"{x} DESC" if desc else x
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {order} NULLS LAST)"
            f" + (count({x}) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {keys}) END")


@query("x01_percentile_rank",
       """SELECT a.symbol, a.date, ((SELECT count(*) FILTER (b.v < a.v) + (count(*) FILTER (b.v = a.v) + 1) / 2.0 FROM q b WHERE b.date = a.date)) /
          (SELECT count(b.v) FROM q b WHERE b.date = a.date) AS pct FROM q a WHERE a.v IS NOT NULL""".join(
           ["WITH q AS (SELECT symbol, date, floor(volume / 5) AS v FROM brand_bars) ", ""]),
       floats="pct", dates="date")
def percentile_rank(m):
    v = m.bars("p_brand").select("symbol", "date", F.floor(F.col("volume") / 5).alias("v"))
    return with_spread_ranks(v, ["v"], ["date"]).where("v_rank IS NOT NULL").select("symbol", "date", F.col("v_rank").alias("pct"))


# A monthly research panel over suppliers: amounts as size, their change as momentum,
# two factors, the region as industry, and the coming months' growth as label.
part("supplier_months", """
SELECT s_suppkey AS symbol, CAST(date_trunc('month', date) AS DATE) AS date, r_name AS industry,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS f1,
       CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) AS f2
FROM trades JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
part("research", """
SELECT symbol, date, industry, CASE WHEN amount > 0 THEN ln(amount) END AS log_market_cap, amount / lag(amount, 1) OVER w - 1 AS momentum_raw,
       f1, f2, CASE WHEN f2 > 0.02 THEN floor(f1 / 50) END AS f3, lead(amount, 2) OVER w / lead(amount, 1) OVER w - 1 AS fwd1, lead(amount, 4) OVER w / lead(amount, 1) OVER w - 1 AS fwd3
FROM supplier_months WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
part("research_long", """
SELECT symbol, date, industry, log_market_cap, momentum_raw, horizon, factor,
       CASE factor WHEN 'f1' THEN f1 WHEN 'f2' THEN f2 WHEN 'f3' THEN f3 END AS value, CASE horizon WHEN 1 THEN fwd1 ELSE fwd3 END AS forward
FROM research, (VALUES (1), (3)) h(horizon), (VALUES ('f1'), ('f2'), ('f3')) f(factor)""")


def research_panel(m: Market) -> DataFrame:
    s = m.table("supplier").join(m.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        m.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("industry"))
    months = m.trades.groupBy(F.col("l_suppkey").alias("symbol"), F.trunc("date", "MM").alias("date")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("f1"),
        (F.sum(F.col("l_discount").cast("decimal(4,2)")).cast("double") / F.count(F.lit(1))).alias("f2"))
    a = F.col("amount")
    return months.join(s, F.col("symbol") == F.col("s_suppkey")).select(
        "symbol", "date", "industry", F.when(a > 0, F.ln(a)).alias("log_market_cap"), change(a, 1).alias("momentum_raw"),
        "f1", "f2", F.when(F.col("f2") > 0.02, F.floor(F.col("f1") / 50).cast("double")).alias("f3"),
        X.forward_label(a, 1).alias("fwd1"), X.forward_label(a, 3).alias("fwd3"))


def research_long(m: Market) -> DataFrame:
    horizons = F.explode(F.array(
        F.struct(F.lit(1).alias("horizon"), F.col("fwd1").alias("forward")), F.struct(F.lit(3).alias("horizon"), F.col("fwd3").alias("forward"))))
    keep = ["symbol", "date", "industry", "log_market_cap", "momentum_raw", "horizon", "forward"]
    panel = m.store("research", lambda: research_panel(m))  # the factor tests read it five times
    wide = panel.withColumn("_h", horizons).select(*keep[:5], "f1", "f2", "f3", "_h.*")
    return wide.unpivot(keep, ["f1", "f2", "f3"], "factor", "value")


def monthly_tests(m: Market) -> DataFrame:
    return X.factor_tests(research_long(m), ["date", "horizon", "factor"])


CONTROL = f"""SELECT date, horizon, factor, industry, {rank_sql('value', 'date, horizon, factor')} AS x, {rank_sql('forward', 'date, horizon, factor')} AS y,
    {rank_sql('log_market_cap', 'date, horizon, factor')} AS c, {rank_sql('momentum_raw', 'date, horizon, factor')} AS m
  FROM research_long WHERE value IS NOT NULL AND forward IS NOT NULL AND industry IS NOT NULL AND log_market_cap IS NOT NULL AND momentum_raw IS NOT NULL"""

K3 = "date, horizon, factor"
part("monthly_tests", f"""
SELECT r.date, r.horizon, r.factor, observations, CASE WHEN observations >= 20 AND sx >= 1e-12 AND sy >= 1e-12 THEN ic END AS raw_ic,
  CASE WHEN ok THEN t END AS top_mean, CASE WHEN ok THEN b END AS bottom_mean, CASE WHEN ok THEN t - b END AS top_minus_bottom,
  CASE WHEN observations >= 20 AND cn >= greatest(30, k + 12) THEN cic END AS controlled_ic, CASE WHEN observations >= 20 THEN coalesce(cn, 0) ELSE 0 END AS controlled_observations
FROM (SELECT *, observations >= 20 AND nt >= 3 AND nb >= 3 AND levels > 2 AS ok FROM (
    SELECT {K3}, count(*) AS observations, corr(x, y) AS ic, stddev_pop(x) AS sx, stddev_pop(y) AS sy, avg(forward) FILTER (x >= 0.8) AS t, avg(forward) FILTER (x <= 0.2) AS b,
      count(*) FILTER (x >= 0.8) AS nt, count(*) FILTER (x <= 0.2) AS nb, count(DISTINCT value) AS levels
    FROM (SELECT *, {rank_sql('value', K3)} AS x, {rank_sql('forward', K3)} AS y FROM research_long WHERE value IS NOT NULL AND forward IS NOT NULL) GROUP BY {K3})) r
LEFT JOIN (
  SELECT {K3}, count(*) AS cn, count(DISTINCT industry) AS k, corr(x - bxc * c - bxm * m, y - byc * c - bym * m) AS cic FROM (
    SELECT *, (xc * smm - xm * scm) / det AS bxc, (xm * scc - xc * scm) / det AS bxm, (yc * smm - ym * scm) / det AS byc, (ym * scc - yc * scm) / det AS bym FROM (
      SELECT *, sum(c * c) OVER g AS scc, sum(m * m) OVER g AS smm, sum(c * m) OVER g AS scm, sum(x * c) OVER g AS xc, sum(x * m) OVER g AS xm, sum(y * c) OVER g AS yc, sum(y * m) OVER g AS ym,
        nullif(sum(c * c) OVER g * sum(m * m) OVER g - pow(sum(c * m) OVER g, 2), 0) AS det
      FROM (SELECT {K3}, industry, x - avg(x) OVER i AS x, y - avg(y) OVER i AS y, c - avg(c) OVER i AS c, m - avg(m) OVER i AS m FROM ({CONTROL}) WINDOW i AS (PARTITION BY {K3}, industry))
      WINDOW g AS (PARTITION BY {K3}))) GROUP BY {K3}) q
ON r.date = q.date AND r.horizon = q.horizon AND r.factor = q.factor""")


@query("x09_quantile_spread", "SELECT date, horizon, factor, observations, raw_ic, top_mean, bottom_mean, top_minus_bottom FROM monthly_tests",
       floats="raw_ic top_mean bottom_mean top_minus_bottom", dates="date", digits=5)
def quantile_spread(m):
    return monthly_tests(m).select("date", "horizon", "factor", "observations", "raw_ic", "top_mean", "bottom_mean", "top_minus_bottom")


@query("x10_controlled_ic", "SELECT date, horizon, factor, controlled_ic, controlled_observations FROM monthly_tests",
       floats="controlled_ic", dates="date")
def controlled_ic(m):
    return monthly_tests(m).select("date", "horizon", "factor", "controlled_ic", "controlled_observations")


@query("x14_factor_summary",
       """SELECT factor, horizon, metric, count(v) AS months, avg(v) AS mean, avg((round(v, 12) > 0)::INT) FILTER (v IS NOT NULL) AS positive_fraction, median(observations) AS median_cross_section
          FROM (SELECT t.*, m.metric, CASE m.metric WHEN 'raw_ic' THEN raw_ic WHEN 'controlled_ic' THEN controlled_ic ELSE top_minus_bottom END AS v
                FROM monthly_tests t, (VALUES ('raw_ic'), ('controlled_ic'), ('top_minus_bottom')) m(metric)) GROUP BY factor, horizon, metric""",
       floats="mean positive_fraction median_cross_section")
def factor_summary(m):
    return X.factor_summary(monthly_tests(m), ["factor", "horizon"])


@query(
    "x05_rank_ic",
    f"""SELECT date, factor, corr(x, y) AS rank_ic, count(*) AS assets FROM (
        SELECT date, factor, {rank_sql('value', 'date, factor')} AS x, {rank_sql('label', 'date, factor')} AS y, value, label FROM ic_pairs)
        GROUP BY date, factor HAVING count(*) >= 4 AND count(DISTINCT value) >= 2 AND count(DISTINCT label) >= 2""".join(
        [f"""WITH ic_pairs AS (
          SELECT f.date, f.factor, f.value, l.label FROM (UNPIVOT ({DEFAULT_FACTORS}) ON momentum_60, momentum_120, trend_120, volatility_60, reversal_20 INTO NAME factor VALUE value) f
          JOIN (SELECT symbol, date, lead(open, 21) OVER w / lead(open, 1) OVER w - 1 AS label FROM brand_adjusted WINDOW w AS (PARTITION BY symbol ORDER BY date)) l USING (symbol, date)
          JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM brand_bars)) d ON d.date = f.date AND d.i % 20 = 0
          WHERE l.label IS NOT NULL) """, ""]),
    floats="rank_ic", dates="date")
def rank_ic(m):
    return default_ic(m)


def default_ic(m: Market, horizon: int = 20) -> DataFrame:
    """Rank IC of the default factors on every ``horizon``-th date, so labels do not overlap."""
    names = ["momentum_60", "momentum_120", "trend_120", "volatility_60", "reversal_20"]
    long = default_factors(m.bars("p_brand")).unpivot(["symbol", "date"], names, "factor", "value")
    labels = m.adjusted("p_brand").select("symbol", "date", X.forward_label(F.col("open"), horizon).alias("label"))
    thinned = P.number_sessions(m.bars("p_brand").select("date")).where((F.col("session_no") - 1) % horizon == 0).select("date")
    return X.rank_ic(long.join(labels, ["symbol", "date"]).join(thinned, "date"), ["date", "factor"])


@query("x06_forward_label",
       "SELECT symbol, date, lead(open, 21) OVER w / lead(open, 1) OVER w - 1 AS label20, lead(open, 61) OVER w / lead(open, 1) OVER w - 1 AS label60 FROM brand_adjusted WINDOW w AS (PARTITION BY symbol ORDER BY date)",
       floats="label20 label60", dates="date")
def forward_label(m):
    o = F.col("open")
    return m.adjusted("p_brand").select("symbol", "date", X.forward_label(o, 20).alias("label20"), X.forward_label(o, 60).alias("label60"))


@query("x07_terminal_label",
       f"""SELECT symbol, date, CASE WHEN o1 IS NOT NULL AND d1 < delisting AND delisting <= d2 THEN -1 ELSE o2 / o1 - 1 END AS label FROM (
           SELECT p.symbol, p.date, l.delisting, lead(open, 1) OVER w AS o1, lead(open, 21) OVER w AS o2, lead(p.date, 1) OVER w AS d1, lead(p.date, 21) OVER w AS d2
           FROM brand_panel p JOIN ({LISTING}) l USING (symbol) WINDOW w AS (PARTITION BY p.symbol ORDER BY p.date))""",
       floats="label", dates="date")
def terminal_label(m):
    w = Window.partitionBy("symbol").orderBy("date")
    p = m.panel("p_brand").join(listings(m), "symbol")
    o = F.col("open")
    return p.select("symbol", "date", X.terminal_label(
        X.forward_label(o, 20), F.lead(o).over(w), F.lead("date").over(w), F.lead("date", 21).over(w), F.col("delisting")).alias("label"))


@query("x08_ic_summary", """SELECT factor, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS ic_std, avg((round(rank_ic, 12) > 0)::INT) AS positive_fraction, count(*) AS observations, 20 AS horizon
       FROM (__IC__) GROUP BY factor""".replace("__IC__", f"""SELECT date, factor, corr(x, y) AS rank_ic FROM (
        SELECT date, factor, {rank_sql('value', 'date, factor')} AS x, {rank_sql('label', 'date, factor')} AS y, value, label FROM (
          SELECT f.date, f.factor, f.value, l.label FROM (UNPIVOT ({DEFAULT_FACTORS}) ON momentum_60, momentum_120, trend_120, volatility_60, reversal_20 INTO NAME factor VALUE value) f
          JOIN (SELECT symbol, date, lead(open, 21) OVER w / lead(open, 1) OVER w - 1 AS label FROM brand_adjusted WINDOW w AS (PARTITION BY symbol ORDER BY date)) l USING (symbol, date)
          JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM brand_bars)) d ON d.date = f.date AND d.i % 20 = 0
          WHERE l.label IS NOT NULL))
        GROUP BY date, factor HAVING count(*) >= 4 AND count(DISTINCT value) >= 2 AND count(DISTINCT label) >= 2"""),
       floats="mean_rank_ic ic_std positive_fraction")
def ic_summary(m):
    return X.ic_summary(default_ic(m), 20)


# --- monthly scores of brands -------------------------------------------------------

part("brand_scores", f"""
SELECT date, symbol, position, bucket, value_raw, momentum_raw, volatility FROM (
  SELECT symbol, date, close, volume / amount AS value_raw, marked / {lag('marked', 63)} - 1 AS momentum_raw, {roll('stddev_samp', 'ret', 63, 50)} AS volatility FROM brand_marked)
JOIN brand_assets USING (symbol)
WHERE close IS NOT NULL AND momentum_raw IS NOT NULL AND volatility > 0 AND date IN (SELECT min(date) FROM sessions GROUP BY date_trunc('month', date))""")


def brand_scores(m: Market) -> DataFrame:
    """Observed brands on month-first sessions with value, momentum and volatility."""
    p = P.mark_prices(m.adjusted("p_brand"))
    f = p.select("symbol", "date", "close", divide(F.col("volume"), F.col("amount")).alias("value_raw"),
                 change(F.col("marked"), 63).alias("momentum_raw"), rolling_std(F.col("ret"), 63, 50).alias("volatility"))
    usable = f.where("close IS NOT NULL AND momentum_raw IS NOT NULL AND volatility > 0")
    return (usable.join(P.month_firsts(m.sessions).select("date"), "date", "left_semi")
            .join(m.brand_assets, "symbol")
            .select("date", "symbol", "position", "bucket", "value_raw", "momentum_raw", "volatility"))


COMPOSITE = f"""SELECT date, symbol, value, momentum, low_vol, quality FROM (
  SELECT date, symbol, {rank_sql('value_raw')} AS value, {rank_sql('momentum_raw')} AS momentum, {rank_sql('volatility', desc=True)} AS low_vol,
         ({rank_sql('value_raw')} + {rank_sql('volatility', desc=True)}) / 2 AS quality FROM brand_scores)"""


def component_ranks(m: Market) -> DataFrame:
    s = X.with_ranks(brand_scores(m).withColumn("calm", -F.col("volatility")), ["value_raw", "momentum_raw", "calm"], ["date"])
    return s.withColumnsRenamed({"value_raw_rank": "value", "momentum_raw_rank": "momentum", "calm_rank": "low_vol"}).withColumn(
        "quality", (F.col("value") + F.col("low_vol")) / 2)


@query("x02_composite_families",
       f"""SELECT date, symbol, 0.4 * value + 0.4 * quality + 0.2 * low_vol AS quality_value, 0.5 * momentum + 0.3 * low_vol + 0.2 * quality AS momentum_defensive,
           0.25 * (value + quality + momentum + low_vol) AS ensemble FROM ({COMPOSITE})""",
       floats="quality_value momentum_defensive ensemble", dates="date")
def composite_families(m):
    return X.composite(component_ranks(m)).select("date", "symbol", *X.FAMILIES)


@query("x15_price_control",
       f"SELECT date, symbol, 0.6 * {rank_sql('momentum_raw')} + 0.4 * {rank_sql('volatility', desc=True)} AS matched_price_control FROM brand_scores",
       floats="matched_price_control", dates="date")
def price_control(m):
    return brand_scores(m).select("date", "symbol", X.price_control("momentum_raw", "volatility", ["date"]).alias("matched_price_control"))


def features_sql(marked: str, seen: int) -> str:
    """Rotation features on filled marks."""
    return f"""
SELECT symbol, date, session_no, ret, marked, vol, downside, mom21, mom63, mom126, mom252, trend60, trend120, trend200, efficiency, drawdown,
  (close IS NOT NULL AND seen >= {seen} AND coalesce(a20 >= 10000, false) AND coalesce(volume > 0, false) AND vol IS NOT NULL) AS eligible, open
FROM (SELECT *, ({roll('stddev_samp', 'ret', 60)}) * sqrt(252) AS vol, sqrt({roll('avg', 'loss2', 60)}) * sqrt(252) AS downside,
    marked / {lag('marked', 21)} - 1 AS mom21, marked / {lag('marked', 63)} - 1 AS mom63, marked / {lag('marked', 126)} - 1 AS mom126, marked / {lag('marked', 252)} - 1 AS mom252,
    marked / ({roll('avg', 'marked', 60)}) - 1 AS trend60, marked / ({roll('avg', 'marked', 120)}) - 1 AS trend120, marked / ({roll('avg', 'marked', 200)}) - 1 AS trend200,
    abs(marked - {lag('marked', 63)}) / ({roll('sum', 'move', 63)}) AS efficiency, marked / ({roll('max', 'marked', 126)}) - 1 AS drawdown,
    count(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS seen, {roll('avg', 'amount', 20)} AS a20
  FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0), 2) END AS loss2 FROM {marked}))"""


RIDGE_X = ["mom21 / v", "mom63 / v", "mom126 / v", "mom252 / v", "trend120 / v", "efficiency", "drawdown / v", "downside / v"]


def ridge_parts(name: str, features: str) -> None:
    """Parts ``{name}_samples``, ``_rows``, ``_moments``, ``_system``, ``_beta`` and ``_predictions``: a ridge fit a month, solved by elimination."""
    n = len(RIDGE_X)
    known = " AND ".join(f"({x}) IS NOT NULL" for x in RIDGE_X)
    part(f"{name}_samples", f"""
SELECT symbol, date, session_no - 1 AS i, eligible AND {known} AS valid, (after / entry - 1) / v AS y, [{", ".join(RIDGE_X)}] AS x
FROM (SELECT *, greatest(vol, 0.05) AS v, lead(open, 22) OVER w AS after, lead(open, 1) OVER w AS entry FROM {features} WINDOW w AS (PARTITION BY symbol ORDER BY date))""")
    part(f"{name}_rows", f"""
SELECT c.date AS fit_date, s.x, greatest(-1, least(1, s.y)) AS y FROM cutoffs c JOIN {name}_samples s
ON s.valid AND s.y IS NOT NULL AND s.i % 21 = 0 AND s.i >= greatest(0, c.session_no - 1 - 756) AND s.i < greatest(0, c.session_no - 1 - 21)""")
    part(f"{name}_moments", f"""
SELECT fit_date, [{", ".join(f"avg(x[{k}])" for k in range(1, n + 1))}] AS m, [{", ".join(f"greatest(stddev_pop(x[{k}]), 0.05)" for k in range(1, n + 1))}] AS s
FROM {name}_rows GROUP BY fit_date HAVING count(*) >= 150""")
    scored = ", ".join(f"greatest(-5, least(5, (x[{k}] - m[{k}]) / s[{k}]))" for k in range(1, n + 1))
    gram = ", ".join("[" + ", ".join(
        f"sum(z[{a}] * z[{b}])" + (" + 10" if a == b > 1 else "") for b in range(1, n + 2)) + f", sum(z[{a}] * y)]" for a in range(1, n + 2))
    part(f"{name}_system", f"""
SELECT fit_date, [{gram}] AS g FROM (SELECT fit_date, y, [1.0::DOUBLE, {scored}] AS z FROM {name}_rows JOIN {name}_moments USING (fit_date)) GROUP BY fit_date""")
    part(f"{name}_beta", f"""
SELECT fit_date, list_transform(g, lambda row: row[{n + 2}]) AS beta FROM (
  WITH RECURSIVE solved AS (SELECT fit_date, 1 AS k, g FROM {name}_system UNION ALL
    SELECT fit_date, k + 1, list_transform(g, lambda row, i: list_transform(row, lambda v, j: CASE WHEN i = k THEN v / g[k][k] ELSE v - row[k] * g[k][j] / g[k][k] END)) FROM solved WHERE k <= {n + 1})
  SELECT fit_date, g FROM solved WHERE k = {n + 2})""")
    total = " + ".join(["beta[1]", *[f"beta[{k + 1}] * greatest(-5, least(5, (x[{k}] - m[{k}]) / s[{k}]))" for k in range(1, n + 1)]])
    part(f"{name}_predictions", f"""
SELECT d.date, d.symbol, {total} AS prediction FROM {name}_samples d JOIN {name}_moments f ON date_trunc('month', d.date) = date_trunc('month', f.fit_date)
JOIN {name}_beta b ON b.fit_date = f.fit_date WHERE d.valid""")


RIDGE_GROUPS = ("p_type", "o_orderpriority", "l_returnflag", "o_orderstatus")
for _k in RIDGE_GROUPS[1:]:
    part(f"{_k}_bars", f"""
SELECT symbol, date, (low + high) / 2 AS open, amount / volume AS close, volume, amount,
       1 + 0.05 * floor((date_diff('day', DATE '1995-01-01', date) + 30 * length(symbol)) / 365.0) AS adj_factor
FROM (SELECT {_k} AS symbol, date, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume
      FROM trades GROUP BY ALL)""")
part("wide_bars", "SELECT symbol, date, open, close, volume, amount, adj_factor FROM type_bars UNION ALL " + " UNION ALL ".join(
    f"SELECT * FROM {_k}_bars" for _k in RIDGE_GROUPS[1:]))
part("wide_marked", """
SELECT *, marked / lag(marked) OVER w - 1 AS ret, abs(marked - lag(marked) OVER w) AS move FROM (
  SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS marked FROM (
    SELECT g.symbol, g.date, g.session_no, b.open * b.adj_factor / f.f0 AS open, b.close * b.adj_factor / f.f0 AS close, b.volume, b.amount
    FROM (SELECT symbol, date, session_no FROM (SELECT DISTINCT symbol FROM wide_bars), sessions) g
    JOIN (SELECT symbol, arg_min(adj_factor, date) AS f0 FROM wide_bars GROUP BY symbol) f USING (symbol)
    LEFT JOIN wide_bars b ON b.symbol = g.symbol AND b.date = g.date)) WINDOW w AS (PARTITION BY symbol ORDER BY date)""")


part("wide_features", features_sql("wide_marked", 60))
ridge_parts("wide", "wide_features")

ROTATION = f"""
  SELECT symbol, date, eligible, vol, trend60, ret, family, sleeve, CASE WHEN family = 'ridge' THEN 0.75 * score + 0.25 * coalesce(rp, score) ELSE score END AS score,
    coalesce(eligible AND gate AND trend > 0, false) AS allowed FROM (
    SELECT symbol, date, eligible, vol, trend60, ret, s.family, s.sleeve, rp,
      CASE s.kind WHEN 'base' THEN (r63 + r126 + r252) / 3 WHEN 'quality' THEN 0.7 * rq + 0.15 * re + 0.15 * rd WHEN 'fast' THEN (r21 + r63) / 2 ELSE (r63 + r126) / 2 END AS score,
      CASE s.gate WHEN 'slow' THEN (mom126 + mom252) / 2 > 0 WHEN 'm126' THEN mom126 > 0 ELSE mom63 > 0 END AS gate,
      CASE s.trend WHEN 60 THEN trend60 WHEN 120 THEN trend120 ELSE trend200 END AS trend
    FROM (SELECT *, {rank_sql('e21')} AS r21, {rank_sql('e63')} AS r63, {rank_sql('e126')} AS r126, {rank_sql('e252')} AS r252, {rank_sql('eq')} AS rq, {rank_sql('ee')} AS re, {rank_sql('ed')} AS rd, {rank_sql('prediction')} AS rp
      FROM (SELECT *, CASE WHEN eligible THEN mom21 END AS e21, CASE WHEN eligible THEN mom63 END AS e63, CASE WHEN eligible THEN mom126 END AS e126, CASE WHEN eligible THEN mom252 END AS e252,
          CASE WHEN eligible THEN (mom63 + mom126 + mom252) / (3 * greatest(vol, 0.05)) END AS eq, CASE WHEN eligible THEN efficiency END AS ee, CASE WHEN eligible THEN drawdown END AS ed
        FROM rotation_features LEFT JOIN wide_predictions USING (symbol, date))),
      (VALUES ('dual', 1, 'base', 'slow', 200), ('quality', 1, 'quality', 'm126', 120), ('ensemble', 1, 'fast', 'm63', 60), ('ensemble', 2, 'mid', 'm126', 120), ('ensemble', 3, 'base', 'slow', 200),
              ('ridge', 1, 'fast', 'm63', 60), ('ridge', 2, 'mid', 'm126', 120), ('ridge', 3, 'base', 'slow', 200)) s(family, sleeve, kind, gate, trend))"""

part("rotation_features", features_sql("type_marked", 253))
part("rotation_scores", ROTATION)


def rotation_features(m: Market) -> DataFrame:
    return m._once("rotation", lambda: P.rotation_features(m.adjusted("p_type"), 253, 10000))


def wide_adjusted(m: Market) -> DataFrame:
    """Seventeen dense symbols: part types, order priorities, return flags and order states, from one pass over the trades."""
    def build():
        every = m.trades.withColumn("symbol", F.explode(F.array(*RIDGE_GROUPS)))
        return P.complete_panel(P.rebase_to_first_factor(priced(every.groupBy("symbol", "date").agg(*traded()))), m.sessions)

    return m._once("wide_adjusted", build)


def ridge_fits(m: Market) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples of every asset, the training rows of every monthly fit, and their moments."""
    samples = R.ridge_samples(P.rotation_features(wide_adjusted(m), 60, 10000))
    rows = R.training_rows(samples, R.fit_dates(P.month_firsts(m.sessions)), m.sessions)
    return samples, rows, R.fit_moments(rows)


def ridge_predictions(m: Market) -> DataFrame:
    samples, rows, moments = ridge_fits(m)
    return R.ridge_predictions(samples, R.fit_ridge(rows, moments))


def rotation_family_scores(m: Market) -> DataFrame:
    """Scores of all families; ``ridge`` blends in the predictions of the monthly fits."""
    return X.rotation_scores(rotation_features(m), ridge_predictions(m))


@query("x04_rotation_scores", "SELECT symbol, date, family, sleeve, score, allowed::INT AS allowed FROM rotation_scores WHERE score IS NOT NULL",
       floats="score", dates="date")
def rotation_scores(m):
    s = rotation_family_scores(m).where("score IS NOT NULL")
    return s.select("symbol", "date", "family", "sleeve", "score", F.col("allowed").cast("int").alias("allowed"))


@query("x11_running_totals",
       """SELECT symbol, date, sum(CAST(volume AS DECIMAL(18,2))) OVER w ::DOUBLE AS volume_so_far, max(close) OVER w AS highest, count(*) OVER w AS bars
          FROM brand_bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)""",
       floats="volume_so_far highest", dates="date", digits=4)
def running_totals(m):
    from marketframe.functions.timeseries import running

    v = F.col("volume").cast("decimal(18,2)")
    return m.bars("p_brand").select("symbol", "date", running(F.sum, v).cast("double").alias("volume_so_far"),
                                    running(F.max, F.col("close")).alias("highest"), running(F.count, F.col("close")).alias("bars"))


# --- selection per date ----------------------------------------------------------------


@query("o01_stable_order",
       "SELECT symbol, date, row_number() OVER (ORDER BY date, amount DESC, symbol) AS place FROM type_bars",
       dates="date")
def stable_order(m):
    """A total order needs an explicit last key; the date keys the work, not one global sort."""
    b = m.bars("p_type").select("symbol", "date", "amount")
    w = Window.partitionBy("date").orderBy(F.desc("amount"), "symbol")
    inside = b.withColumn("_i", F.row_number().over(w))
    before = b.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(before, "date").select("symbol", "date", (F.col("_i") + F.col("_before")).alias("place"))


@query("o02_top_all_or_nothing",
       "SELECT date, symbol, rank FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY momentum_raw DESC, symbol) AS rank, count(*) OVER (PARTITION BY date) AS n FROM brand_scores) WHERE n >= 8 AND rank <= 8",
       dates="date")
def top_all_or_nothing(m):
    return selection.top_n(brand_scores(m), "momentum_raw", 8, ["date"], ["symbol"], all_or_nothing=True).select("date", "symbol", "rank")


@query("o03_top_with_group_cap",
       """WITH RECURSIVE ranked AS MATERIALIZED (
            SELECT date, symbol, bucket, row_number() OVER (PARTITION BY date ORDER BY momentum_raw DESC, symbol) AS pos FROM brand_scores
            WHERE date IN (SELECT date FROM brand_scores GROUP BY date HAVING count(DISTINCT momentum_raw) >= 3)),
          walk AS (SELECT date, 1::BIGINT AS pos, [symbol] AS picked, [bucket] AS used FROM ranked WHERE pos = 1
            UNION ALL SELECT r.date, r.pos, CASE WHEN ok THEN list_append(w.picked, r.symbol) ELSE w.picked END, CASE WHEN ok THEN list_append(w.used, r.bucket) ELSE w.used END
            FROM (SELECT r.*, w.picked, w.used, len(list_filter(w.used, lambda b: b = r.bucket)) < 2 AND len(w.picked) < 6 AS ok FROM walk w JOIN ranked r ON r.date = w.date AND r.pos = w.pos + 1) r, (SELECT 1) one
              JOIN LATERAL (SELECT r.picked, r.used) w ON true)
          SELECT date, symbol, rank FROM (SELECT date, unnest(picked) AS symbol, generate_subscripts(picked, 1) AS rank FROM (
            SELECT date, arg_max(picked, pos) AS picked FROM walk GROUP BY date))""",
       dates="date")
def top_with_group_cap(m):
    return selection.top_n_capped(brand_scores(m), "momentum_raw", "bucket", 2, 6, ["date"], ["symbol"], min_distinct=3).select(
        "date", "symbol", F.col("rank").cast("bigint").alias("rank"))


@query("o04_representatives",
       """SELECT date, symbol FROM (SELECT *, row_number() OVER (PARTITION BY date, bucket ORDER BY incumbent DESC, momentum_raw DESC, value_raw DESC, symbol) AS g FROM (
            SELECT *, row_number() OVER (PARTITION BY date, theme ORDER BY incumbent DESC, value_raw DESC, symbol) AS i FROM (
              SELECT *, floor((position + 1) / 2)::INT AS theme, symbol IN ('Brand#4', 'Brand#11') AS incumbent FROM brand_scores)) WHERE i = 1) WHERE g = 1""",
       dates="date")
def representatives(m):
    s = brand_scores(m).withColumns({
        "theme": F.floor((F.col("position") + 1) / 2), "incumbent": F.col("symbol").isin("Brand#4", "Brand#11")})
    return selection.representatives(s, ["date"], "theme", "bucket", "value_raw", "momentum_raw", "incumbent", ["symbol"]).select("date", "symbol")


@query("o09_best_per_class",
       """SELECT date, symbol, least(0.30, 0.15 / count(*) OVER (PARTITION BY date, bucket)) AS weight FROM (
          SELECT date, symbol, bucket, row_number() OVER (PARTITION BY date, bucket ORDER BY momentum_raw / greatest(volatility, 0.08) DESC, position) AS k FROM brand_scores) WHERE k <= 2""",
       floats="weight", dates="date")
def best_per_class(m):
    s = brand_scores(m).withColumn("score", F.col("momentum_raw") / F.greatest("volatility", F.lit(0.08)))
    best = selection.top_n(s, "score", 2, ["date", "bucket"], ["position"])
    n = F.count(F.lit(1)).over(Window.partitionBy("date", "bucket"))
    return best.select("date", "symbol", F.least(F.lit(0.30), 0.15 / n).alias("weight"))


@query("o10_preview", "SELECT symbol, date, close FROM brand_bars ORDER BY date, symbol LIMIT 20", floats="close", dates="date", digits=4)
def preview(m):
    return m.bars("p_brand").select("symbol", "date", "close").orderBy("date", "symbol").limit(20)
