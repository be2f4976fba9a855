"""Performance tables, bootstrap intervals, and selection among candidate curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.operators import bootstrap, expressions, metrics, selection, xsection as X
from marketframe.operators.panel import number_sessions, rebase_to_first_factor
from marketframe.plans.crosssection import rank_sql
from marketframe.plans.registry import part, query
from marketframe.sources.market import Market

STATS = ("total_return cagr volatility sharpe sortino max_drawdown current_drawdown calmar worst_day best_day cvar_95")
WINDOWS = [("crash", "1996-06-01", "1996-09-30"), ("training", "1995-01-01", "1998-12-31"), ("review", "1999-01-01", None)]


def perf_sql(source: str, keys: str, rf: float = 0.02) -> str:
    free = (1 + rf) ** (1 / 252) - 1
    k = ", ".join(keys.split())
    return f"""
  SELECT {k}, CASE WHEN n >= 3 THEN nr ELSE n END AS observations, CASE WHEN n >= 3 THEN a END AS first_date, CASE WHEN n >= 3 THEN b END AS last_date,
    CASE WHEN n >= 3 THEN l / f - 1 END AS total_return, CASE WHEN n >= 3 THEN cg END AS cagr, CASE WHEN n >= 3 THEN vol END AS volatility,
    CASE WHEN n >= 3 AND vol > 1e-12 THEN me * 252 / vol END AS sharpe, CASE WHEN n >= 3 AND dn > 1e-12 THEN me * 252 / dn END AS sortino,
    CASE WHEN n >= 3 THEN mdd END AS max_drawdown, CASE WHEN n >= 3 THEN cdd END AS current_drawdown,
    CASE WHEN n >= 3 THEN (SELECT max(c) FROM (SELECT count(*) FILTER (u.dd < -1e-10) AS c FROM under u WHERE {' AND '.join(f'u.{x} = z.{x}' for x in keys.split())} GROUP BY u.island)) END AS max_underwater_sessions,
    CASE WHEN n >= 3 AND mdd < 0 THEN cg / abs(mdd) END AS calmar, CASE WHEN n >= 3 THEN wd END AS worst_day, CASE WHEN n >= 3 THEN bd END AS best_day,
    CASE WHEN n >= 3 THEN (SELECT avg(u.r) FROM under u WHERE {' AND '.join(f'u.{x} = z.{x}' for x in keys.split())} AND u.r <= z.q05) END AS cvar_95
  FROM (SELECT *, pow(l / f, 365.25 / greatest(b - a, 1)) - 1 AS cg, sd * sqrt(252) AS vol, dw * sqrt(252) AS dn FROM (
    SELECT {k}, count(*) AS n, count(r) AS nr, min(date) AS a, max(date) AS b, arg_min(equity, date) AS f, arg_max(equity, date) AS l, stddev_samp(r) AS sd,
      avg(r - {free!r}) AS me, sqrt(avg(pow(least(r - {free!r}, 0), 2)) FILTER (r IS NOT NULL)) AS dw, min(dd) AS mdd, arg_max(dd, date) AS cdd,
      min(r) AS wd, max(r) AS bd, quantile_cont(r, 0.05) AS q05 FROM under GROUP BY {k})) z"""


def under_sql(source: str, keys: str) -> str:
    k = ", ".join(keys.split())
    return f"""SELECT *, sum((dd >= -1e-10)::INT) OVER (PARTITION BY {k} ORDER BY date) AS island FROM (
      SELECT {k}, date, equity, equity / lag(equity) OVER (PARTITION BY {k} ORDER BY date) - 1 AS r,
             equity / max(equity) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM ({source}))"""


def stats_sql(source: str, keys: str) -> str:
    return f"WITH under AS ({under_sql(source, keys)}) {perf_sql(source, keys)}"


def windows_sql(windows) -> str:
    rows = ", ".join(f"('{n}', DATE '{a}', {f'DATE {b!r}' if b else 'DATE ' + repr('9999-12-31')})" for n, a, b in windows)
    return f"""SELECT n.strategy_id, w.period, n.date, n.equity FROM
      (SELECT *, lead(date) OVER (PARTITION BY strategy_id ORDER BY date) AS nxt FROM nav) n
      JOIN (VALUES {rows}) w(period, a, b)
      ON (n.date BETWEEN w.a AND w.b) OR (n.date < w.a AND n.nxt BETWEEN w.a AND w.b)"""


YEARS = """SELECT n.strategy_id, y.year, n.date, n.equity FROM (SELECT *, lead(date) OVER (PARTITION BY strategy_id ORDER BY date) AS nxt FROM nav) n
  JOIN (SELECT DISTINCT year(date) AS year FROM nav) y ON y.year = year(n.date) OR y.year = year(n.nxt)"""

part("year_stats", stats_sql(YEARS, "strategy_id year"))
part("window_stats", stats_sql(windows_sql(WINDOWS), "strategy_id period"))


@query("m01_m05_performance", stats_sql("nav", "strategy_id"), floats=STATS, dates="first_date last_date", digits=5)
def performance(m):
    """Return, CAGR, volatility, Sharpe, Sortino, drawdowns, underwater run, tails."""
    return metrics.performance(m.nav(), ["strategy_id"])


@query("m06_window_performance", "SELECT * FROM window_stats", floats=STATS, dates="first_date last_date", digits=5)
def window_performance(m):
    return metrics.window_performance(m.nav(), WINDOWS)


@query("m07_yearly", "SELECT * REPLACE (year::INT AS year) FROM year_stats", floats=STATS, dates="first_date last_date", digits=5)
def yearly(m):
    return metrics.yearly(m.nav())


@query("j17_named_windows",
       f"SELECT strategy_id, period, count(*) AS n, min(date) AS first, max(date) AS last FROM ({windows_sql(WINDOWS)}) GROUP BY ALL",
       dates="first last")
def named_windows(m):
    return metrics.in_windows(m.nav(), WINDOWS).groupBy("strategy_id", "period").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("m10_drawdown_curve",
       """SELECT strategy_id, date, equity / max(equity) OVER (PARTITION BY strategy_id ORDER BY date) - 1 AS drawdown,
          equity / first_value(equity) OVER (PARTITION BY strategy_id ORDER BY date) AS curve FROM nav""",
       floats="drawdown curve", dates="date")
def drawdown_curve(m):
    return metrics.drawdown_curve(m.nav(), ["strategy_id"]).select("strategy_id", "date", "drawdown", "curve")


@query("m11_weighted_history",
       """SELECT 'fixed' AS strategy_id, stddev_samp(ret) * sqrt(252) AS annual_vol, count(*) AS sessions, sum(ret) AS total FROM (
          SELECT date, sum(weight * ret) AS ret FROM type_marked JOIN type_assets USING (symbol) GROUP BY date) WHERE ret IS NOT NULL""",
       floats="annual_vol total", digits=4)
def weighted_history(m):
    from marketframe.operators.panel import mark_prices

    w = m.type_assets.select(F.lit("fixed").alias("strategy_id"), "symbol", "weight")
    r = mark_prices(m.adjusted("p_type")).select("symbol", "date", "ret")
    return metrics.weighted_returns(w, r, ["strategy_id"]).where("ret IS NOT NULL").groupBy("strategy_id").agg(
        (F.stddev_samp("ret") * 252**0.5).alias("annual_vol"), F.count(F.lit(1)).alias("sessions"), F.sum("ret").alias("total"))


# --- bootstrap ---------------------------------------------------------------------

def draws_sql(source: str, key: str, block: int, resamples: int, seed: int) -> str:
    """Every value of every resample, spelled out."""
    h = f"((k * 7919 + b * 104729 + {seed}) % 2147483647)"
    h = f"(({h} * 48271) % 2147483647)"
    h = f"(({h} * 48271) % 2147483647)"
    return f"""SELECT d.{key}, d.k, v.* EXCLUDE ({key}, p, n) FROM (
        SELECT {key}, k, ({h} % n + o) % n AS p FROM (SELECT {key}, count(*) AS n FROM ({source}) GROUP BY {key}),
          (SELECT unnest(range({resamples})) AS k), (SELECT unnest(range(1000)) AS b), (SELECT unnest(range({block})) AS o)
        WHERE b * {block} + o < n) d
      JOIN (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) - 1 AS p, 0 AS n FROM ({source})) v ON v.{key} = d.{key} AND v.p = d.p"""


NAV_RETURNS = """SELECT strategy_id, date, ret FROM (SELECT strategy_id, date, equity / lag(equity) OVER (PARTITION BY strategy_id ORDER BY date) - 1 AS ret FROM nav) WHERE ret IS NOT NULL"""
FREE = repr(1.02 ** (1 / 252) - 1)


@query("b01_sharpe_interval",
       f"""SELECT strategy_id, quantile_cont(s, 0.025) AS lower_95, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.975) AS upper_95 FROM (
           SELECT strategy_id, k, (avg(ret) - {FREE}) / stddev_samp(ret) * sqrt(252) AS s FROM ({draws_sql(NAV_RETURNS, 'strategy_id', 20, 500, 1729)}) GROUP BY strategy_id, k)
           GROUP BY strategy_id""", floats="lower_95 median upper_95")
def sharpe_interval(m):
    r = metrics.drawdown_curve(m.nav(), ["strategy_id"])
    return bootstrap.bootstrap_sharpe(r, ["strategy_id"])


PAIR = f"""SELECT a.strategy_id, a.date, a.ret AS ra, b.ret AS rb FROM (
  SELECT strategy_id, date, ea / lag(ea) OVER w - 1 AS ret, eb / lag(eb) OVER w - 1 AS rb FROM (
    SELECT x.strategy_id, x.date, x.equity AS ea, y.equity AS eb FROM nav x JOIN nav y ON y.strategy_id = 'STANDARD' AND x.date = y.date AND x.strategy_id <> 'STANDARD')
  WINDOW w AS (PARTITION BY strategy_id ORDER BY date)) a JOIN LATERAL (SELECT a.rb AS ret) b ON true WHERE a.ret IS NOT NULL"""


@query("b02_paired_sharpe_interval",
       f"""SELECT strategy_id, quantile_cont(s, 0.025) AS lower_95, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.975) AS upper_95 FROM (
           SELECT strategy_id, k, ((avg(ra) - {FREE}) / stddev_samp(ra) - (avg(rb) - {FREE}) / stddev_samp(rb)) * sqrt(252) AS s
           FROM ({draws_sql(PAIR, 'strategy_id', 20, 500, 8192)}) GROUP BY strategy_id, k) GROUP BY strategy_id""",
       floats="lower_95 median upper_95")
def paired_sharpe_interval(m):
    """Candidate minus baseline on their common dates, the same blocks for both."""
    nav = m.nav()
    base = nav.where("strategy_id = 'STANDARD'").select("date", F.col("equity").alias("eb"))
    both = nav.where("strategy_id <> 'STANDARD'").join(base, "date")
    w = Window.partitionBy("strategy_id").orderBy("date")
    pairs = both.withColumns({"ra": F.col("equity") / F.lag("equity").over(w) - 1, "rb": F.col("eb") / F.lag("eb").over(w) - 1})
    return bootstrap.paired_sharpe(pairs, ["strategy_id"])


MONTHLY = """SELECT symbol, date, CASE WHEN n >= 20 THEN v END AS v FROM (
  SELECT symbol, date_trunc('month', date) AS date, count(*) AS n, CAST(sum(CAST(volume AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM brand_bars GROUP BY ALL)"""


@query("b03_block_mean_interval",
       f"""SELECT symbol, quantile_cont(s, 0.025) AS lower_95, quantile_cont(s, 0.975) AS upper_95 FROM (
           SELECT symbol, k, avg(v) AS s FROM ({draws_sql(MONTHLY, 'symbol', 3, 1000, 2031)}) GROUP BY symbol, k)
           WHERE symbol IN (SELECT symbol FROM ({MONTHLY}) GROUP BY symbol HAVING count(v) >= 24) GROUP BY symbol""",
       floats="lower_95 upper_95")
def block_mean_interval(m):
    """Monthly mean volumes; thin months keep their slot but carry no value."""
    monthly = m.bars("p_brand").groupBy("symbol", F.trunc("date", "MM").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("volume").cast("decimal(18,2)")).cast("double").alias("v"))
    series = monthly.select("symbol", "date", F.when(F.col("n") >= 20, F.col("v") / F.col("n")).alias("v"))
    return bootstrap.block_mean(series, ["symbol"], "v", 3)


# --- selection among candidates ------------------------------------------------------


@query("a14_period_table",
       """SELECT strategy_id, min(total_return) AS worst_year, max(total_return) AS best_year, arg_min(year, total_return)::INT AS worst, arg_max(year, total_return)::INT AS best,
          count(*) AS years FROM year_stats GROUP BY strategy_id""", floats="worst_year best_year")
def period_table(m):
    y = metrics.yearly(m.nav())
    return y.groupBy("strategy_id").agg(
        F.min("total_return").alias("worst_year"), F.max("total_return").alias("best_year"),
        F.min_by("year", "total_return").alias("worst"), F.max_by("year", "total_return").alias("best"), F.count(F.lit(1)).alias("years"))


@query("a15_year_cross_tab",
       "PIVOT (SELECT year::INT AS year, strategy_id, total_return FROM year_stats) ON strategy_id IN ('ECONOMY', 'LARGE', 'PROMO') USING first(total_return) GROUP BY year",
       floats="ECONOMY LARGE PROMO")
def year_cross_tab(m):
    y = metrics.yearly(m.nav()).select("year", "strategy_id", "total_return")
    return y.groupBy("year").pivot("strategy_id", ["ECONOMY", "LARGE", "PROMO"]).agg(F.first("total_return"))


SCORED = """SELECT s.strategy_id, coalesce(observations >= 500 AND max_drawdown >= -0.60 AND worst >= -0.55, false) AS passed,
  coalesce(sharpe, -99) + 0.25 * least(3, coalesce(calmar, -99)) AS score
  FROM window_stats s JOIN (SELECT strategy_id, min(total_return) AS worst FROM year_stats WHERE year < 1999 GROUP BY strategy_id) y USING (strategy_id) WHERE period = 'training'"""


def scored_candidates(m: Market) -> DataFrame:
    stats = metrics.window_performance(m.nav(), WINDOWS[1:2])
    worst = metrics.yearly(m.nav()).where("year < 1999").groupBy("strategy_id").agg(F.min("total_return").alias("worst_year"))
    return selection.score_candidates(stats.join(worst, "strategy_id"), min_observations=500, max_drawdown=0.60, worst_year=-0.55)


@query("o06_best_candidate",
       f"""SELECT coalesce((SELECT arg_max(strategy_id, score) FROM ({SCORED}) WHERE passed), 'STANDARD') AS chosen, count(*) FILTER (passed) AS passing, max(score) AS top FROM ({SCORED})""",
       floats="top")
def best_candidate(m):
    return selection.choose(scored_candidates(m), "STANDARD")


@query("o07_acceptance_gates",
       """SELECT c.strategy_id, (c.cagr > b.cagr)::INT AS better_return, (c.sharpe >= b.sharpe + 0.05)::INT AS better_sharpe,
          (c.max_drawdown >= b.max_drawdown - 0.02)::INT AS bounded_drawdown, (c.cagr > b.cagr AND c.sharpe >= b.sharpe + 0.05 AND c.max_drawdown >= b.max_drawdown - 0.02)::INT AS accepted
          FROM window_stats c JOIN window_stats b ON b.strategy_id = 'STANDARD' AND b.period = 'training' WHERE c.period = 'training' AND c.strategy_id <> 'STANDARD'""")
def acceptance_gates(m):
    s = metrics.window_performance(m.nav(), WINDOWS[1:2])
    return selection.acceptance(s, "STANDARD", sharpe_gain=0.05, drawdown_slack=0.02)


@query("j18_walk_forward",
       """SELECT n.date, coalesce(w.chosen, 'STANDARD') AS strategy_id, n.equity FROM nav n LEFT JOIN (
            SELECT year + 1 AS year, arg_max(strategy_id, sharpe) AS chosen FROM year_stats WHERE total_return > 0 GROUP BY year) w ON w.year = year(n.date)
          WHERE n.strategy_id = coalesce(w.chosen, 'STANDARD')""",
       floats="equity", dates="date", digits=2)
def walk_forward(m):
    """Each year follows the candidate with the best Sharpe ratio of the year before."""
    best = metrics.yearly(m.nav()).where("total_return > 0").groupBy((F.col("year") + 1).alias("year")).agg(
        F.max_by("strategy_id", "sharpe").alias("chosen"))
    return selection.stitch_by_year(m.nav(), best, "STANDARD").select("date", "strategy_id", "equity")


@query("o08_latest_slice",
       "SELECT strategy_id, max(date) AS date, arg_max(equity, date) AS equity FROM nav GROUP BY strategy_id",
       floats="equity", dates="date", digits=2)
def latest_slice(m):
    return selection.latest(m.nav(), ["strategy_id"], "date").select("strategy_id", "date", "equity")


@query("j22_full_outer_curves",
       """SELECT coalesce(a.date, b.date) AS date, a.equity AS economy, b.equity AS promo FROM (SELECT * FROM nav WHERE strategy_id = 'ECONOMY') a
          FULL JOIN (SELECT * FROM nav WHERE strategy_id = 'PROMO') b ON a.date = b.date""",
       floats="economy promo", dates="date", digits=2)
def full_outer_curves(m):
    a = m.nav().where("strategy_id = 'ECONOMY'").select("date", F.col("equity").alias("economy"))
    b = m.nav().where("strategy_id = 'PROMO'").select("date", F.col("equity").alias("promo"))
    return a.join(b, "date", "full_outer")


_own = "OVER (PARTITION BY symbol ORDER BY date)"
_last20 = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
#: Factors as a user writes them.
USER_FACTORS = {
    "momentum": f"close / lag(close, 20) {_own} - 1",
    "place_in_range": f"(close - min(low) {_last20}) / nullif(max(high) {_last20} - min(low) {_last20}, 0)",
}
part("rebased_bars", """
SELECT b.symbol, b.date, b.open * b.adj_factor / f0 AS open, b.high * b.adj_factor / f0 AS high, b.low * b.adj_factor / f0 AS low, b.close * b.adj_factor / f0 AS close
FROM brand_bars b JOIN (SELECT symbol, arg_min(adj_factor, date) AS f0 FROM brand_bars GROUP BY symbol) f USING (symbol)""")
part("user_factors", " UNION ALL ".join(f"SELECT symbol, date, '{n}' AS factor, {t} AS value FROM rebased_bars" for n, t in USER_FACTORS.items()))
part("user_ic", f"""
SELECT date, factor, corr(x, y) AS rank_ic, count(*) AS assets FROM (
  SELECT date, factor, value, label, {rank_sql('value', 'date, factor')} AS x, {rank_sql('label', 'date, factor')} AS y FROM (
    SELECT f.*, l.label FROM user_factors f
    JOIN (SELECT symbol, date, lead(open, 21) OVER w / lead(open, 1) OVER w - 1 AS label FROM brand_adjusted WINDOW w AS (PARTITION BY symbol ORDER BY date)) l USING (symbol, date)
    JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM brand_bars)) d ON d.date = f.date AND d.i % 20 = 0
    WHERE f.value IS NOT NULL AND l.label IS NOT NULL))
GROUP BY date, factor HAVING count(*) >= 4 AND count(DISTINCT value) >= 2 AND count(DISTINCT label) >= 2""")


def user_factors(m: Market) -> DataFrame:
    return expressions.user_factors(rebase_to_first_factor(m.bars("p_brand")), USER_FACTORS)


@query("v01_user_expression", "SELECT symbol, date, value AS user_factor FROM user_factors WHERE factor = 'momentum'", floats="user_factor", dates="date")
def user_expression(m):
    """A user factor is a Spark SQL expression over the symbol's own rows."""
    return user_factors(m).where("factor = 'momentum'").select("symbol", "date", F.col("value").alias("user_factor"))


def user_rank_ic(m: Market) -> DataFrame:
    """Rank IC of the user's factors on every 20th date, so labels do not overlap."""
    labels = m.adjusted("p_brand").select("symbol", "date", X.forward_label(F.col("open"), 20).alias("label"))
    thinned = number_sessions(m.bars("p_brand").select("date")).where((F.col("session_no") - 1) % 20 == 0).select("date")
    return X.rank_ic(user_factors(m).join(labels, ["symbol", "date"]).join(thinned, "date"), ["date", "factor"])


@query("v01_user_ic", "SELECT * FROM user_ic", floats="rank_ic", dates="date")
def user_ic(m):
    return user_rank_ic(m)


@query("v01_user_summary",
       """SELECT factor, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS ic_std, avg((round(rank_ic, 12) > 0)::INT) AS positive_fraction, count(*) AS observations, 20 AS horizon
          FROM user_ic WHERE rank_ic IS NOT NULL GROUP BY factor""", floats="mean_rank_ic ic_std positive_fraction")
def user_summary(m):
    return X.ic_summary(user_rank_ic(m), 20)
