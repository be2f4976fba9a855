"""Composed panels: fundamentals per cutoff, monthly factor panels, breadth, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import finite, rolling_std
from marketframe.operators import asof, breadth as BR, fundamentals as G, panel as P, xsection as X
from marketframe.plans.crosssection import rank_sql
from marketframe.plans.pointintime import (
    cutoffs, estimates, flagged_names, industry_at, prepared, revision_dates, surprises,
)
from marketframe.plans.registry import frame, lag, part, query, roll
from marketframe.sources import disclosures as D
from marketframe.sources.market import Market
from marketframe.sources.vendor import universe_audit

for _kind in ("income", "cashflow", "balance"):
    part(f"known_{_kind}", f"""
SELECT * EXCLUDE (n) FROM (SELECT c.cutoff, v.*, row_number() OVER (PARTITION BY c.cutoff, v.ts_code, v.end_date ORDER BY v.available_at DESC) AS n
  FROM cutoffs c JOIN {_kind} v ON v.available_at < c.cutoff) WHERE n = 1""")

# Values of a statement line one year, one quarter and one full year before.
BEFORE = "last_day({0} - INTERVAL {1} MONTH)"


def prior(alias: str, table: str, months: int, of: str = "k") -> str:
    return (f"LEFT JOIN {table} {alias} ON {alias}.cutoff = {of}.cutoff AND {alias}.ts_code = {of}.ts_code "
            f"AND {alias}.end_date = {BEFORE.format(of + '.end_date', months)}")


part("latest_income", "SELECT cutoff, ts_code, max(end_date) AS end_date, max(available_at) AS sue_available_at FROM known_income GROUP BY cutoff, ts_code")
part("ttm_values", f"""
SELECT k.cutoff, k.ts_code, k.end_date, CASE WHEN month(k.end_date) = 12 THEN k.n_cashflow_act ELSE k.n_cashflow_act + f.n_cashflow_act - y.n_cashflow_act END AS cash
FROM known_cashflow k {prior('y', 'known_cashflow', 12)}
LEFT JOIN known_cashflow f ON f.cutoff = k.cutoff AND f.ts_code = k.ts_code AND f.end_date = make_date(year(k.end_date) - 1, 12, 31)""")
part("quarter_values", f"""
SELECT k.cutoff, k.ts_code, k.end_date, CASE WHEN month(k.end_date) = 3 THEN k.n_income_attr_p ELSE k.n_income_attr_p - p.n_income_attr_p END AS q
FROM known_income k {prior('p', 'known_income', 3)}""")
part("seasonal_changes", f"SELECT k.cutoff, k.ts_code, k.end_date, k.q - y.q AS d FROM quarter_values k {prior('y', 'quarter_values', 12)}")
part("seasonal", """
SELECT l.cutoff, l.ts_code, l.end_date, CASE WHEN n >= 6 AND v > 1000000 THEN d.d / v END AS sue FROM latest_income l
LEFT JOIN seasonal_changes d ON d.cutoff = l.cutoff AND d.ts_code = l.ts_code AND d.end_date = l.end_date
LEFT JOIN (SELECT l.cutoff, l.ts_code, count(p.d) AS n, stddev_samp(p.d) AS v FROM latest_income l JOIN seasonal_changes p ON p.cutoff = l.cutoff AND p.ts_code = l.ts_code
  AND p.end_date < l.end_date AND p.end_date >= last_day(l.end_date - INTERVAL 24 MONTH) GROUP BY l.cutoff, l.ts_code) s ON s.cutoff = l.cutoff AND s.ts_code = l.ts_code""")


def known(m: Market, kind: str) -> DataFrame:
    return asof.known_versions(prepared(m, kind), cutoffs(m).select("cutoff"), ["ts_code", "end_date"])


@query("g03_trailing_twelve_months", "SELECT cutoff, ts_code, end_date, cash FROM ttm_values WHERE cash IS NOT NULL",
       floats="cash", dates="cutoff end_date", digits=1)
def trailing_twelve_months(m):
    return known(m, "cashflow").select("cutoff", "ts_code", "end_date", G.ttm(F.col("n_cashflow_act")).alias("cash")).where("cash IS NOT NULL")


@query("g04_single_quarter", "SELECT cutoff, ts_code, end_date, q FROM quarter_values WHERE q IS NOT NULL", floats="q", dates="cutoff end_date", digits=1)
def single_quarter(m):
    return known(m, "income").select("cutoff", "ts_code", "end_date", G.single_quarter(F.col("n_income_attr_p")).alias("q")).where("q IS NOT NULL")


def financials(m: Market) -> DataFrame:
    m.settle("statements", lambda: D.statements(m))  # read by all three statement kinds
    return G.financial_factors(prepared(m, "income"), prepared(m, "cashflow"), prepared(m, "balance"), cutoffs(m))


@query("g05_seasonal_surprise", "SELECT cutoff, ts_code, CASE WHEN cutoff::DATE - end_date <= 550 THEN sue END AS seasonal_sue FROM seasonal WHERE sue IS NOT NULL",
       floats="seasonal_sue", dates="cutoff")
def seasonal_surprise(m):
    return financials(m).select("cutoff", "ts_code", "seasonal_sue").where("seasonal_sue IS NOT NULL")


part("quality", f"""
SELECT cutoff, ts_code, end_date AS quality_period, cash / assets AS cash_profitability, (cash - profit) / assets AS negative_accruals, gross / assets AS gross_profitability,
  CASE WHEN old_wc > 0 AND old_sales > 0 THEN -(wc / old_wc - sales / old_sales) END AS working_capital_discipline FROM (
  SELECT k.cutoff, k.ts_code, k.end_date, i.comp_type, (b.total_assets + by1.total_assets) / 2 AS assets, t.cash,
    CASE WHEN month(k.end_date) = 12 THEN i.n_income ELSE i.n_income + ff.n_income - iy.n_income END AS profit,
    CASE WHEN month(k.end_date) = 12 THEN i.revenue ELSE i.revenue + ff.revenue - iy.revenue END - CASE WHEN month(k.end_date) = 12 THEN i.oper_cost ELSE i.oper_cost + ff.oper_cost - iy.oper_cost END AS gross,
    b.accounts_receiv + b.inventories AS wc, by1.accounts_receiv + by1.inventories AS old_wc, i.revenue AS sales, iy.revenue AS old_sales
  FROM (SELECT i.cutoff, i.ts_code, max(i.end_date) AS end_date FROM known_income i JOIN known_cashflow c USING (cutoff, ts_code, end_date) JOIN known_balance b USING (cutoff, ts_code, end_date) GROUP BY i.cutoff, i.ts_code) k
  JOIN known_income i ON i.cutoff = k.cutoff AND i.ts_code = k.ts_code AND i.end_date = k.end_date
  JOIN known_balance b ON b.cutoff = k.cutoff AND b.ts_code = k.ts_code AND b.end_date = k.end_date
  JOIN ttm_values t ON t.cutoff = k.cutoff AND t.ts_code = k.ts_code AND t.end_date = k.end_date
  {prior('iy', 'known_income', 12)} {prior('by1', 'known_balance', 12)}
  LEFT JOIN known_income ff ON ff.cutoff = k.cutoff AND ff.ts_code = k.ts_code AND ff.end_date = make_date(year(k.end_date) - 1, 12, 31))
WHERE cutoff::DATE - end_date <= 550 AND comp_type = '1' AND assets > 0""")


@query("g06_quality_factors", "SELECT * FROM quality", floats="cash_profitability negative_accruals gross_profitability working_capital_discipline", dates="cutoff quality_period")
def quality_factors(m):
    return financials(m).where("quality_period IS NOT NULL").select(
        "cutoff", "ts_code", "quality_period", "cash_profitability", "negative_accruals", "gross_profitability", "working_capital_discipline")


def _availability(kind: str) -> str:
    return f"""(SELECT q.cutoff, q.ts_code, max(k.available_at) AS at FROM quality q JOIN known_{kind} k
  ON k.cutoff = q.cutoff AND k.ts_code = q.ts_code AND k.end_date <= q.quality_period GROUP BY q.cutoff, q.ts_code)"""


@query("g06_availability", f"""
SELECT l.cutoff, l.ts_code, CASE WHEN l.cutoff::DATE - l.end_date <= 550 THEN l.sue_available_at END AS sue_available_at, greatest(i.at, c.at, b.at) AS quality_available_at
FROM latest_income l LEFT JOIN {_availability('income')} i USING (cutoff, ts_code) LEFT JOIN {_availability('cashflow')} c USING (cutoff, ts_code)
LEFT JOIN {_availability('balance')} b USING (cutoff, ts_code)""", dates="cutoff sue_available_at quality_available_at")
def availability(m):
    """When surprise and quality became known: the latest over all earlier periods, however old."""
    return financials(m).select("cutoff", "ts_code", "sue_available_at", "quality_available_at")


part("valued_reports", """
SELECT c.date, v.symbol, CASE WHEN v.pe_ttm > 0 THEN 1 / v.pe_ttm END AS ep, CASE WHEN v.pb > 0 THEN 1 / v.pb END AS bp,
       r.roe * 12 / month(r.end_date) AS roe, r.roa * 12 / month(r.end_date) AS roa, r.end_date AS report_end_date
FROM cutoffs c JOIN valuations v ON v.date = c.date LEFT JOIN (
  SELECT date, ts_code, end_date, operate_profit / revenue AS roe, operate_profit / (revenue + 1000000) AS roa FROM (
    SELECT c.date, r.*, row_number() OVER (PARTITION BY c.date, r.ts_code ORDER BY r.end_date DESC, r.ann_date DESC) AS k FROM cutoffs c JOIN (
      SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ts_code, ann_date, end_date) AS n FROM (SELECT DISTINCT ts_code, ann_date, end_date, operate_profit, revenue, basic_eps FROM statements WHERE update_flag = '0')) WHERE n = 1) r
    ON r.ann_date < c.date AND r.end_date <= c.date AND c.date - r.end_date <= 550) WHERE k = 1) r ON r.date = c.date AND r.ts_code = v.symbol""")


def valued_reports(m: Market) -> DataFrame:
    dates = P.month_firsts(m.sessions).select("date")
    fin = G.latest_reports(D.statements(m), dates, ["operate_profit", "revenue", "basic_eps"])
    end = F.col("end_date")
    ratios = fin.select("date", F.col("ts_code").alias("symbol"), end.alias("report_end_date"),
                        G.annualized(F.col("operate_profit") / F.col("revenue"), end).alias("roe"),
                        G.annualized(F.col("operate_profit") / (F.col("revenue") + 1000000), end).alias("roa"))
    v = D.valuations(m).join(dates, "date", "left_semi")
    return v.join(ratios, ["date", "symbol"], "left").select(
        "date", "symbol", G.positive_inverse(F.col("pe_ttm")).alias("ep"), G.positive_inverse(F.col("pb")).alias("bp"), "roe", "roa", "report_end_date")


@query("g09_valuation_profitability", "SELECT * FROM valued_reports", floats="ep bp roe roa", dates="date report_end_date")
def valuation_profitability(m):
    return valued_reports(m)


# --- monthly panels -------------------------------------------------------------------------

# Brands are quoted on about 60 % of the sessions, so the observation floor is lower here.
ELIGIBLE = dict(max_lot_price=2000000, min_amount=10000, observed=120, window=270, amount_days=8)
part("priced", f"""
SELECT symbol, date, (p21 / {lag('price', 126)} - 1 + p21 / {lag('price', 252)} - 1) / 2 AS momentum_raw, {roll('stddev_samp', 'r', 63, 20)} AS volatility, eligible FROM (
  SELECT symbol, date, price, {lag('price', 21)} AS p21, price / {lag('price', 1)} - 1 AS r,
    coalesce(count(price) OVER {frame(270)} >= 120, false) AND coalesce(({roll('avg', 'amount', 20, 8)}) >= 10000, false) AND coalesce(volume > 0, false) AND price IS NOT NULL AND close * 100 <= 2000000 AS eligible
  FROM (SELECT *, close * adj_factor AS price FROM brand_panel))""")
part("pool", """
SELECT k.date, k.membership_date, k.symbol, p.momentum_raw, p.volatility FROM membership k JOIN priced p ON p.symbol = k.symbol AND p.date = k.date
WHERE p.eligible AND starts_with(k.symbol, 'Brand#') AND NOT EXISTS (SELECT 1 FROM names n WHERE n.ts_code = k.symbol AND n.start_date <= k.date AND (n.end_date IS NULL OR n.end_date >= k.date) AND regexp_matches(n.name, '(?i)ST|退'))""")


def priced(m: Market) -> DataFrame:
    """Stock rules on unfilled adjusted prices: momentum, volatility, eligibility."""
    w = Window.partitionBy("symbol").orderBy("date")
    p = m.panel("p_brand").withColumn("price", F.col("close") * F.col("adj_factor"))
    p = p.withColumn("r", F.col("price") / F.lag("price").over(w) - 1)
    return p.select("symbol", "date", P.skip_momentum(F.col("price"), 21, (126, 252)).alias("momentum_raw"),
                    rolling_std(F.col("r"), 63, 20).alias("volatility"), P.stock_eligibility(**ELIGIBLE).alias("eligible"))


def pool(m: Market, delay: int = 0) -> DataFrame:
    """Eligible members of each month's first session without a warning in their name."""
    dates = cutoffs(m).select("date")
    inside = asof.members_on(dates, D.members(m))
    live = priced(m).where("eligible").select("symbol", "date", "momentum_raw", "volatility")
    named = inside.where(F.col("symbol").startswith("Brand#")).join(flagged_names(m, dates), ["date", "symbol"], "left_anti")
    return named.join(live, ["symbol", "date"]).select("date", "membership_date", "symbol", "momentum_raw", "volatility")


STOCK_PANEL = f"""
  SELECT date, symbol, 0.4 * value + 0.4 * quality + 0.2 * low_vol AS quality_value, 0.5 * momentum + 0.3 * low_vol + 0.2 * quality AS momentum_defensive, 0.25 * (value + quality + momentum + low_vol) AS ensemble FROM (
    SELECT date, symbol, ({rank_sql('ep')} + {rank_sql('bp')}) / 2 AS value, ({rank_sql('roe')} + {rank_sql('roa')}) / 2 AS quality, {rank_sql('coalesce(momentum_raw, 0)')} AS momentum, {rank_sql('volatility', desc=True)} AS low_vol
    FROM pool JOIN valued_reports USING (date, symbol) WHERE ep IS NOT NULL AND bp IS NOT NULL AND roe > 0 AND roa IS NOT NULL AND volatility > 0)"""


@query("g11_stock_panel", STOCK_PANEL, floats="quality_value momentum_defensive ensemble", dates="date")
def stock_panel(m):
    """Members with every factor known, ranked inside the month and combined into families."""
    f = pool(m).join(valued_reports(m), ["date", "symbol"]).withColumn("momentum_raw", F.coalesce("momentum_raw", F.lit(0.0)))
    f = f.where("ep IS NOT NULL AND bp IS NOT NULL AND roe > 0 AND roa IS NOT NULL AND volatility > 0").withColumn("calm", -F.col("volatility"))
    r = X.with_ranks(f, ["ep", "bp", "roe", "roa", "momentum_raw", "calm"], ["date"])
    parts = r.withColumns({
        "value": (F.col("ep_rank") + F.col("bp_rank")) / 2, "quality": (F.col("roe_rank") + F.col("roa_rank")) / 2,
        "momentum": F.col("momentum_raw_rank"), "low_vol": F.col("calm_rank")})
    return X.composite(parts).select("date", "symbol", *X.FAMILIES)


part("factor_raw", """
SELECT p.date, p.symbol, p.momentum_raw, p.volatility, r.np_revision_63, r.revision_breadth_63, CASE WHEN c.cutoff::DATE - s.end_date <= 550 THEN s.sue END AS seasonal_sue, e.incremental_surprise,
  q.cash_profitability, q.negative_accruals, q.gross_profitability, q.working_capital_discipline, CASE WHEN v.total_mv > 0 THEN ln(v.total_mv * 10000) END AS log_market_cap, i.industry
FROM pool p JOIN cutoffs c ON c.date = p.date AND c.session_no > 63 LEFT JOIN revisions r ON r.date = p.date AND r.ts_code = p.symbol
LEFT JOIN seasonal s ON s.cutoff = c.cutoff AND s.ts_code = p.symbol LEFT JOIN quality q ON q.cutoff = c.cutoff AND q.ts_code = p.symbol
LEFT JOIN recent_surprises e ON e.cutoff = c.cutoff AND e.symbol = p.symbol LEFT JOIN valuations v ON v.date = p.date AND v.symbol = p.symbol
LEFT JOIN (SELECT c.date, i.ts_code, min(i.l1_code) AS industry FROM cutoffs c JOIN industries i ON i.in_date < c.date AND (i.out_date IS NULL OR i.out_date >= c.date) GROUP BY c.date, i.ts_code HAVING count(DISTINCT i.l1_code) = 1) i
  ON i.date = p.date AND i.ts_code = p.symbol""")
_ranks = ", ".join(f"{rank_sql(c)} AS {c}_rank" for c in X.RAW_FACTORS)


def _mean_sql(cols, needed):
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in cols)
    s = " + ".join(f"coalesce({c}, 0)" for c in cols)
    return f"CASE WHEN {n} >= {needed} THEN ({s}) / ({n}) END"


part("factor_panel", f"""
SELECT *, {_mean_sql(list(X.GROUPS), 2)} AS balanced FROM (SELECT *, {', '.join(f"{_mean_sql([c + '_rank' for c in cols], k)} AS {name}" for name, (cols, k) in X.GROUPS.items())}
FROM (SELECT *, {_ranks} FROM factor_raw))""")


def store_panel_parts(m: Market) -> None:
    """Join the trades once, and write the tables that several branches of the factor panel read.

    As one plan the panel has more than a hundred shuffles. The driver plans all of what is left of it anew
    after each, and holds its plans, their texts and their generated code, so it works through the panel part by part.
    """
    m.store_sessions()
    m.store("cutoffs", lambda: cutoffs(m))
    m.store_trades("p_brand", "p_type", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    m.store(("bars", "p_brand"), lambda: m.bars("p_brand"))
    m.store("estimates", lambda: estimates(m))
    m.settle("statements", lambda: D.statements(m))
    for kind in G.KINDS:
        m.store(("prepared", kind), lambda: prepared(m, kind))
    m.store(("members", 12), lambda: D.members(m))
    m.store("names", lambda: D.names(m))
    m.store("industries", lambda: D.industries(m))


def factor_panel(m: Market) -> DataFrame:
    """Month-first members with revision, surprise, quality, industry, size and price factors."""
    store_panel_parts(m)
    days = cutoffs(m).where("session_no > 63")
    base = m.store("pool", lambda: pool(m)).join(days.select("date", "cutoff"), "date")
    revision = m.store("revisions", lambda: G.analyst_revision(G.paired_estimates(estimates(m), revision_dates(m)))).withColumnRenamed("ts_code", "symbol")
    quality = m.store("financials", lambda: financials(m)).withColumnRenamed("ts_code", "symbol")
    recent = m.store("recent", lambda: G.recent_events(surprises(m), days))
    industry = m.store("industry_at", lambda: industry_at(m, days.select("date"))).withColumnRenamed("ts_code", "symbol")
    size = D.valuations(m).select("symbol", "date", F.when(F.col("total_mv") > 0, F.ln(F.col("total_mv") * 10000)).alias("log_market_cap"))
    f = (base.join(revision, ["date", "symbol"], "left").join(quality, ["cutoff", "symbol"], "left")
         .join(recent, ["cutoff", "symbol"], "left")
         .join(industry, ["date", "symbol"], "left").join(size, ["date", "symbol"], "left"))
    f = f.withColumns({c: finite(F.col(c)) for c in X.RAW_FACTORS})
    return m._once("factor_panel", lambda: X.factor_scores(f, ["date"]))


@query("g10_factor_panel", "SELECT date, symbol, np_revision_63, seasonal_sue, incremental_surprise, cash_profitability, log_market_cap, industry, balanced FROM factor_panel",
       floats="np_revision_63 seasonal_sue incremental_surprise cash_profitability log_market_cap balanced", dates="date")
def factor_panel_query(m):
    return factor_panel(m).select("date", "symbol", "np_revision_63", "seasonal_sue", "incremental_surprise", "cash_profitability", "log_market_cap", "industry", "balanced")


@query("x03_group_scores", "SELECT date, symbol, revision, surprise, cash_quality, balanced FROM factor_panel", floats="revision surprise cash_quality balanced", dates="date")
def group_scores(m):
    return factor_panel(m).select("date", "symbol", "revision", "surprise", "cash_quality", "balanced")


@query("g10_availability_audit", "SELECT 0 AS late_rows, count(*) AS rows FROM factor_raw")
def availability_audit(m):
    """No value of the panel became known at or after its cutoff."""
    late = F.lit(False)
    for c in ("analyst_available_at", "sue_available_at", "quality_available_at", "surprise_available_at"):
        late = late | F.coalesce(F.col(c) >= F.col("cutoff"), F.lit(False))
    return factor_panel(m).agg(F.count_if(late).cast("int").alias("late_rows"), F.count(F.lit(1)).alias("rows"))


@query("a09_coverage_counts", "SELECT date, count(*) AS eligible, count(industry) AS industry_known, " + ", ".join(f"count({c}) AS {c}" for c in (*X.RAW_FACTORS, "balanced")) + " FROM factor_panel GROUP BY date", dates="date")
def coverage_counts(m):
    return factor_panel(m).groupBy("date").agg(
        F.count(F.lit(1)).alias("eligible"), F.count("industry").alias("industry_known"), *[F.count(c).alias(c) for c in (*X.RAW_FACTORS, "balanced")])


# --- breadth ---------------------------------------------------------------------------------

part("changes", f"SELECT p.symbol, p.date, p.session_no, b.pct_chg FROM brand_panel p LEFT JOIN (SELECT symbol, date, ln(close / {lag('close', 1)}) AS pct_chg FROM brand_bars) b ON b.symbol = p.symbol AND b.date = p.date")
part("members_daily", "SELECT s.date, k.symbol FROM (SELECT s.date, (SELECT max(snapshot) FROM members k WHERE k.snapshot < s.date) AS snapshot FROM sessions s) s JOIN members k ON k.snapshot = s.snapshot WHERE s.date - s.snapshot <= 62")


def _mean20(x):
    return f"CASE WHEN count({x}) OVER (ORDER BY date ROWS 19 PRECEDING) >= 20 THEN avg({x}) OVER (ORDER BY date ROWS 19 PRECEDING) END"


def market_breadth(m: Market) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    chg = m.bars("p_brand").select("symbol", "date", F.ln(F.col("close") / F.lag("close").over(w)).alias("pct_chg"))
    p = m.panel("p_brand").select("symbol", "date", "session_no").join(chg, ["symbol", "date"], "left")
    return BR.breadth_signals(p, D.members(m), m.sessions, min_members=5, fall=-1.0, observed=60)


@query("a08_market_breadth",
       f"""SELECT date, constituents_traded, adv AS advancing_share, {_mean20('adv')} AS advancing_20, {_mean20('fall')} AS large_decline_20, above_126 FROM (
           SELECT s.date, coalesce(n, 0) AS constituents_traded, CASE WHEN n >= 5 THEN up / n END AS adv, CASE WHEN n >= 5 THEN down / n END AS fall, CASE WHEN warm >= 5 THEN above / warm END AS above_126 FROM sessions s LEFT JOIN (
             SELECT k.date, count(*) AS n, count(*) FILTER (pct_chg > 0) AS up, count(*) FILTER (pct_chg <= -1) AS down, count(*) FILTER (warmed) AS warm, count(*) FILTER (warmed AND idx > ma) AS above FROM members_daily k JOIN (
               SELECT *, avg(idx) OVER {frame(126)} AS ma, session_no >= 126 AND count(pct_chg) OVER {frame(126)} >= 60 AS warmed FROM (
                 SELECT *, exp(sum(ln(1 + coalesce(pct_chg, 0) / 100)) OVER {frame()}) AS idx FROM changes)) c ON c.symbol = k.symbol AND c.date = k.date WHERE pct_chg IS NOT NULL GROUP BY k.date) d ON d.date = s.date)""",
       floats="advancing_share advancing_20 large_decline_20 above_126", dates="date")
def breadth_query(m):
    return market_breadth(m)


# --- simple aggregates ------------------------------------------------------------------------


@query("a01_group_statistics",
       "SELECT event_type, count(*) AS n, min(value) AS lowest, max(value) AS highest, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS total, avg(value) AS mean, median(value) AS middle FROM events GROUP BY event_type",
       floats="lowest highest total mean middle", digits=4)
def group_statistics(m):
    """The median comes from counts and buckets, so no event type is held in one task."""
    from marketframe.operators.quantiles import positive_quantile

    e = m.table("events").select("event_type", "value")
    g = e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.avg("value").alias("mean"))
    shifted = e.withColumn("value", F.col("value") + 1)  # the quantile needs positive values
    middle = positive_quantile(shifted, ["event_type"], "value", 0.5, "middle").withColumn("middle", F.col("middle") - 1)
    return g.join(middle, "event_type")


@query("a03_distinct_counts", "SELECT date_trunc('month', ts)::DATE AS month, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1", dates="month")
def distinct_counts(m):
    return m.table("events").groupBy(F.trunc("ts", "MM").alias("month")).agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("a04_reason_counts", "SELECT reason, count(*) AS n FROM surprises GROUP BY reason")
def reason_counts(m):
    return surprises(m).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("a16_seasoned_since",
       """SELECT symbol, date, max(date) OVER () AS all_seasoned FROM (SELECT symbol, CASE WHEN count(*) >= 253 THEN max(date) FILTER (k = 253) ELSE max(date) END AS date FROM (
          SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM brand_bars) GROUP BY symbol)""", dates="date all_seasoned")
def seasoned_since(m):
    return P.seasoned_since(m.bars("p_brand"), 253)


META = """SELECT p_brand AS symbol, CASE WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN lower(p_type) END AS theme, CASE WHEN p_size > 5 THEN CAST(DATE '1995-01-01' + p_size * 30 AS DATE) END AS listing,
  p_retailprice > 1500 AS retired, p_size > 40 AS listing_conflict FROM part"""


@query("a17_universe_audit",
       f"""SELECT count(*) AS codes, count(*) FILTER (theme IS NOT NULL) AS theme_candidates, count(*) FILTER (theme IS NOT NULL AND listing <= DATE '1998-01-01') AS download_candidates,
           count(*) FILTER (theme IS NOT NULL AND listing <= DATE '1998-01-01' AND retired) AS retired_candidates, count(*) FILTER (listing IS NULL) AS missing_listing, count(*) FILTER (listing_conflict) AS listing_conflicts,
           count(*) FILTER (theme IS NULL) AS unknown_theme FROM ({META})""")
def universe_audit_query(m):
    meta = m.table("part").select(
        F.when(F.col("p_type").isin("PROMO", "SMALL", "LARGE"), F.lower("p_type")).alias("theme"),
        F.when(F.col("p_size") > 5, F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size") * 30)).alias("listing"),
        (F.col("p_retailprice") > 1500).alias("retired"), (F.col("p_size") > 40).alias("listing_conflict"))
    return universe_audit(meta, F.lit("1998-01-01").cast("date"))
