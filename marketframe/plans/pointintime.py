"""Joins in time: as-of, versions, validity intervals, memberships, events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import change, rolling_percent_rank
from marketframe.operators import asof, dedup, panel as P
from marketframe.operators import fundamentals as G
from marketframe.plans.registry import lag, part, query, roll
from marketframe.sources import disclosures as D
from marketframe.sources.market import Market

STMT = "ts_code, end_date, available_at"


def cutoffs(m: Market) -> DataFrame:
    """First session of each month with its 18:30 cutoff."""
    return m._once("cutoffs", lambda: P.month_firsts(m.sessions).select("date", "session_no", asof.cutoff_of(F.col("date")).alias("cutoff")))


def prepared(m: Market, kind: str) -> DataFrame:
    return m._once(("prepared", kind), lambda: G.prepare_statements(D.statements(m), kind))


def estimates(m: Market) -> DataFrame:
    return m._once("estimates", lambda: G.prepare_estimates(D.analyst_reports(m)))


# --- calendar and equi joins -----------------------------------------------------


@query("j01_calendar_panel", "SELECT symbol, date, session_no, close, (close IS NOT NULL)::INT AS observed FROM brand_panel",
       floats="close", dates="date")
def calendar_panel(m):
    return m.panel("p_brand").select("symbol", "date", "session_no", "close", F.col("close").isNotNull().cast("int").alias("observed"))


@query("j02_one_to_one_merge",
       """SELECT b.symbol, b.date, b.close, v.pe_ttm, v.total_mv FROM brand_bars b LEFT JOIN (SELECT * FROM valuations WHERE pe_ttm > 0) v
          ON b.symbol = v.symbol AND b.date = v.date""",
       floats="close pe_ttm total_mv", dates="date")
def one_to_one_merge(m):
    v = D.valuations(m).where("pe_ttm > 0").select("symbol", "date", "pe_ttm", "total_mv")
    return m.bars("p_brand").select("symbol", "date", "close").join(v, ["symbol", "date"], "left")


@query("j03_asof_tolerance",
       """SELECT p.event_id, p.user_id, s.event_id AS signup_id, s.value AS signup_value
          FROM (SELECT * FROM events WHERE event_type = 'purchase') p
          LEFT JOIN LATERAL (SELECT e.event_id, e.value, e.ts FROM events e WHERE e.event_type = 'signup' AND e.user_id = p.user_id AND e.ts <= p.ts
                             ORDER BY e.ts DESC, e.value DESC LIMIT 1) s ON s.ts >= p.ts - INTERVAL 7 DAY""",
       floats="signup_value")
def asof_tolerance(m):
    """Last signup of the user in the seven days before each purchase."""
    e = m.table("events")
    right = e.where("event_type = 'signup'").select("user_id", "ts", "value", F.col("event_id").alias("signup_id"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    found = asof.asof_backward(left, right.withColumnRenamed("value", "signup_value"), ["user_id"], "ts", "ts",
                               ["signup_value", "signup_id"], bucket="day", tolerance="INTERVAL 7 DAY")
    return found.select("event_id", "user_id", "signup_id", "signup_value")


MACRO = """
  SELECT date, session_no, lag(m3) OVER w AS m3, lag(overnight) OVER w AS overnight, lag(y1) OVER w AS y1
  FROM (SELECT s.date, s.session_no, CASE WHEN s.date - r.date <= 7 THEN m3 END AS m3, CASE WHEN s.date - r.date <= 7 THEN overnight END AS overnight,
               CASE WHEN s.date - r.date <= 7 THEN y1 END AS y1
        FROM sessions s ASOF LEFT JOIN rates r ON s.date >= r.date) WINDOW w AS (ORDER BY date)"""


def aligned(sessions: DataFrame, series: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Series on the session calendar: at most seven days old, then one session late."""
    found = asof.asof_backward(sessions, series, keys, "date", "date", fields, bucket="year", tolerance="INTERVAL 7 DAY")
    return asof.lag_one_session(found.drop("matched_at"), fields, keys)


def aligned_rates(m: Market) -> DataFrame:
    one = F.lit("rates").alias("series")
    return aligned(m.sessions.select("*", one), D.rates(m).select("*", one), ["m3", "overnight", "y1"], ["series"])


@query("p24_rate_changes", f"SELECT date, m3 - lag(m3, 63) OVER (ORDER BY date) AS rate_change, overnight - y1 AS funding_stress FROM ({MACRO})",
       floats="rate_change funding_stress", dates="date")
def rate_changes(m):
    w = Window.partitionBy("series").orderBy("date")
    return aligned_rates(m).select("date", (F.col("m3") - F.lag("m3", 63).over(w)).alias("rate_change"),
                                   (F.col("overnight") - F.col("y1")).alias("funding_stress"))


PEPB = """
  SELECT code, date, session_no, lag(pe) OVER w AS pe, lag(pb) OVER w AS pb FROM (
    SELECT s.code, s.date, s.session_no, CASE WHEN s.date - v.date <= 7 THEN v.pe_ttm END AS pe, CASE WHEN s.date - v.date <= 7 THEN v.pb END AS pb
    FROM (SELECT * FROM sessions, (SELECT DISTINCT code FROM index_valuations)) s ASOF LEFT JOIN index_valuations v ON s.code = v.code AND s.date >= v.date)
  WINDOW w AS (PARTITION BY code ORDER BY date)"""


def _sql_rank(x: str) -> str:
    return f"""(SELECT CASE WHEN count(*) >= 252 THEN (count(*) FILTER (k.{x} < a.{x}) + (count(*) FILTER (k.{x} = a.{x}) + 1) / 2.0) / count(*) END
      FROM pos k WHERE k.code = a.code AND k.session_no BETWEEN a.session_no - 1259 AND a.session_no AND k.{x} IS NOT NULL)"""


@query("p25_valuation_ranks",
       f"""WITH pos AS MATERIALIZED (SELECT code, date, session_no, CASE WHEN pe > 0 THEN pe END AS pe, CASE WHEN pb > 0 THEN pb END AS pb FROM ({PEPB}))
           SELECT code, date, pe_rank, pb_rank, 1 - (pe_rank + pb_rank) AS value_score FROM (
             SELECT code, date, CASE WHEN pe IS NOT NULL THEN {_sql_rank('pe')} END AS pe_rank, CASE WHEN pb IS NOT NULL THEN {_sql_rank('pb')} END AS pb_rank FROM pos a)""",
       floats="pe_rank pb_rank value_score", dates="date")
def valuation_ranks(m):
    codes = D.index_valuations(m).select(F.col("code").alias("symbol")).distinct()
    grid = P.calendar_grid(codes, m.sessions).withColumnRenamed("symbol", "code")
    a = aligned(grid, D.index_valuations(m), ["pe_ttm", "pb"], ["code"])
    w = Window.partitionBy("code").orderBy("date")
    pos = a.select("code", "date", *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("pe_ttm", "pb")])
    ranked = pos.select("code", "date", rolling_percent_rank(F.col("pe_ttm"), 1260, 252, w).alias("pe_rank"),
                        rolling_percent_rank(F.col("pb"), 1260, 252, w).alias("pb_rank"))
    return ranked.withColumn("value_score", 1 - (F.col("pe_rank") + F.col("pb_rank")))


YIELDS = """
  SELECT date, lag(a) OVER w AS gov_1y, lag(b) OVER w AS gov_3y, lag(c) OVER w AS gov_10y, lag(d) OVER w AS aaa_3y FROM (
    SELECT s.date, CASE WHEN s.date - k.date <= 7 THEN a END AS a, CASE WHEN s.date - k.date <= 7 THEN b END AS b,
           CASE WHEN s.date - k.date <= 7 THEN c END AS c, CASE WHEN s.date - k.date <= 7 THEN d END AS d
    FROM sessions s ASOF LEFT JOIN (SELECT date, max(yield) FILTER (curve = 'gov' AND tenor = '1y') AS a, max(yield) FILTER (curve = 'gov' AND tenor = '3y') AS b,
      max(yield) FILTER (curve = 'gov' AND tenor = '10y') AS c, max(yield) FILTER (curve = 'aaa' AND tenor = '3y') AS d FROM curves GROUP BY date) k ON s.date >= k.date)
  WINDOW w AS (ORDER BY date)"""


def aligned_yields(m: Market) -> DataFrame:
    from marketframe.sources.series import curve_columns

    wide = curve_columns(D.curves(m)).withColumn("series", F.lit("curves"))
    fields = ["gov_1y", "gov_3y", "gov_10y", "aaa_3y"]
    return aligned(m.sessions.withColumn("series", F.lit("curves")), wide, fields, ["series"])


def _d63(x):
    return f"({x} - lag({x}, 63) OVER (ORDER BY date))"


@query("p26_yield_overlay",
       f"""SELECT date, coalesce(dy > 0.25, false)::INT AS rising_10y, coalesce(dy > 0.15 AND y > ma, false)::INT AS rising_and_high_10y,
           coalesce(dslope > 0.25 AND dy > 0.10, false)::INT AS steepening_curve, coalesce(dspread > 0.20 AND spread > q75, false)::INT AS credit_stress
           FROM (SELECT date, y, spread, {_d63('y')} AS dy, {_d63('slope')} AS dslope, {_d63('spread')} AS dspread,
             CASE WHEN count(y) OVER (ORDER BY date ROWS 125 PRECEDING) >= 126 THEN avg(y) OVER (ORDER BY date ROWS 125 PRECEDING) END AS ma,
             CASE WHEN count(spread) OVER (ORDER BY date ROWS 251 PRECEDING) >= 126 THEN quantile_cont(spread, 0.75) OVER (ORDER BY date ROWS 251 PRECEDING) END AS q75
             FROM (SELECT date, gov_10y AS y, gov_10y - gov_1y AS slope, aaa_3y - gov_3y AS spread FROM ({YIELDS})))""",
       dates="date")
def yield_overlay(m):
    from marketframe.operators.overlays import yield_flags

    return yield_flags(aligned_yields(m)).select(
        "date", *[F.col(c).cast("int").alias(c) for c in ("rising_10y", "rising_and_high_10y", "steepening_curve", "credit_stress")])


@query("p27_bull_regime",
       f"""SELECT date, strong, CASE WHEN strong >= 2 THEN 0.20 ELSE 0.30 END AS bond_cap FROM (
           SELECT date, sum((coalesce(close > ({roll('avg', 'close', 20)}), false) AND coalesce(close > {lag('close', 10)}, false))::INT)::BIGINT AS strong FROM (
             SELECT *, (coalesce(close > ({roll('avg', 'close', 20)}), false) AND coalesce(close > {lag('close', 10)}, false)) AS up FROM type_adjusted WHERE symbol IN ('ECONOMY', 'LARGE', 'MEDIUM')) GROUP BY date)""".replace(
           f"sum((coalesce(close > ({roll('avg', 'close', 20)}), false) AND coalesce(close > {lag('close', 10)}, false))::INT)", "sum(up::INT)"),
       floats="bond_cap", dates="date")
def bull_regime(m):
    from marketframe.operators.overlays import bull_caps

    leaders = m.adjusted("p_type").where(F.col("symbol").isin("ECONOMY", "LARGE", "MEDIUM"))
    return bull_caps(leaders, average=20, back=10, normal=0.30, bull=0.20)


@query("p28_trend_regime",
       f"""SELECT date, (coalesce(p > ({roll('avg', 'p', 4)}), false)::INT + coalesce(p > ({roll('avg', 'p', 9)}), false)::INT) / 2.0 AS regime
           FROM (SELECT symbol, date, close * adj_factor AS p FROM type_panel WHERE symbol = 'LARGE')""",
       floats="regime", dates="date")
def trend_regime(m):
    one = m.panel("p_type").where("symbol = 'LARGE'").withColumn("p", F.col("close") * F.col("adj_factor"))
    return one.select("date", P.trend_vote(F.col("p"), (4, 9), strict=True).alias("regime"))


@query("p29_relative_strength",
       f"""SELECT a.symbol, a.date, 0.5 * (a.m63 - b.m63 + a.m126 - b.m126) AS relative FROM
           (SELECT symbol, date, marked / {lag('marked', 63)} - 1 AS m63, marked / {lag('marked', 126)} - 1 AS m126 FROM type_marked) a
           JOIN (SELECT symbol, date, marked / {lag('marked', 63)} - 1 AS m63, marked / {lag('marked', 126)} - 1 AS m126 FROM type_marked) b
           ON a.date = b.date AND b.symbol = 'STANDARD' WHERE a.m126 - b.m126 IS NOT NULL""",
       floats="relative", dates="date")
def relative_strength(m):
    p = P.mark_prices(m.adjusted("p_type"))
    mom = p.select("symbol", "date", change(F.col("marked"), 63).alias("m63"), change(F.col("marked"), 126).alias("m126"))
    return P.relative_strength(mom, "STANDARD", ["m63", "m126"]).where("relative IS NOT NULL").select("symbol", "date", "relative")


PREMIUM = """
  SELECT symbol, ann_date, premium FROM (
    SELECT f.symbol, f.ann_date, b.close / f.unit_nav - 1 AS premium FROM (
      SELECT symbol, ann_date, arg_max(nav_date, nav_date) AS nav_date, arg_max(unit_nav, nav_date) AS unit_nav
      FROM fund_values WHERE ann_date >= nav_date AND unit_nav > 0 GROUP BY symbol, ann_date) f
    JOIN type_bars b ON b.symbol = f.symbol AND b.date = f.nav_date)
  WHERE premium BETWEEN -0.5 AND 0.5"""


@query("j04_published_premium",
       f"""SELECT symbol, date, lag(premium) OVER (PARTITION BY symbol ORDER BY date) AS premium FROM (
           SELECT s.symbol, s.date, CASE WHEN s.date - p.ann_date <= 7 THEN p.premium END AS premium
           FROM (SELECT * FROM sessions, (VALUES ('LARGE'), ('MEDIUM'), ('PROMO')) v(symbol)) s ASOF LEFT JOIN ({PREMIUM}) p ON p.symbol = s.symbol AND s.date >= p.ann_date)""",
       floats="premium", dates="date")
def published_premium(m):
    from marketframe.operators.overlays import published_premiums

    return published_premiums(m.bars("p_type"), D.fund_values(m), m.sessions).select("symbol", "date", "premium")


# --- statement versions ---------------------------------------------------------


@query("j05_known_versions",
       """SELECT c.date, i.ts_code, i.end_date, max(available_at) AS available_at, arg_max(revenue, available_at) AS revenue
          FROM cutoffs c JOIN income i ON i.available_at < c.cutoff GROUP BY c.date, i.ts_code, i.end_date""",
       floats="revenue", dates="date end_date available_at", digits=2)
def known_versions(m):
    """Latest version of every statement known before each monthly cutoff."""
    return asof.known_versions(prepared(m, "income"), cutoffs(m).select("date", "cutoff"), ["ts_code", "end_date"]).select(
        "date", "ts_code", "end_date", "available_at", "revenue")


@query("j06_latest_reports",
       """SELECT c.date, r.ts_code, max(r.end_date) AS end_date, arg_max(r.revenue, struct_pack(e := r.end_date, a := r.ann_date)) AS revenue
          FROM cutoffs c JOIN (
            SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ts_code, ann_date, end_date) AS n FROM (
              SELECT DISTINCT ts_code, ann_date, end_date, revenue, operate_profit, basic_eps FROM statements WHERE update_flag = '0')) WHERE n = 1) r
          ON r.ann_date < c.date AND r.end_date <= c.date AND c.date - r.end_date <= 550 GROUP BY c.date, r.ts_code""",
       floats="revenue", dates="date end_date", digits=2)
def latest_reports(m):
    dates = P.month_firsts(m.sessions).select("date")
    return G.latest_reports(D.statements(m), dates, ["revenue", "operate_profit", "basic_eps"]).select("date", "ts_code", "end_date", "revenue")


part("revision_dates", """
SELECT a.date, a.date AS now_day, b.date AS before_day, year(a.date) || 'Q4' AS fiscal FROM cutoffs a JOIN sessions b ON b.session_no = a.session_no - 63""")

for _name, _at in (("estimates_now", "now_day"), ("estimates_then", "before_day")):
    part(_name, f"""
SELECT date, ts_code, org_name, np_cny, available_at FROM (
  SELECT d.date, a.*, row_number() OVER (PARTITION BY d.date, a.ts_code, a.org_name ORDER BY reported_at DESC, available_at DESC, np_cny DESC NULLS LAST) AS n
  FROM revision_dates d JOIN analysts a ON a.quarter = d.fiscal AND a.available_at < CAST(d.{_at} AS TIMESTAMP) + INTERVAL 1110 MINUTE
       AND a.reported_at >= d.{_at} - 180)
WHERE n = 1 AND np_cny IS NOT NULL""")


def revision_dates(m: Market) -> DataFrame:
    """Month-first sessions with the session 63 before."""
    w = Window.orderBy("date")
    return (m.sessions.withColumn("before", F.lag("date", 63).over(w))
            .join(cutoffs(m).select("date"), "date", "left_semi")
            .where("before IS NOT NULL").select("date", F.col("date").alias("at"), "before"))


@query("j07_latest_estimates", "SELECT date, ts_code, org_name, np_cny, available_at FROM estimates_now",
       floats="np_cny", dates="date available_at", digits=1)
def latest_estimates(m):
    d = revision_dates(m).select("date", "at", F.concat(F.year("at").cast("string"), F.lit("Q4")).alias("fiscal"))
    return G.latest_estimates(estimates(m), d).select("date", "ts_code", "org_name", "np_cny", "available_at")


@query("j08_paired_estimates",
       "SELECT date, ts_code, org_name, n.np_cny, o.np_cny AS np_old FROM estimates_now n JOIN estimates_then o USING (date, ts_code, org_name)",
       floats="np_cny np_old", dates="date", digits=1)
def paired_estimates(m):
    return G.paired_estimates(estimates(m), revision_dates(m)).select("date", "ts_code", "org_name", "np_cny", "np_old")


part("revisions", """
SELECT date, ts_code, CASE WHEN n >= 3 THEN m END AS np_revision_63, CASE WHEN n >= 3 THEN b END AS revision_breadth_63, n AS paired_brokers, last_known AS analyst_available_at
FROM (SELECT date, ts_code, count(*) AS n, median((n.np_cny - o.np_cny) / abs(o.np_cny)) AS m, avg(sign(n.np_cny - o.np_cny)) AS b, max(n.available_at) AS last_known
      FROM estimates_now n JOIN estimates_then o USING (date, ts_code, org_name) WHERE abs(o.np_cny) >= 1000000 GROUP BY date, ts_code)""")


@query("a02_analyst_revision", "SELECT * FROM revisions",
       floats="np_revision_63 revision_breadth_63", dates="date analyst_available_at")
def analyst_revision(m):
    return G.analyst_revision(G.paired_estimates(estimates(m), revision_dates(m)))


# --- intervals and memberships ----------------------------------------------------


@query("j09_industry_on_date",
       """SELECT c.date, i.ts_code, min(i.l1_code) AS industry FROM cutoffs c JOIN industries i
          ON i.in_date < c.date AND (i.out_date IS NULL OR i.out_date >= c.date) GROUP BY c.date, i.ts_code HAVING count(DISTINCT i.l1_code) = 1""",
       dates="date")
def industry_on_date(m):
    return industry_at(m, P.month_firsts(m.sessions).select("date"))


def industry_at(m: Market, dates: DataFrame) -> DataFrame:
    live = asof.valid_on(D.industries(m), dates, "in_date", "out_date", strict_start=True)
    return asof.unambiguous(live, ["date", "ts_code"], "l1_code").withColumnRenamed("l1_code", "industry")


@query("j10_flagged_names_removed",
       """SELECT c.date, b.symbol FROM cutoffs c JOIN brand_bars b ON b.date = c.date WHERE NOT EXISTS (
          SELECT 1 FROM names n WHERE n.ts_code = b.symbol AND n.start_date <= c.date AND (n.end_date IS NULL OR n.end_date >= c.date) AND regexp_matches(n.name, '(?i)ST|退'))""",
       dates="date")
def flagged_names_removed(m):
    dates = P.month_firsts(m.sessions).select("date")
    pool = m.bars("p_brand").select("date", "symbol").join(dates, "date", "left_semi")
    return pool.join(flagged_names(m, dates), ["date", "symbol"], "left_anti")


def flagged_names(m: Market, dates: DataFrame) -> DataFrame:
    """(date, symbol) pairs whose name warns of special treatment or delisting on that date."""
    flagged = D.names(m).where(F.col("name").rlike("(?i)ST|退"))
    return asof.valid_on(flagged, dates, "start_date", "end_date").select("date", F.col("ts_code").alias("symbol"))


part("membership", """
SELECT c.date, c.snapshot AS membership_date, k.symbol FROM (
  SELECT c.date, max(k.snapshot) AS snapshot FROM cutoffs c JOIN (SELECT DISTINCT snapshot FROM members) k ON k.snapshot < c.date GROUP BY c.date) c
JOIN members k ON k.snapshot = c.snapshot WHERE c.date - c.snapshot <= 62""")


@query("j11_membership_on_date", "SELECT * FROM membership", dates="date membership_date")
def membership_on_date(m):
    dates = P.month_firsts(m.sessions).select("date")
    return asof.members_on(dates, D.members(m)).select("date", "membership_date", "symbol")


@query("j12_semi_anti_pool",
       """SELECT date, symbol FROM membership k WHERE (symbol, date) IN (SELECT (symbol, date) FROM brand_bars WHERE volume > 50)
          AND (symbol, date) NOT IN (SELECT (symbol, date) FROM brand_bars WHERE close > 9000)""",
       dates="date")
def semi_anti_pool(m):
    pool = asof.members_on(P.month_firsts(m.sessions).select("date"), D.members(m)).select("date", "symbol")
    b = m.bars("p_brand")
    return (pool.join(b.where("volume > 50").select("date", "symbol"), ["date", "symbol"], "left_semi")
            .join(b.where("close > 9000").select("date", "symbol"), ["date", "symbol"], "left_anti"))


# --- events ------------------------------------------------------------------------


def guidance(m: Market) -> DataFrame:
    """Profit guidance: a range around each original, published ten days before the period ends."""
    s = D.statements(m).where("flag = 'R'").select("ts_code", "end_date", "n_income_attr_p").distinct()
    no = D.brand_number(F.col("ts_code"))
    ann = F.date_add("end_date", no - 20)
    return s.select(
        "ts_code", ann.alias("ann_date"), F.date_sub(ann, F.month("end_date") % 2).alias("first_ann_date"), "end_date",
        F.when(no > 10, "0").otherwise("1").alias("update_flag"),
        (F.col("n_income_attr_p") * (F.lit(0.6) + no / 50) / 10000).alias("net_profit_min"),
        (F.col("n_income_attr_p") * (F.lit(0.8) + no / 50) / 10000).alias("net_profit_max"))


def express(m: Market) -> DataFrame:
    s = D.statements(m).where("flag = 'R'").select("ts_code", "end_date").distinct()
    no = D.brand_number(F.col("ts_code"))
    return s.where(no <= 8).select("ts_code", "end_date", F.date_add("end_date", no * 4).alias("ann_date"))


part("guidance", """
SELECT ts_code, CAST(end_date + no - 20 AS DATE) AS ann_date, CAST(end_date + (no - 20 - month(end_date) % 2)::INT AS DATE) AS first_ann_date, end_date,
       CASE WHEN no > 10 THEN '0' ELSE '1' END AS update_flag,
       n_income_attr_p * (0.6::DOUBLE + no / 50) / 10000 AS net_profit_min, n_income_attr_p * (0.8::DOUBLE + no / 50) / 10000 AS net_profit_max
FROM (SELECT DISTINCT ts_code, end_date, n_income_attr_p, CAST(substr(ts_code, 7) AS DOUBLE)::INT AS no FROM statements WHERE flag = 'R')""")
part("express", """
SELECT ts_code, end_date, CAST(end_date + no * 4 AS DATE) AS ann_date FROM (
  SELECT DISTINCT ts_code, end_date, CAST(substr(ts_code, 7) AS INT) AS no FROM statements WHERE flag = 'R') WHERE no <= 8""")
part("disclosed", """
SELECT ts_code, end_date, available_at, lower, upper, source FROM (SELECT *, count(*) OVER (PARTITION BY ts_code, end_date, available_at) AS k FROM (
  SELECT ts_code, end_date, available_at, lower, upper, min(source) AS source FROM (
    SELECT ts_code, end_date, CAST(ann_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS available_at,
           net_profit_min * 10000 AS lower, net_profit_max * 10000 AS upper, 'guidance' AS source
    FROM guidance WHERE (update_flag = '0' OR ann_date > first_ann_date) AND net_profit_min * 10000 <= net_profit_max * 10000
    UNION ALL SELECT ts_code, end_date, available_at, n_income_attr_p, n_income_attr_p, 'initial_parent_actual' FROM income WHERE report_type IN ('1', '5'))
  WHERE lower IS NOT NULL AND upper IS NOT NULL GROUP BY ALL)) WHERE k = 1""")
part("surprise_events", """
SELECT e.*, (e.prior_available_at IS NOT NULL AND EXISTS (SELECT 1 FROM express x WHERE x.ts_code = e.ts_code AND x.end_date = e.end_date
         AND CAST(x.ann_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND BETWEEN e.prior_available_at AND e.available_at)) AS intervening,
       b.total_assets AS assets, b.available_at AS asset_available_at
FROM (SELECT *, lag(available_at) OVER w AS prior_available_at, lag(lower) OVER w AS prior_lower, lag(upper) OVER w AS prior_upper
      FROM disclosed WINDOW w AS (PARTITION BY ts_code, end_date ORDER BY available_at)) e
LEFT JOIN LATERAL (SELECT b.total_assets, b.available_at, b.end_date AS b_end FROM balance b WHERE b.ts_code = e.ts_code
    AND b.available_at < date_trunc('day', e.available_at) AND b.end_date < e.available_at ORDER BY b.end_date DESC, b.available_at DESC LIMIT 1) b
  ON CAST(e.available_at AS DATE) - b.b_end <= 550""")
part("surprises", """
SELECT *, CASE WHEN scored THEN (CASE WHEN lower > prior_upper THEN lower - prior_upper WHEN upper < prior_lower THEN upper - prior_lower ELSE 0 END) / assets END AS incremental_surprise,
       CASE WHEN prior_available_at IS NOT NULL AND intervening THEN 'intervening_express_profit_scope_not_certified'
            WHEN scored THEN 'nonoverlap_interval_gap_over_known_assets' ELSE 'no_prior_comparable_company_disclosure' END AS reason
FROM (SELECT *, prior_available_at IS NOT NULL AND NOT intervening AND coalesce(assets > 0, false) AS scored FROM surprise_events)""")


@query("j13_prior_event",
       """SELECT ts_code, end_date, available_at, source, lower, lag(available_at) OVER w AS prior_available_at, lag(upper) OVER w AS prior_upper
          FROM disclosed WINDOW w AS (PARTITION BY ts_code, end_date ORDER BY available_at)""",
       floats="lower prior_upper", dates="end_date available_at prior_available_at", digits=1)
def prior_event(m):
    e = G.with_prior_event(G.disclosure_events(guidance(m), prepared(m, "income")))
    return e.select("ts_code", "end_date", "available_at", "source", "lower", "prior_available_at", "prior_upper")


@query("j14_intervening_record", "SELECT ts_code, end_date, available_at, intervening::INT AS intervening FROM surprise_events",
       dates="end_date available_at")
def intervening_record(m):
    e = G.with_prior_event(G.disclosure_events(guidance(m), prepared(m, "income")))
    return G.with_intervening(e, express(m)).select("ts_code", "end_date", "available_at", F.col("intervening").cast("int").alias("intervening"))


@query("j15_known_balance", "SELECT ts_code, end_date, available_at, assets, asset_available_at FROM surprise_events",
       floats="assets", dates="end_date available_at asset_available_at", digits=1)
def known_balance(m):
    e = G.disclosure_events(guidance(m), prepared(m, "income"))
    return G.with_known_assets(e, prepared(m, "balance")).select("ts_code", "end_date", "available_at", "assets", "asset_available_at")


def surprises(m: Market) -> DataFrame:
    m.settle("statements", lambda: D.statements(m))  # read by income, balance, guidance and express
    return m._once("surprises", lambda: G.disclosure_surprises(
        guidance(m), express(m), prepared(m, "income"), prepared(m, "balance")))


@query("g07_disclosure_surprises",
       "SELECT ts_code AS symbol, end_date AS period, available_at, source, incremental_surprise, reason FROM surprises",
       floats="incremental_surprise", dates="period available_at")
def disclosure_surprises(m):
    return surprises(m).select("symbol", "period", "available_at", "source", "incremental_surprise", "reason")


part("recent_surprises", """
SELECT cutoff, symbol, incremental_surprise, available_at AS surprise_available_at FROM (
  SELECT c.cutoff, s.ts_code AS symbol, s.incremental_surprise, s.available_at,
         row_number() OVER (PARTITION BY c.cutoff, s.ts_code ORDER BY s.available_at DESC, s.end_date DESC) AS n
  FROM cutoffs c JOIN surprises s ON s.available_at < c.cutoff AND s.available_at >= c.cutoff - INTERVAL 90 DAY) WHERE n = 1""")


@query("g08_recent_event", "SELECT cutoff, symbol, incremental_surprise, surprise_available_at FROM recent_surprises",
       floats="incremental_surprise", dates="cutoff surprise_available_at")
def recent_event(m):
    return G.recent_events(surprises(m), cutoffs(m))


LISTED = "CAST(DATE '1995-01-01' + CAST(floor({0} / 10) AS INT) AS DATE)"


@query("j16_sibling_fill",
       f"""SELECT c_custkey, coalesce(segment, CASE WHEN same THEN s_name END) AS segment, greatest(l, CASE WHEN same THEN k END) AS effective_list_date,
           (coalesce(same, false) AND l <> k)::INT AS listing_date_conflict
           FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment, {LISTED.format('c_acctbal')} AS l, s_name, {LISTED.format('s_acctbal')} AS k,
                 c_nationkey = s_nationkey AS same FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey)""",
       dates="effective_list_date")
def sibling_fill(m):
    """Missing fields come from the sibling record with the same code, if the nations agree."""
    from marketframe.sources.vendor import fill_from_sibling

    def listed(balance):
        return F.date_add(F.lit("1995-01-01").cast("date"), F.floor(F.col(balance) / 10).cast("int"))

    own = m.table("customer").select(
        F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("nation"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), listed("c_acctbal").alias("list_date"))
    other = m.table("supplier").select(
        F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("segment"),
        listed("s_acctbal").alias("list_date"))
    return fill_from_sibling(own, other, "code", "nation", ["segment"], "list_date").select(
        F.col("code").alias("c_custkey"), "segment", "effective_list_date", F.col("listing_date_conflict").cast("int").alias("listing_date_conflict"))


# --- versions of one fact ----------------------------------------------------------


@query("a05_keep_last_first",
       """SELECT user_id, event_type, max(event_id) AS last_id, arg_max(value, event_id) AS last_value, min(event_id) AS first_id
          FROM events GROUP BY user_id, event_type""", floats="last_value")
def keep_last_first(m):
    e = m.table("events").select("user_id", "event_type", "event_id", "value")
    last = dedup.keep_last(e, ["user_id", "event_type"], ["event_id"]).withColumnsRenamed({"event_id": "last_id", "value": "last_value"})
    first = dedup.keep_first(e, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", F.col("event_id").alias("first_id"))
    return last.join(first, ["user_id", "event_type"])


@query("a06_conflict_removal", f"SELECT {STMT}, revenue, basic_eps FROM income",
       floats="revenue basic_eps", dates="end_date available_at")
def conflict_removal(m):
    return prepared(m, "income").select("ts_code", "end_date", "available_at", "revenue", "basic_eps")


@query("g01_prepared_statements",
       f"SELECT {STMT}, total_assets, goodwill, comp_type FROM balance UNION ALL SELECT {STMT}, n_cashflow_act, net_profit, comp_type FROM cashflow",
       floats="total_assets goodwill", dates="end_date available_at", digits=1)
def prepared_statements(m):
    b = prepared(m, "balance").select("ts_code", "end_date", "available_at", "total_assets", "goodwill", "comp_type")
    c = prepared(m, "cashflow").select("ts_code", "end_date", "available_at", F.col("n_cashflow_act").alias("total_assets"),
                                       F.col("net_profit").alias("goodwill"), "comp_type")
    return b.unionByName(c)


@query("g02_prepared_estimates", "SELECT ts_code, org_name, quarter, reported_at, available_at, np_cny FROM analysts",
       floats="np_cny", dates="reported_at available_at", digits=1)
def prepared_estimates(m):
    return estimates(m).select("ts_code", "org_name", "quarter", "reported_at", "available_at", "np_cny")
