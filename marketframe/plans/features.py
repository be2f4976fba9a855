"""Panel features: filters, projections and rolling statistics per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.ranks import percent_rank_average
from marketframe.functions.timeseries import (
    by_symbol,
    change,
    clip,
    delta,
    divide,
    finite,
    flag,
    forward_fill,
    forward_fill_limited,
    holds,
    ref,
    rolling,
    rolling_count,
    rolling_max,
    rolling_mean,
    rolling_percent_rank,
    rolling_std,
    rolling_sum,
    running,
    ts_mean,
    ts_std,
)
from marketframe.operators import panel as P
from marketframe.plans.registry import frame, lag, query, roll
from marketframe.sources.market import Market

BASE = "symbol, date"
ROOT252 = "sqrt(252.0)"


@query(
    "monthly_leaders",
    f"""
    SELECT date, symbol, score, rank FROM (
      SELECT date, symbol, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank,
             count(*) OVER (PARTITION BY date) AS n
      FROM (
        SELECT symbol, date, eligible,
               (rank() OVER (PARTITION BY date ORDER BY raw) + (count(*) OVER (PARTITION BY date, raw) - 1) / 2.0)
               / count(*) OVER (PARTITION BY date) AS score
        FROM (
          SELECT *, ret63 / vol63 AS raw FROM (
            SELECT symbol, date, session_no, marked / {lag('marked', 63)} - 1 AS ret63,
                   {roll('stddev_samp', 'ret', 63)} AS vol63,
                   close IS NOT NULL AND count(close) OVER {frame()} >= 60 AND volume > 0
                     AND {roll('avg', 'amount', 20, 5)} >= 20000 AS eligible
            FROM brand_marked)
          WHERE eligible AND ret63 IS NOT NULL AND vol63 > 0
            AND date IN (SELECT min(date) FROM sessions GROUP BY date_trunc('month', date))
        )
      )
    ) WHERE n >= 5 AND rank <= 5""",
    floats="score",
    dates="date",
)
def monthly_leaders(m: Market) -> DataFrame:
    """Flagship: scan, join, aggregate, panel, windows, cross-section rank, top five."""
    panel = P.mark_prices(m.adjusted("p_brand"))
    eligible = (
        F.col("close").isNotNull()
        & (running(F.count, F.col("close")) >= 60)
        & holds(F.col("volume") > 0)
        & holds(rolling_mean(F.col("amount"), 20, 5) >= 20000)
    )
    scored = panel.select(
        "symbol", "date",
        change(F.col("marked"), 63).alias("ret63"),
        rolling_std(F.col("ret"), 63).alias("vol63"),
        eligible.alias("eligible"),
    )
    decisions = P.month_firsts(m.sessions).select("date")
    usable = (
        scored.where(F.col("eligible") & F.col("ret63").isNotNull() & (F.col("vol63") > 0))
        .join(decisions, "date", "left_semi")
        .withColumn("raw", divide(F.col("ret63"), F.col("vol63")))
        .withColumn("score", percent_rank_average(F.col("raw"), "date"))
    )
    best = Window.partitionBy("date").orderBy(F.desc("score"), "symbol")
    return (
        usable.withColumn("rank", F.row_number().over(best))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date")))
        .where("n >= 5 AND rank <= 5")
        .select("date", "symbol", "score", "rank")
    )


@query("p01_adjusted_ohlc", "SELECT symbol, date, open, high, low, close FROM brand_adjusted WHERE close IS NOT NULL",
       floats="open high low close", dates="date", digits=4)
def adjusted_ohlc(m):
    return P.rebase_to_first_factor(m.bars("p_brand")).select("symbol", "date", "open", "high", "low", "close")


@query("p02_adjusted_price", "SELECT symbol, date, close * adj_factor AS price FROM brand_bars",
       floats="price", dates="date", digits=4)
def adjusted_price(m):
    return m.bars("p_brand").select("symbol", "date", (F.col("close") * F.col("adj_factor")).alias("price"))


@query(
    "p03_rolling_statistics",
    f"""SELECT {BASE}, {roll('avg', 'close', 20)} AS mean20, {roll('avg', 'close', 20, 12)} AS mean20_loose,
        {roll('stddev_samp', 'close', 60, 30)} AS std60, {roll('sum', 'amount', 20, 1)} AS sum20,
        {roll('max', 'close', 126, 60)} AS max126, count(close) OVER {frame(126)} AS count126 FROM brand_panel""",
    floats="mean20 mean20_loose std60 sum20 max126", dates="date", digits=4)
def rolling_statistics(m):
    c = F.col("close")
    return m.panel("p_brand").select(
        "symbol", "date",
        rolling_mean(c, 20).alias("mean20"),
        rolling_mean(c, 20, 12).alias("mean20_loose"),
        rolling_std(c, 60, 30).alias("std60"),
        rolling_sum(F.col("amount"), 20, 1).alias("sum20"),
        rolling_max(c, 126, 60).alias("max126"),
        rolling_count(c, 126).alias("count126"),
    )


@query(
    "p04_lag_lead_change",
    f"""SELECT {BASE}, {lag('close', 1)} AS previous, lead(close, 21) OVER (PARTITION BY symbol ORDER BY date) AS ahead21,
        close / {lag('close', 5)} - 1 AS change5 FROM brand_panel""",
    floats="previous ahead21 change5", dates="date")
def lag_lead_change(m):
    c = F.col("close")
    return m.panel("p_brand").select(
        "symbol", "date", F.lag(c).over(by_symbol()).alias("previous"),
        F.lead(c, 21).over(by_symbol()).alias("ahead21"), change(c, 5).alias("change5"))


@query("p05_valuation_fill",
       f"SELECT {BASE}, last_value(close IGNORE NULLS) OVER {frame()} AS marked FROM brand_panel",
       floats="marked", dates="date", digits=4)
def valuation_fill(m):
    return m.panel("p_brand").select("symbol", "date", forward_fill(F.col("close")).alias("marked"))


@query(
    "p06_limited_fill",
    """SELECT p.symbol, p.date, CASE WHEN p.session_no - k.session_no <= 3 THEN k.close END AS filled
       FROM brand_panel p ASOF LEFT JOIN (SELECT * FROM brand_panel WHERE close IS NOT NULL) k
       ON p.symbol = k.symbol AND p.session_no >= k.session_no""",
    floats="filled", dates="date", digits=4)
def limited_fill(m):
    return m.panel("p_brand").select("symbol", "date", forward_fill_limited(F.col("close"), 3).alias("filled"))


@query(
    "p07_momentum",
    f"SELECT {BASE}, " + ", ".join(f"marked / {lag('marked', k)} - 1 AS mom{k}" for k in (21, 63, 126, 252))
    + " FROM brand_marked",
    floats="mom21 mom63 mom126 mom252", dates="date")
def momentum(m):
    p = P.mark_prices(m.adjusted("p_brand"))
    return p.select("symbol", "date", *[change(F.col("marked"), k).alias(f"mom{k}") for k in (21, 63, 126, 252)])


@query(
    "p08_skip_momentum",
    f"""SELECT {BASE}, (p21 / {lag('price', 126)} - 1 + p21 / {lag('price', 252)} - 1) / 2 AS stock_momentum,
        0.5 * (m21 / {lag('marked', 147)} - 1) + 0.5 * (m21 / {lag('marked', 273)} - 1) AS fund_momentum,
        m5 / {lag('marked', 68)} - 1 AS skip5_63
        FROM (SELECT *, {lag('price', 21)} AS p21, {lag('marked', 21)} AS m21, {lag('marked', 5)} AS m5
              FROM (SELECT *, close * adj_factor AS price FROM brand_marked))""",
    floats="stock_momentum fund_momentum skip5_63", dates="date")
def skip_momentum(m):
    p = P.mark_prices(m.adjusted("p_brand")).withColumn("price", F.col("close") * F.col("adj_factor"))
    return p.select(
        "symbol", "date",
        P.skip_momentum(F.col("price"), 21, (126, 252)).alias("stock_momentum"),
        P.skip_momentum(F.col("marked"), 21, (147, 273)).alias("fund_momentum"),
        P.skip_momentum(F.col("marked"), 5, (68,)).alias("skip5_63"))


@query("p09_trend_distance",
       f"SELECT {BASE}, marked / ({roll('avg', 'marked', 60)}) - 1 AS trend60, marked / ({roll('avg', 'marked', 200)}) - 1 AS trend200 FROM brand_marked",
       floats="trend60 trend200", dates="date")
def trend_distance(m):
    p = P.mark_prices(m.adjusted("p_brand"))
    c = F.col("marked")
    return p.select("symbol", "date", P.trend_distance(c, 60).alias("trend60"), P.trend_distance(c, 200).alias("trend200"))


@query("p10_trend_vote",
       f"""SELECT {BASE}, (coalesce(close >= ({roll('avg', 'close', 5)}), false)::INT
           + coalesce(close >= ({roll('avg', 'close', 10)}), false)::INT) / 2.0 AS vote FROM type_adjusted""",
       floats="vote", dates="date")
def trend_vote(m):
    return m.adjusted("p_type").select("symbol", "date", P.trend_vote(F.col("close"), (5, 10)).alias("vote"))


@query("p11_annual_volatility",
       f"SELECT {BASE}, ({roll('stddev_samp', 'ret', 60)}) * {ROOT252} AS vol60, ({roll('stddev_samp', 'ret', 126, 100)}) * {ROOT252} AS vol126 FROM brand_marked",
       floats="vol60 vol126", dates="date", digits=5)
def annual_volatility(m):
    p = P.mark_prices(m.adjusted("p_brand"))
    r = F.col("ret")
    return p.select("symbol", "date", (rolling_std(r, 60) * 252**0.5).alias("vol60"),
                    (rolling_std(r, 126, 100) * 252**0.5).alias("vol126"))


@query(
    "p12_p14_risk_features",
    f"""SELECT {BASE}, sqrt({roll('avg', 'loss2', 60)}) * {ROOT252} AS downside,
        abs(marked - {lag('marked', 63)}) / ({roll('sum', 'move', 63)}) AS efficiency,
        marked / ({roll('max', 'marked', 126)}) - 1 AS drawdown
        FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0), 2) END AS loss2 FROM brand_marked)""",
    floats="downside efficiency drawdown", dates="date")
def risk_features(m):
    """Downside volatility, trend efficiency and drawdown from the rolling high."""
    f = P.rotation_features(m.adjusted("p_brand"), 253, 1e7)
    return f.select("symbol", "date", "downside", "efficiency", "drawdown")


@query("p15_amount_balance",
       f"""SELECT {BASE}, ({roll('sum', 'signed', 20)}) / ({roll('sum', 'amount', 20)}) AS balance
           FROM (SELECT *, sign(ret) * amount AS signed FROM type_marked)""",
       floats="balance", dates="date")
def amount_balance(m):
    p = P.mark_prices(m.adjusted("p_type")).withColumn("signed", F.signum("ret") * F.col("amount"))
    return p.select("symbol", "date", divide(rolling_sum(F.col("signed"), 20), rolling_sum(F.col("amount"), 20)).alias("balance"))


SHARES = f"""
  SELECT symbol, date, session_no, close, amount, ret, move, marked,
         CASE WHEN session_no - seen_no <= 3 THEN seen END AS share
  FROM (SELECT p.*, s.session_no AS seen_no, s.total_share AS seen
        FROM type_marked p ASOF LEFT JOIN (
          SELECT symbol, session_no, 100 + sum(volume) OVER {frame()} / 10 AS total_share FROM type_panel WHERE close IS NOT NULL) s
        ON p.symbol = s.symbol AND p.session_no >= s.session_no)"""

FLOW = f"""
  SELECT *, lag(raw20) OVER w AS lagged, coalesce(lag(jump21) OVER w, 0) AS jumped FROM (
    SELECT *, ls - {lag('ls', 20)} AS raw20, max(jump) OVER {frame(21)} AS jump21 FROM (
      SELECT *, (coalesce(abs(ls - {lag('ls', 1)}) > 0.30, false))::INT AS jump
      FROM (SELECT *, ln(share) AS ls FROM ({SHARES}))))
  WINDOW w AS (PARTITION BY symbol ORDER BY date)"""


@query("p16_share_flow", f"SELECT {BASE}, CASE WHEN jumped = 0 THEN lagged END AS flow20 FROM ({FLOW})",
       floats="flow20", dates="date")
def share_flow(m):
    from marketframe.operators.guards import share_flow_20

    return share_flow_20(fund_shares(m)).select("symbol", "date", "flow20")


def fund_shares(m: Market) -> DataFrame:
    """Marked fund panel with a share count observed on sessions that have a bar."""
    seen = m.bars("p_type").select(
        "symbol", "date", (100 + running(F.sum, F.col("volume")) / 10).alias("total_share"))
    return P.mark_prices(m.adjusted("p_type")).join(seen, ["symbol", "date"], "left")


@query(
    "p17_bounded_multipliers",
    f"""SELECT {BASE}, greatest(0.75, least(1, coalesce(trend, 1))) AS trend_quality,
        greatest(0.75, least(1, CASE WHEN dd IS NULL THEN 1 ELSE 1 - 0.25 * greatest(0, least(1, (-dd - 0.05) / 0.15)) END)) AS downside_guard,
        greatest(0.75, least(1, CASE WHEN balance IS NULL THEN 1 ELSE 1 - 0.25 * greatest(0, least(1, -balance)) END)) AS volume_confirmation,
        greatest(0.75, least(1, coalesce(flow, 1))) AS share_flow,
        greatest(0.75, least(1, (coalesce(trend, 1) + coalesce(flow, 1)) / 2)) AS trend_and_flow
        FROM (SELECT *, CASE WHEN mom IS NOT NULL AND vol > 0 AND eff IS NOT NULL THEN 1 - 0.25 * tanh(greatest(0, -mom / (vol * sqrt(63 / 252.0))) * least(1, eff)) END AS trend
          FROM (SELECT {BASE}, CASE WHEN jumped = 0 AND lagged IS NOT NULL THEN 1 - 0.25 * greatest(0, least(1, -lagged / 0.10)) END AS flow,
             ({roll('stddev_samp', 'ret', 63)}) * {ROOT252} AS vol, close / {lag('close', 63)} - 1 AS mom,
             abs(close - {lag('close', 63)}) / ({roll('sum', 'raw_move', 63)}) AS eff,
             close / ({roll('max', 'close', 126)}) - 1 AS dd,
             ({roll('sum', 'signed', 20)}) / ({roll('sum', 'amount', 20)}) AS balance
           FROM (SELECT *, abs(close - {lag('close', 1)}) AS raw_move, sign(ret) * amount AS signed FROM ({FLOW}))))""",
    floats="trend_quality downside_guard volume_confirmation share_flow trend_and_flow", dates="date")
def bounded_multipliers(m):
    from marketframe.operators.guards import factor_multipliers

    return factor_multipliers(fund_shares(m)).select(
        "symbol", "date", "trend_quality", "downside_guard", "volume_confirmation", "share_flow", "trend_and_flow")


@query(
    "p18_eligibility",
    f"""SELECT {BASE},
        (close IS NOT NULL AND count(close) OVER {frame()} >= 240 AND coalesce(({roll('avg', 'amount', 20)}) >= 200000, false) AND coalesce(volume > 0, false))::INT AS fixed,
        (coalesce(count(close * adj_factor) OVER {frame(270)} >= 253, false) AND coalesce(({roll('avg', 'amount', 20, 15)}) >= 200000, false)
          AND coalesce(volume > 0, false) AND close IS NOT NULL AND coalesce(close * 100 <= 250000, false))::INT AS stock,
        (close IS NOT NULL AND count(close) OVER {frame()} >= 127 AND coalesce(CASE WHEN session_no >= 126 THEN count(close) OVER {frame(126)} END >= 120, false)
          AND coalesce(({roll('avg', 'amount', 20)}) >= 200000, false) AND coalesce(volume > 0, false))::INT AS sector
        FROM type_panel""",
    dates="date")
def eligibility(m):
    return m.panel("p_type").select(
        "symbol", "date",
        P.fixed_eligibility(240, 200000).cast("int").alias("fixed"),
        P.stock_eligibility(250000, 200000).cast("int").alias("stock"),
        P.sector_eligibility(127, 200000).cast("int").alias("sector"))


LISTING = """SELECT symbol, min(date) + INTERVAL 60 DAY AS listing,
      CASE WHEN symbol IN ('Brand#3', 'Brand#7') THEN max(date) - INTERVAL 400 DAY END AS delisting FROM brand_bars GROUP BY symbol"""


def listings(m: Market) -> DataFrame:
    """Listing and delisting dates of the brands; two brands are delisted early."""
    span = m.bars("p_brand").groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.select(
        "symbol", F.date_add("a", 60).alias("listing"),
        F.when(F.col("symbol").isin("Brand#3", "Brand#7"), F.date_sub("b", 400)).alias("delisting"))


@query("p19_listing_mask",
       f"""SELECT p.symbol, p.date, (p.date >= listing AND (delisting IS NULL OR p.date < delisting))::INT AS listed
           FROM brand_panel p JOIN ({LISTING}) l USING (symbol)""",
       dates="date")
def listing_mask(m):
    p = m.panel("p_brand").join(listings(m), "symbol")
    return p.select("symbol", "date", P.listed_on(F.col("date"), F.col("listing"), F.col("delisting")).cast("int").alias("listed"))


@query("p20_affordable_board",
       "SELECT symbol, date, close FROM brand_bars WHERE close * 100 <= 150000 AND (starts_with(symbol, 'Brand#1') OR starts_with(symbol, 'Brand#2'))",
       floats="close", dates="date", digits=4)
def affordable_board(m):
    s = F.col("symbol")
    return m.bars("p_brand").where(
        (F.col("close") * 100 <= 150000) & (s.startswith("Brand#1") | s.startswith("Brand#2"))
    ).select("symbol", "date", "close")


OWN = """SELECT b.symbol, b.date, b.open * b.adj_factor / f.f0 AS open, b.close * b.adj_factor / f.f0 AS close
  FROM brand_bars b JOIN (SELECT symbol, arg_min(adj_factor, date) AS f0 FROM brand_bars GROUP BY symbol) f USING (symbol)"""


@query("p21_factor_vocabulary",
       f"""SELECT {BASE}, {lag('close', 60)} AS ref60, close - {lag('close', 5)} AS delta5,
           {roll('avg', 'close', 10)} AS mean10, {roll('stddev_samp', 'close', 10)} AS std10 FROM ({OWN})""",
       floats="ref60 delta5 mean10 std10", dates="date", digits=4)
def factor_vocabulary(m):
    own = P.rebase_to_first_factor(m.bars("p_brand"))
    c = F.col("close")
    return own.select("symbol", "date", ref(c, 60).alias("ref60"), delta(c, 5).alias("delta5"),
                      ts_mean(c, 10).alias("mean10"), ts_std(c, 10).alias("std10"))


DEFAULT_FACTORS = f"""SELECT {BASE}, close / {lag('close', 60)} - 1 AS momentum_60, close / {lag('close', 120)} - 1 AS momentum_120,
  close / ({roll('avg', 'close', 120)}) - 1 AS trend_120, {roll('stddev_samp', 'r', 60)} AS volatility_60,
  1 - close / {lag('close', 20)} AS reversal_20 FROM (SELECT *, close / {lag('close', 1)} - 1 AS r FROM ({OWN}))"""


def default_factors(bars: DataFrame) -> DataFrame:
    """The five default factors on each symbol's own rows."""
    c = F.col("close")
    own = P.rebase_to_first_factor(bars).withColumn("r", divide(c, ref(c, 1)) - 1)
    return own.select(
        "symbol", "date",
        (divide(c, ref(c, 60)) - 1).alias("momentum_60"),
        (divide(c, ref(c, 120)) - 1).alias("momentum_120"),
        (divide(c, ts_mean(c, 120)) - 1).alias("trend_120"),
        ts_std(F.col("r"), 60).alias("volatility_60"),
        (1 - divide(c, ref(c, 20))).alias("reversal_20"))


@query("p22_default_factors", DEFAULT_FACTORS,
       floats="momentum_60 momentum_120 trend_120 volatility_60 reversal_20", dates="date")
def default_factor_query(m):
    return default_factors(m.bars("p_brand"))


@query("p23_finite_only",
       """SELECT symbol, date, CASE WHEN high <> low THEN (close - low) / (high - low) END AS position,
          ln(CASE WHEN high > low THEN high - low END) AS log_range FROM brand_bars""",
       floats="position log_range", dates="date")
def finite_only(m):
    """Quotients and logarithms at a locked bar are missing, never infinite."""
    spread = F.col("high") - F.col("low")
    return m.bars("p_brand").select(
        "symbol", "date", divide(F.col("close") - F.col("low"), spread).alias("position"),
        finite(F.when(spread > 0, F.ln(spread))).alias("log_range"))


@query("p30_decision_dates",
       """SELECT date, (wk IS DISTINCT FROM lag(wk) OVER (ORDER BY date))::INT AS week_first,
          (mo IS DISTINCT FROM lag(mo) OVER (ORDER BY date))::INT AS month_first,
          (dayofweek(date) = 5 AND day(date) <= 7)::INT AS first_friday, (dayofweek(date) = 5)::INT AS friday
          FROM (SELECT date, date_trunc('week', date) AS wk, date_trunc('month', date) AS mo FROM sessions)""",
       dates="date")
def decision_dates(m):
    week = P.first_of("week", m.sessions).select("date", F.col("decision").cast("int").alias("week_first"))
    month = P.first_of("month", m.sessions).select("date", F.col("decision").cast("int").alias("month_first"))
    friday = F.dayofweek("date") == 6
    return week.join(month, "date").select(
        "*", (friday & (F.dayofmonth("date") <= 7)).cast("int").alias("first_friday"), friday.cast("int").alias("friday"))


@query("p31_month_firsts", "SELECT min(date) AS date, min(session_no) AS session_no FROM sessions GROUP BY date_trunc('month', date)",
       dates="date")
def month_first_sessions(m):
    return P.month_firsts(m.sessions).select("date", "session_no")


@query("p32_sessions_around_cutoff",
       """SELECT c.cutoff, (SELECT max(cal_date) FROM calendar k WHERE is_open = 1 AND k.cal_date <= c.day) AS signal_date,
          (SELECT min(cal_date) FROM calendar k WHERE is_open = 1 AND k.cal_date > c.day) AS execution_date
          FROM (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS cutoff,
                strftime(CASE WHEN hour(ts) >= 18 THEN ts ELSE ts - INTERVAL 1 DAY END, '%Y%m%d') AS day
                FROM (SELECT max(o_orderdate) - INTERVAL 30 DAY + INTERVAL 19 HOUR AS ts FROM orders
                      UNION ALL SELECT max(o_orderdate) - INTERVAL 30 DAY + INTERVAL 9 HOUR FROM orders)) c""")
def sessions_around_cutoff(m):
    """Before 18:00 the previous day counts as the last complete one."""
    last = m.table("orders").agg(F.max("o_orderdate").alias("t"))
    at = last.select(F.explode(F.array(*[
        (F.col("t") - F.expr("INTERVAL 30 DAY") + F.expr(f"INTERVAL {h} HOUR")) for h in (19, 9)])).alias("ts"))
    day = F.when(F.hour("ts") >= 18, F.col("ts")).otherwise(F.col("ts") - F.expr("INTERVAL 1 DAY"))
    cut = at.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("cutoff"), F.date_format(day, "yyyyMMdd").alias("day"))
    return P.sessions_around(m.calendar, cut)


@query("p33_freeze_mask",
       f"""SELECT d.date, (d.decision AND h.healthy)::INT AS plan FROM
           (SELECT date, row_number() OVER (ORDER BY date) = 1 OR date_trunc('month', date) <> date_trunc('month', lag(date) OVER (ORDER BY date)) AS decision,
            FROM sessions) d
           JOIN (SELECT date, close IS NOT NULL AND ({roll('avg', 'amount', 20)}) IS NOT NULL AS healthy FROM type_panel WHERE symbol = 'SMALL') h USING (date)
           WHERE d.date > (SELECT min(date) FROM (SELECT date, close IS NOT NULL AND ({roll('avg', 'amount', 20)}) IS NOT NULL AS healthy FROM type_panel WHERE symbol = 'SMALL') WHERE healthy)
           UNION ALL
           SELECT date, (date = first)::INT FROM (SELECT date, (SELECT min(date) FROM (SELECT date, close IS NOT NULL AND ({roll('avg', 'amount', 20)}) IS NOT NULL AS healthy FROM type_panel WHERE symbol = 'SMALL') WHERE healthy) AS first FROM sessions)
           WHERE date <= first""",
       dates="date")
def freeze_mask(m):
    bond = m.panel("p_type").where("symbol = 'SMALL'")
    return P.freeze_mask(bond, m.sessions)


@query("p34_log_cap",
       "SELECT symbol, date, CASE WHEN amount > 0 THEN ln(amount * 10000) END AS log_cap, volume * 100 AS shares, amount * 1000 AS turnover FROM brand_bars",
       floats="log_cap shares turnover", dates="date", digits=4)
def log_cap(m):
    a = F.col("amount")
    return m.bars("p_brand").select("symbol", "date", F.when(a > 0, F.ln(a * 10000)).alias("log_cap"),
                                    (F.col("volume") * 100).alias("shares"), (a * 1000).alias("turnover"))


@query("p35_normalized_curves",
       "SELECT strategy_id, date, equity / first_value(equity) OVER (PARTITION BY strategy_id ORDER BY date) AS curve FROM nav WHERE date >= DATE '1997-01-01'",
       floats="curve", dates="date")
def normalized_curves(m):
    from marketframe.operators.metrics import normalized

    return normalized(m.nav().where(F.col("date") >= F.lit("1997-01-01").cast("date"))).select("strategy_id", "date", "curve")


@query("p36_wide_to_long",
       f"""UNPIVOT (SELECT {BASE}, marked / {lag('marked', 21)} - 1 AS mom21, marked / {lag('marked', 63)} - 1 AS mom63, ({roll('stddev_samp', 'ret', 60)}) * {ROOT252} AS vol60
           FROM type_marked) ON mom21, mom63, vol60 INTO NAME field VALUE value""",
       floats="value", dates="date", digits=5)
def wide_to_long(m):
    f = P.rotation_features(m.adjusted("p_type"), 240, 0)
    return (f.select("symbol", "date", "mom21", "mom63", F.col("vol").alias("vol60"))
            .unpivot(["symbol", "date"], ["mom21", "mom63", "vol60"], "field", "value").where("value IS NOT NULL"))


@query("p37_filter_and_names",
       """SELECT n.title, n_bars, total FROM (SELECT symbol, count(*) AS n_bars, sum(CAST(amount AS DECIMAL(18,2)))::DOUBLE AS total
          FROM type_bars WHERE symbol IN ('PROMO', 'LARGE', 'SMALL') AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY symbol) b
          JOIN (VALUES ('PROMO', 'Promotion'), ('LARGE', 'Large lots'), ('SMALL', 'Small lots')) n(symbol, title) USING (symbol)""",
       floats="total", digits=2)
def filter_and_names(m):
    names = F.create_map(*[F.lit(x) for pair in (("PROMO", "Promotion"), ("LARGE", "Large lots"), ("SMALL", "Small lots")) for x in pair])
    d = F.col("date")
    chosen = m.bars("p_type").where(
        F.col("symbol").isin("PROMO", "LARGE", "SMALL")
        & d.between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    return (chosen.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"),
                                         F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))
            .select(names[F.col("symbol")].alias("title"), "n_bars", "total"))
