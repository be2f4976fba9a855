"""Accounting queries over fills and corporate events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.operators import accounting as L, dedup, metrics, selection
from marketframe.operators.panel import complete_panel
from marketframe.plans.performance import WINDOWS
from marketframe.plans.registry import frame, part, query
from marketframe.sources.market import Market, merged, priced, traded

CASH0 = 1e9
# Five accounts hold all fills (one per order priority): every account is a hot key.
part("fills", """
SELECT o_orderpriority AS account, p_type AS symbol, t.date, CASE WHEN l_linenumber = 7 THEN t.date ELSE p.date END AS signal_date,
       CASE WHEN l_returnflag = 'A' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price,
       l_extendedprice AS notional, greatest(5.0::DOUBLE, abs(l_extendedprice) * 1.5 / 10000) AS commission, l_extendedprice * 0.0005::DOUBLE AS slippage_cost
FROM trades t JOIN sessions s ON s.date = t.date LEFT JOIN sessions p ON p.session_no = s.session_no - 1""")
part("flows", """
SELECT account, symbol, date, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS quantity,
       sum(CASE WHEN side = 'BUY' THEN -notional ELSE notional END - commission) AS cash FROM fills GROUP BY ALL""")
part("book", f"""
SELECT g.account, g.symbol, g.date, g.session_no, coalesce(f.quantity, 0) AS quantity, coalesce(f.cash, 0) AS cash, m.mark, m.factor
FROM (SELECT account, symbol, date, session_no FROM (SELECT DISTINCT account, symbol FROM flows), sessions) g
LEFT JOIN flows f ON f.account = g.account AND f.symbol = g.symbol AND f.date = g.date
JOIN (SELECT symbol, date, last_value(close IGNORE NULLS) OVER {frame()} AS mark, last_value(adj_factor IGNORE NULLS) OVER {frame()} AS factor FROM type_panel) m
  ON m.symbol = g.symbol AND m.date = g.date""")
part("account_nav", f"""
SELECT account, date, {CASH0} + sum(flow) OVER (PARTITION BY account ORDER BY date) AS cash, {CASH0} + sum(flow) OVER (PARTITION BY account ORDER BY date) + holdings AS equity
FROM (SELECT account, date, sum(units * coalesce(mark, 0)) AS holdings, sum(cash) AS flow FROM (
  SELECT *, sum(quantity) OVER (PARTITION BY account, symbol ORDER BY date) AS units FROM book) GROUP BY account, date)""")


def booked() -> dict[str, Column]:
    """What a trade means to its account."""
    n = F.col("l_extendedprice")
    return {"account": F.col("o_orderpriority"), "symbol": F.col("p_type"), "side": F.when(F.col("l_returnflag") == "A", "SELL").otherwise("BUY"),
            "quantity": F.col("l_quantity"), "notional": n, "commission": L.fee(n, 1.5, 5.0)}


def fills(m: Market) -> DataFrame:
    def build():
        w = Window.orderBy("date")
        before = m.sessions.select("date", F.lag("date").over(w).alias("_before"))
        n = F.col("l_extendedprice")
        return m.trades.join(F.broadcast(before), "date").withColumns(booked()).select(  # the calendar: at most 366 rows a year
            "account", "symbol", "date", F.when(F.col("l_linenumber") == 7, F.col("date")).otherwise(F.col("_before")).alias("signal_date"),
            "side", "quantity", (n / F.col("l_quantity")).alias("price"), "notional", "commission", (n * 0.0005).alias("slippage_cost"))

    return m._once("fills", build)


def nav(m: Market) -> DataFrame:
    return m._once("account_nav", lambda: L.account_nav(fills(m), m.panel("p_type"), m.sessions, CASH0))


@query("l01_account_nav", "SELECT account, date, cash, equity FROM account_nav", floats="cash equity", dates="date", digits=2)
def account_nav(m):
    return nav(m).select("account", "date", "cash", "equity")


@query("l02_reinvested_units",
       """SELECT account, symbol, date, CASE WHEN abs(u) < 1e-9 THEN 0 ELSE u END AS units FROM (
          SELECT account, symbol, date, factor * sum(CASE WHEN quantity <> 0 THEN quantity / factor ELSE 0 END) OVER (PARTITION BY account, symbol ORDER BY date) AS u FROM book)""",
       floats="units", dates="date")
def reinvested_units(m):
    return L.reinvested_units(fills(m), m.panel("p_type"), m.sessions)


@query("l03_cash_interest",
       f"""SELECT account, date, g * ({CASH0} + sum(flow / g) OVER (PARTITION BY account ORDER BY date)) AS cash FROM (
           SELECT account, date, sum(cash) AS flow, pow(1.02, (date - (SELECT min(date) FROM sessions)) / 365.25) AS g FROM book GROUP BY account, date)""",
       floats="cash", dates="date", digits=1)
def cash_interest(m):
    return L.account_nav(fills(m), m.panel("p_type"), m.sessions, CASH0, cash_rate=0.02, reinvest=True).select("account", "date", "cash")


@query("l04_fill_audit",
       """SELECT account, fault, count(*) AS n FROM (SELECT account, unnest(['not_next_session', 'no_open_market', 'price', 'commission', 'odd_lot', 'above_volume_cap']) AS fault,
            unnest([NOT coalesce(b.session_no = a.session_no + 1, false), NOT coalesce(k.volume > 0 AND k.high <> k.low, false), NOT coalesce(abs(f.price - k.open * (1 + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * 5.0 / 10000)) < 1e-8, false),
              abs(f.commission - greatest(5.0, f.notional * 1.5 / 10000)) >= 1e-8, side = 'BUY' AND f.quantity % 10 <> 0, NOT coalesce(f.quantity <= k.volume * 0.5 + 1e-8, false)]) AS broken
          FROM fills f LEFT JOIN sessions a ON a.date = f.signal_date LEFT JOIN sessions b ON b.date = f.date LEFT JOIN type_bars k ON k.symbol = f.symbol AND k.date = f.date)
          WHERE broken GROUP BY account, fault""")
def fill_audit(m):
    bad = L.fill_faults(fills(m), m.bars("p_type"), m.sessions, bps=1.5, minimum=5.0, slippage_bps=5.0, lot=10, participation=0.5)
    return bad.select("account", F.explode("faults").alias("fault")).groupBy("account", "fault").agg(F.count(F.lit(1)).alias("n"))


@query("l05_fees_on_fills",
       """SELECT account, side, count(*) AS n, sum(commission) AS commission, sum(CASE WHEN side = 'SELL' THEN notional * 0.001 ELSE 0 END) AS stamp_tax, sum(notional * 0.0000255) AS transfer_fee FROM fills GROUP BY account, side""",
       floats="commission stamp_tax transfer_fee", digits=2)
def fees_on_fills(m):
    from marketframe.functions import scalar

    f, n, s, d = fills(m), F.col("notional"), F.col("side"), F.col("date")
    taxed = f.withColumns({"stamp": scalar.stamp_tax(n, s, d), "transfer": scalar.transfer_fee(n, F.col("quantity"), F.col("symbol"), d)})
    return taxed.groupBy("account", "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("commission").alias("commission"), F.sum("stamp").alias("stamp_tax"), F.sum("transfer").alias("transfer_fee"))


# --- dividends -----------------------------------------------------------------------------

part("dividends_raw", """
SELECT symbol, ex_date, CAST(ex_date - CASE flag WHEN 'R' THEN 30 ELSE 10 END AS DATE) AS ann_date, CAST(ex_date - 1 AS DATE) AS record_date,
       CAST(ex_date + CASE flag WHEN 'R' THEN 20 ELSE 25 END AS DATE) AS pay_date, CAST(ex_date + 15 AS DATE) AS div_listdate,
       CASE WHEN flag = 'A' AND y IN (1996, 1998, 2000) THEN NULL ELSE d / n END AS cash_div_tax, CASE WHEN flag <> 'N' THEN t / n / 10 END AS stk_div
FROM (SELECT p_type AS symbol, year(date) AS y, make_date(year(date), 6, 30) AS ex_date, l_returnflag AS flag, count(*) AS n,
        CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS d, CAST(sum(CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS t FROM trades GROUP BY ALL)""")
_fields = ("record_date", "pay_date", "div_listdate", "cash_div_tax", "stk_div")
part("dividends", "SELECT symbol, ex_date, count(*) AS source_rows, " + ", ".join(
    f"""CASE WHEN count(DISTINCT {f}) = 1 THEN any_value({f}) WHEN count(DISTINCT {f}) FILTER (ann_date = at_{f}) = 1 THEN any_value({f}) FILTER (ann_date = at_{f} AND {f} IS NOT NULL) END AS {f}"""
    for f in _fields) + ", (" + " OR ".join(
    f"(count(DISTINCT {f}) > 1 AND count(DISTINCT {f}) FILTER (ann_date = at_{f}) <> 1)" for f in _fields) + ") AS reconciliation_error FROM (SELECT *, " + ", ".join(
    f"max(CASE WHEN {f} IS NOT NULL THEN ann_date END) OVER (PARTITION BY symbol, ex_date) AS at_{f}" for f in _fields) + " FROM dividends_raw) GROUP BY symbol, ex_date")
part("entitled", """
SELECT account, symbol, ex_date, pay_date, units, units * coalesce(cash_div_tax, 0) AS gross_cash, units * coalesce(cash_div_tax, 0) * 0.2 AS tax_reserved,
       round_even(units * coalesce(cash_div_tax, 0) * 0.8, 2) AS net_cash, floor(units * coalesce(stk_div, 0) + 1e-8) AS bonus_shares
FROM (SELECT b.account, d.*, (SELECT coalesce(sum(f.quantity), 0) FROM flows f WHERE f.account = b.account AND f.symbol = b.symbol AND f.date <= d.record_date) AS units
      FROM (SELECT DISTINCT account, symbol FROM flows) b JOIN dividends d ON d.symbol = b.symbol) WHERE units > 0""")


def rated() -> list[Column]:
    """What dividends take from trades; mergeable."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col("l_discount").cast("decimal(4,2)")).alias("d"), F.sum(F.col("l_tax").cast("decimal(4,2)")).alias("t")]


def dividends_raw(m: Market) -> DataFrame:
    y = m.trades.groupBy(F.col("p_type").alias("symbol"), F.year("date").alias("y"), F.col("l_returnflag").alias("flag")).agg(*rated())
    return declared(y)


def declared(y: DataFrame) -> DataFrame:
    """Dividend announcements from ``rated`` rows of symbol, year and flag."""
    y = y.withColumns({"d": F.col("d").cast("double"), "t": F.col("t").cast("double"), "ex_date": F.make_date("y", F.lit(6), F.lit(30))})
    first = F.col("flag") == "R"
    silent = (F.col("flag") == "A") & F.col("y").isin(1996, 1998, 2000)
    return y.select(
        "symbol", "ex_date", F.date_sub("ex_date", F.when(first, 30).otherwise(10)).alias("ann_date"), F.date_sub("ex_date", 1).alias("record_date"),
        F.date_add("ex_date", F.when(first, 20).otherwise(25)).alias("pay_date"), F.date_add("ex_date", 15).alias("div_listdate"),
        F.when(~silent, F.col("d") / F.col("n")).alias("cash_div_tax"), F.when(F.col("flag") != "N", F.col("t") / F.col("n") / 10).alias("stk_div"))


def dividends(m: Market) -> DataFrame:
    return m._once("dividends", lambda: dedup.reconcile_fields(dividends_raw(m), ["symbol", "ex_date"], "ann_date", list(_fields)))


def entitlements(m: Market) -> DataFrame:
    return m._once("entitlements", lambda: L.dividend_entitlements(L.daily_flows(fills(m)), dividends(m)))


@query("a07_reconciled_dividends", "SELECT symbol, ex_date, source_rows, pay_date, cash_div_tax, stk_div, reconciliation_error::INT AS reconciliation_error FROM dividends",
       floats="cash_div_tax stk_div", dates="ex_date pay_date")
def reconciled_dividends(m):
    return dividends(m).select("symbol", "ex_date", "source_rows", "pay_date", "cash_div_tax", "stk_div", F.col("reconciliation_error").cast("int").alias("reconciliation_error"))


@query("l06_dividend_entitlement", "SELECT account, symbol, ex_date, units, gross_cash, tax_reserved, bonus_shares FROM entitled",
       floats="units gross_cash tax_reserved bonus_shares", dates="ex_date", digits=4)
def dividend_entitlement(m):
    return entitlements(m).select("account", "symbol", "ex_date", "units", "gross_cash", "tax_reserved", "bonus_shares")


@query("l06_open_receivables",
       "SELECT a.account, s.date, coalesce((SELECT sum(net_cash) FROM entitled e WHERE e.account = a.account AND e.ex_date <= s.date AND (e.pay_date IS NULL OR e.pay_date > s.date)), 0) AS claim FROM (SELECT DISTINCT account FROM entitled) a, sessions s",
       floats="claim", dates="date", digits=1)
def open_receivables(m):
    return L.receivables(entitlements(m), m.sessions)


def retired(m: Market) -> DataFrame:
    return m.type_assets.select(
        "symbol", F.col("symbol").isin("PROMO", "MEDIUM").alias("retired"),
        F.when(F.col("symbol") == "PROMO", F.lit("2000-06-15").cast("date")).alias("delist_date"))


@query("l07_write_offs",
       """SELECT b.account, b.symbol, t.terminal_date, t.basis, b.units, b.units * (SELECT arg_max(close, date) FROM type_bars k WHERE k.symbol = b.symbol AND k.date <= t.terminal_date) AS loss
          FROM (SELECT 'PROMO' AS symbol, DATE '2000-06-15' AS terminal_date, 'source_delist_date' AS basis UNION ALL SELECT 'MEDIUM', (SELECT max(date) + 1 FROM type_bars WHERE symbol = 'MEDIUM')::DATE, 'inferred_after_last_bar_not_certified') t
          JOIN LATERAL (SELECT account, f.symbol, sum(quantity) AS units FROM flows f WHERE f.symbol = t.symbol AND f.date <= t.terminal_date GROUP BY account, f.symbol) b ON true WHERE b.units > 0""",
       floats="units loss", dates="terminal_date", digits=2)
def write_offs(m):
    return L.write_offs(fills(m), m.bars("p_type"), L.terminal_dates(m.bars("p_type"), retired(m)))


@query("l08_factor_changes",
       """SELECT symbol, date, CASE WHEN abs(f - f0) <= 0.0005000001 AND abs(pre_close - c0) <= 0.005 THEN 'adjustment_precision' ELSE 'unexplained' END AS type FROM (
          SELECT symbol, date, f, pre_close, lag(f) OVER w AS f0, lag(close) OVER w AS c0 FROM (
            SELECT symbol, date, close, adj_factor + CASE WHEN month(date) = 3 THEN 0.0003 ELSE 0 END AS f, coalesce(lag(close) OVER w, close) + CASE WHEN year(date) = 1997 THEN 0.01 ELSE 0 END AS pre_close FROM type_bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
          WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE abs(f / f0 - 1) > 1e-7 AND (symbol, date) NOT IN (SELECT (symbol, min(date)) FROM type_bars WHERE symbol = 'LARGE' GROUP BY symbol, adj_factor)""",
       dates="date")
def factor_changes(m):
    w = Window.partitionBy("symbol").orderBy("date")
    b = m.bars("p_type")
    noisy = b.select("symbol", "date", "close", (F.col("adj_factor") + F.when(F.month("date") == 3, 0.0003).otherwise(0.0)).alias("adj_factor"),
                     (F.coalesce(F.lag("close").over(w), F.col("close")) + F.when(F.year("date") == 1997, 0.01).otherwise(0.0)).alias("pre_close"))
    known = b.where("symbol = 'LARGE'").groupBy("symbol", "adj_factor").agg(F.min("date").alias("date"))
    return L.factor_changes(noisy, known)


@query("l09_ex_reference_mark",
       f"""SELECT symbol, date, greatest(0, (last_mark - 100 * coalesce(cash_div_tax, 0)) / (1 + coalesce(stk_div, 0))) AS reference_price FROM (
           SELECT p.symbol, p.date, p.close, p.last_mark, d.cash_div_tax, d.stk_div FROM (SELECT symbol, date, close, last_value(close IGNORE NULLS) OVER {frame()} AS last_mark FROM brand_panel) p
           JOIN brand_assets a ON a.symbol = p.symbol JOIN dividends d ON d.symbol = CASE a.bucket WHEN 'bond' THEN 'SMALL' ELSE 'LARGE' END AND year(d.ex_date) = year(p.date) AND month(p.date) = 6)
           WHERE close IS NULL AND last_mark > 0""", floats="reference_price", dates="date", digits=4)
def ex_reference_mark(m):
    """Brands take the distribution of a part type on each June session they are not quoted."""
    d = dividends(m).select(F.col("symbol").alias("source"), F.year("ex_date").alias("y"), (F.col("cash_div_tax") * 100).alias("cash_div_tax"), "stk_div")
    brands = m.brand_assets.select("symbol", F.when(F.col("bucket") == "bond", "SMALL").otherwise("LARGE").alias("source"))
    june = m.sessions.where(F.month("date") == 6).select(F.col("date").alias("ex_date"), F.year("date").alias("y"))
    actions = brands.join(d, "source").join(june, "y").select("symbol", "ex_date", "cash_div_tax", "stk_div")
    return L.ex_reference_marks(m.panel("p_brand"), actions)


# Fixed values of the replay: funds whose distributions are reinvested, the interest rate, and the account whose statement never booked a write-off.
FUNDS, RATE, UNBOOKED = ("ECONOMY", "STANDARD"), 0.02, "3-MEDIUM"
_funds = ", ".join(f"'{f}'" for f in FUNDS)
part("fund_ratios", f"""
SELECT symbol, date, adj_factor / f0 AS ratio FROM (SELECT symbol, date, adj_factor, lag(adj_factor) OVER (PARTITION BY symbol ORDER BY date) AS f0 FROM type_bars)
WHERE symbol IN ({_funds}) AND adj_factor <> f0""")
part("book_events", f"""
SELECT account, symbol, date AS day, quantity, 0 AS bonus, cash, 0 AS claim, 1 AS ratio FROM flows
UNION ALL SELECT account, symbol, ex_date, 0, bonus_shares, 0, net_cash, 1 FROM entitled WHERE symbol NOT IN ({_funds})
UNION ALL SELECT account, symbol, pay_date, 0, 0, net_cash, -net_cash, 1 FROM entitled WHERE symbol NOT IN ({_funds})
UNION ALL SELECT e.account, e.symbol, d.div_listdate, bonus_shares, -bonus_shares, 0, 0, 1 FROM entitled e JOIN dividends d USING (symbol, ex_date) WHERE symbol NOT IN ({_funds})
UNION ALL SELECT account, symbol, date, 0, 0, 0, 0, ratio FROM fund_ratios JOIN (SELECT DISTINCT account, symbol FROM flows) USING (symbol)""")
part("book_flow", """
SELECT account, symbol, date, sum(quantity) AS quantity, sum(bonus) AS bonus, sum(cash) AS cash, sum(claim) AS claim, product(ratio) AS ratio
FROM book_events ASOF JOIN sessions ON book_events.day <= sessions.date GROUP BY ALL""")
part("book_terminals", """
SELECT symbol, min(date) AS terminal FROM (
  SELECT 'PROMO' AS symbol, DATE '2000-06-15' AS day UNION ALL SELECT 'MEDIUM', (SELECT max(date) + 1 FROM type_bars WHERE symbol = 'MEDIUM')::DATE) t
JOIN sessions s ON s.date >= t.day GROUP BY symbol""")
# a day's units are its own units times the ratios of the days after it: a sum over pairs instead of the running quotient
part("book_units", """
SELECT g.account, g.symbol, g.date, coalesce(sum(f.quantity * r.scale / f.scale), 0) AS units, coalesce(sum(f.bonus), 0) AS bonus
FROM (SELECT account, symbol, date FROM (SELECT DISTINCT account, symbol FROM flows), sessions) g
JOIN (SELECT symbol, date, exp(sum(ln(coalesce(ratio, 1))) OVER (PARTITION BY symbol ORDER BY date)) AS scale
      FROM (SELECT symbol, date FROM (SELECT DISTINCT symbol FROM flows), sessions) LEFT JOIN fund_ratios USING (symbol, date)) r ON r.symbol = g.symbol AND r.date = g.date
LEFT JOIN (SELECT *, exp(sum(ln(ratio)) OVER (PARTITION BY account, symbol ORDER BY date)) AS scale FROM book_flow) f
  ON f.account = g.account AND f.symbol = g.symbol AND f.date <= g.date GROUP BY ALL""")
part("event_marks", f"""
SELECT symbol, date, last_value(quote IGNORE NULLS) OVER {frame()} AS mark FROM (
  SELECT p.symbol, p.date, coalesce(p.close, CASE WHEN d.symbol IS NOT NULL AND p.before > 0 THEN greatest(0, (p.before - coalesce(cash_div_tax, 0)) / (1 + coalesce(stk_div, 0))) END) AS quote
  FROM (SELECT symbol, date, close, last_value(close IGNORE NULLS) OVER {frame()} AS before FROM type_panel) p
  LEFT JOIN (SELECT symbol, cash_div_tax, stk_div, sessions.date FROM dividends ASOF JOIN sessions ON dividends.ex_date <= sessions.date WHERE symbol NOT IN ({_funds})) d
    ON d.symbol = p.symbol AND d.date = p.date)""")
part("replayed", f"""
SELECT account, date, booked, g * ({CASH0} + sum(cash / g) OVER w) AS cash, sum(claim) OVER w AS claim, holdings
FROM (SELECT account, date, booked, holdings, coalesce(cash, 0) AS cash, coalesce(claim, 0) AS claim, pow({1 + RATE}, (date - (SELECT min(date) FROM sessions)) / 365.25) AS g
      FROM (SELECT u.account, u.date, b.booked, sum((u.units + u.bonus - CASE WHEN b.booked AND u.date >= t.terminal THEN greatest(e.units, 0) ELSE 0 END) * coalesce(m.mark, 0)) AS holdings
            FROM book_units u CROSS JOIN (VALUES (true), (false)) b(booked) LEFT JOIN event_marks m ON m.symbol = u.symbol AND m.date = u.date
            LEFT JOIN book_terminals t ON t.symbol = u.symbol LEFT JOIN book_units e ON e.account = u.account AND e.symbol = u.symbol AND e.date = t.terminal GROUP BY ALL)
      LEFT JOIN (SELECT account, date, sum(cash) AS cash, sum(claim) AS claim FROM book_flow GROUP BY ALL) USING (account, date))
WINDOW w AS (PARTITION BY account, booked ORDER BY date)""")


def replays(m: Market) -> DataFrame:
    """The NAV replayed from the events (``log`` events), and as the statements have it, one of which misses a write-off.

    Fills, bars and dividend rates come from one pass over the trades.
    """
    def daily() -> DataFrame:
        return m.trades.withColumns(booked()).groupBy(*L.BOOK, "date", F.col("l_returnflag").alias("flag")).agg(
            F.sum(L.signed()).alias("quantity"), F.sum(-L.signed("notional") - F.col("commission")).alias("cash"), *traded(), *rated())

    base = m.settle("ledger-days", daily)
    flows = base.groupBy(*L.BOOK, "date").agg(F.sum("quantity").alias("quantity"), F.sum("cash").alias("cash"))
    bars = priced(base.groupBy("symbol", "date").agg(*merged()))
    raw = declared(base.groupBy("symbol", F.year("date").alias("y"), "flag").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("t").alias("t")))
    actions = dedup.reconcile_fields(raw, ["symbol", "ex_date"], "ann_date", list(_fields)).where(~F.col("symbol").isin(*FUNDS))
    before = F.lag("adj_factor").over(Window.partitionBy("symbol").orderBy("date"))
    ratios = bars.where(F.col("symbol").isin(*FUNDS)).select("symbol", "date", (F.col("adj_factor") / before).alias("ratio")).where("ratio <> 1")
    flow = L.event_flow(flows, L.dividend_entitlements(flows, actions), ratios, m.sessions)
    logs = F.array(F.lit("events"), F.lit("statement"))
    ends = L.terminal_dates(bars, retired(m)).select("symbol", "terminal_date").join(flows.select(*L.BOOK).distinct(), "symbol")
    ends = ends.withColumn("log", F.explode(logs)).where((F.col("log") == "events") | (F.col("account") != UNBOOKED))
    marked = L.event_marks(complete_panel(bars, m.sessions), actions, m.sessions)
    return L.replay_nav(flow.withColumn("log", F.explode(logs)), marked, ends, m.sessions, CASH0, RATE, extra=("log",))


@query("l10_replayed_nav", "SELECT account, date, cash, claim, holdings, cash + claim + holdings AS equity FROM replayed WHERE booked",
       floats="cash claim holdings equity", dates="date", digits=1)
def replayed_nav(m):
    return replays(m).where("log = 'events'").drop("log")


@query("l10_replay_difference",
       f"""SELECT a.account, count(*) AS sessions, max(abs(a.holdings - b.holdings)) AS max_abs_difference, (max(abs(a.holdings - b.holdings)) < 0.01)::INT AS verified
           FROM replayed a JOIN replayed b ON a.account = b.account AND a.date = b.date WHERE a.booked AND b.booked = (b.account <> '{UNBOOKED}') GROUP BY a.account""",
       floats="max_abs_difference", digits=1)
def replay_difference(m):
    """Replay of fills and corporate events against the statements: the account whose write-off was never booked is not verified."""
    both = m.settle("replays", lambda: replays(m))
    return L.replay_difference(both.where("log = 'events'"), both.where("log = 'statement'"))


# --- statistics ------------------------------------------------------------------------------


@query("a11_profit_attribution",
       """SELECT account, bucket, symbol, sum(profit) AS profit FROM (
          SELECT f.account, a.bucket, f.symbol, f.units * k.mark - f.paid - f.commission AS profit FROM (SELECT account, symbol, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS units,
            sum(CASE WHEN side = 'BUY' THEN notional ELSE -notional END) AS paid, sum(commission) AS commission FROM fills GROUP BY account, symbol) f
          JOIN (SELECT symbol, arg_max(close, date) AS mark FROM type_bars GROUP BY symbol) k USING (symbol) JOIN type_assets a USING (symbol)) GROUP BY ROLLUP (account, bucket, symbol) HAVING account IS NOT NULL""",
       floats="profit", digits=1)
def profit_attribution(m):
    return L.profit_attribution(fills(m), m.panel("p_type"), m.sessions, m.type_assets)


@query("a12_trade_statistics",
       f"""SELECT f.account, trades, trades / years AS annual_trades, commission, slippage, floor_surcharge, minimum_fee_fraction, (commission + slippage) / {CASH0} AS total_cost_of_initial,
           (commission + slippage) / me / years * 10000 AS cost_bps_per_year, notional / me / years AS annual_turnover, median_ticket, average_cash_weight, tiny_ticket_fraction
           FROM (SELECT account, count(*) AS trades, sum(commission) AS commission, sum(slippage_cost) AS slippage, sum(notional) AS notional, sum(greatest(commission - notional * 1.5 / 10000, 0)) AS floor_surcharge,
             avg((commission <= 5.0 + 1e-8)::INT) AS minimum_fee_fraction, avg((notional < 5000)::INT) AS tiny_ticket_fraction, median(notional) AS median_ticket FROM fills GROUP BY account) f
           JOIN (SELECT account, avg(equity) AS me, avg(cash / equity) AS average_cash_weight, greatest((max(date) - min(date)) / 365.25, 1 / 365.25) AS years FROM account_nav GROUP BY account) e USING (account)""",
       floats="annual_trades commission slippage floor_surcharge minimum_fee_fraction total_cost_of_initial cost_bps_per_year annual_turnover median_ticket average_cash_weight tiny_ticket_fraction", digits=4)
def trade_statistics(m):
    m.store_trades("o_orderpriority", "p_type", "l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")
    return L.trade_statistics(fills(m), nav(m), bps=1.5, minimum=5.0, initial_cash=CASH0)


@query("m08_exposure", "SELECT account, avg(1 - cash / equity) AS average_exposure, avg(cash / equity) AS average_cash_weight FROM account_nav GROUP BY account",
       floats="average_exposure average_cash_weight")
def exposure(m):
    return metrics.exposure(nav(m), ["account"])


@query("m09_cost_drag",
       """SELECT n.account AS strategy_id, k.multiple, n.date, n.equity - sum(coalesce(c.cost, 0)) OVER (PARTITION BY n.account, k.multiple ORDER BY n.date) * (k.multiple - 1) AS equity FROM account_nav n
          LEFT JOIN (SELECT account, date, sum(commission + slippage_cost) AS cost FROM fills GROUP BY account, date) c ON c.account = n.account AND c.date = n.date, (VALUES (2), (3)) k(multiple)""",
       floats="equity", dates="date", digits=1)
def cost_drag(m):
    costs = fills(m).select(F.col("account").alias("strategy_id"), "date", (F.col("commission") + F.col("slippage_cost")).alias("cost"))
    return metrics.cost_drag(nav(m).select(F.col("account").alias("strategy_id"), "date", "equity"), costs, (2, 3))


part("candidate_rows", """
SELECT f.l_returnflag AS capital, s.strategy_id AS model, f.trades, s.cagr, s.sharpe, s.max_drawdown FROM window_stats s
JOIN (SELECT l_returnflag, p_type, count(*) AS trades FROM trades GROUP BY ALL) f ON f.p_type = s.strategy_id WHERE s.period = 'training'""")


@query("o11_candidate_reduction",
       """SELECT c.model, bool_and(c.cagr >= b.cagr - 0.2 AND c.sharpe >= b.sharpe - 0.8 AND c.max_drawdown >= b.max_drawdown - 0.2)::INT AS tolerances, avg(1 - c.trades / b.trades) AS mean_trade_reduction,
          (bool_and(c.cagr >= b.cagr - 0.2 AND c.sharpe >= b.sharpe - 0.8 AND c.max_drawdown >= b.max_drawdown - 0.2) AND avg(1 - c.trades / b.trades) >= 0.005)::INT AS eligible
          FROM candidate_rows c JOIN candidate_rows b ON b.capital = c.capital AND b.model = 'STANDARD' WHERE c.model <> 'STANDARD' GROUP BY c.model""",
       floats="mean_trade_reduction")
def candidate_reduction(m):
    trades = m.trades.groupBy(F.col("l_returnflag").alias("capital"), F.col("p_type").alias("model")).agg(F.count(F.lit(1)).alias("trades"))
    stats = metrics.window_performance(m.nav(), WINDOWS[1:2]).withColumnRenamed("strategy_id", "model")
    return selection.reduction_test(trades.join(stats, "model"), "STANDARD", cagr=0.2, sharpe=0.8, drawdown=0.2, reduction=0.005)
