"""Accounting over fills, corporate events and marks, for many accounts at once.

Fills are reduced to one row per (account, symbol, date) before any window, so even
an account with a third of all fills becomes at most one row per symbol and session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.scalar import fee
from marketframe.functions.timeseries import forward_fill, ordered, running
from marketframe.operators.asof import asof_backward
from marketframe.operators.panel import calendar_grid, complete_panel
from marketframe.operators.quantiles import positive_quantile

BOOK = ["account", "symbol"]
TAX_RESERVE = 0.2
PRECISION_STEP, PRECISION_CLOSE = 0.0005000001, 0.005


def signed(quantity: str = "quantity") -> Column:
    return F.when(F.col("side") == "BUY", F.col(quantity)).otherwise(-F.col(quantity))


def daily_flows(fills: DataFrame) -> DataFrame:
    """Net quantity and cash of each account, symbol and date."""
    cash = -signed("notional") - F.col("commission")
    return fills.groupBy(*BOOK, "date").agg(F.sum(signed()).alias("quantity"), F.sum(cash).alias("cash"))


def marks(panel: DataFrame) -> DataFrame:
    """Last close and last observed factor of each symbol on each session."""
    return panel.select("symbol", "date", forward_fill(F.col("close")).alias("mark"), forward_fill(F.col("adj_factor")).alias("factor"))


def position_grid(flows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every (account, symbol) that ever traded on every session, with its flow."""
    return complete_panel(flows, sessions, tuple(BOOK))


def account_nav(fills: DataFrame, panel: DataFrame, sessions: DataFrame, initial_cash: float, cash_rate: float = 0.0,
                reinvest: bool = False) -> DataFrame:
    """Cash and NAV per account and session from fills and closing marks.

    With ``reinvest`` units grow with the adjustment factor: q = factor · Σ fill/factor.
    Cash earns interest in closed form: c = g · (c0 + Σ flow/g), g = (1+rate)^years.
    """
    flows = daily_flows(fills)
    d = position_grid(flows, sessions).join(marks(panel), ["symbol", "date"], "left")
    w = ordered(*BOOK)
    q = F.coalesce("quantity", F.lit(0.0))
    if reinvest:
        units = F.col("factor") * running(F.sum, q / F.col("factor"), w)
        units = F.when(F.abs(units) < 1e-9, 0.0).otherwise(units)
    else:
        units = running(F.sum, q, w)
    held = d.withColumn("units", units)
    value = held.groupBy("account", "date").agg(F.sum(F.col("units") * F.coalesce("mark", F.lit(0.0))).alias("holdings"), F.sum("cash").alias("flow"))
    start = sessions.agg(F.min("date")).scalar()
    growth = F.pow(F.lit(1 + cash_rate), F.datediff("date", "_start") / 365.25)
    aw = ordered("account")
    v = value.withColumn("_start", start).withColumn("_g", growth)
    cash = F.col("_g") * (initial_cash + running(F.sum, F.coalesce("flow", F.lit(0.0)) / F.col("_g"), aw))
    return v.withColumn("cash", cash).select("account", "date", "cash", "holdings", (F.col("cash") + F.col("holdings")).alias("equity"))


def reinvested_units(fills: DataFrame, panel: DataFrame, sessions: DataFrame) -> DataFrame:
    """Units under factor reinvestment per account, symbol and session."""
    d = position_grid(daily_flows(fills), sessions).join(marks(panel), ["symbol", "date"], "left")
    units = F.col("factor") * running(F.sum, F.coalesce("quantity", F.lit(0.0)) / F.col("factor"), ordered(*BOOK))
    return d.select(*BOOK, "date", F.when(F.abs(units) < 1e-9, 0.0).otherwise(units).alias("units"))


def fill_faults(fills: DataFrame, bars: DataFrame, sessions: DataFrame, *, bps: float, minimum: float, slippage_bps: float,
                lot: int, participation: float, multiplier: float = 1.0) -> DataFrame:
    """Fills with the audit rules they break. The calendar has at most 366 rows a year, hence its broadcasts."""
    s = sessions.select(F.col("date").alias("signal_date"), F.col("session_no").alias("_a"))
    e = sessions.select("date", F.col("session_no").alias("_b"))
    b = bars.select("symbol", "date", F.col("open").alias("_open"), F.col("high").alias("_high"), F.col("low").alias("_low"), F.col("volume").alias("_volume"))
    j = fills.join(F.broadcast(s), "signal_date", "left").join(F.broadcast(e), "date", "left").join(b, ["symbol", "date"], "left")
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    expected = F.col("_open") * (1 + sign * slippage_bps / 10000 * multiplier)
    ratio = F.col("quantity") / lot
    rules = {
        "not_next_session": F.coalesce(F.col("_b") != F.col("_a") + 1, F.lit(True)),
        "no_open_market": F.coalesce((F.col("_volume") <= 0) | (F.col("_high") == F.col("_low")), F.lit(True)),
        "price": F.coalesce(F.abs(F.col("price") - expected) >= 1e-8, F.lit(True)),
        "commission": F.abs(F.col("commission") - fee(F.col("notional"), bps, minimum, multiplier)) >= 1e-8,
        "odd_lot": (F.col("side") == "BUY") & (F.abs(ratio - F.round(ratio)) >= 1e-8),
        "above_volume_cap": F.coalesce(F.col("quantity") > F.col("_volume") * participation + 1e-8, F.lit(True)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return j.select(*fills.columns, found.alias("faults")).where(F.size("faults") > 0)


def negative_cash(nav: DataFrame) -> DataFrame:
    return nav.where("cash < -1e-6").select("account", "date", "cash")


# --- corporate actions -----------------------------------------------------------------


def units_on(flows: DataFrame, dates: DataFrame, at: str) -> DataFrame:
    """Units held at the close of each date; ``dates`` carries account, symbol and the date, ``flows`` are daily."""
    w = ordered(*BOOK)
    changes = flows.select(*BOOK, F.col("date").alias("_on"), running(F.sum, F.col("quantity"), w).alias("units"))
    found = asof_backward(dates, changes, BOOK, at, "_on", ["units"], bucket="year")
    return found.drop("matched_at").withColumn("units", F.coalesce("units", F.lit(0.0)))


def dividend_entitlements(flows: DataFrame, dividends: DataFrame) -> DataFrame:
    """Units on the record date × rates; a fifth is reserved for tax; whole bonus shares only. ``flows`` are daily."""
    books = flows.select(*BOOK).distinct()
    due = books.join(dividends, "symbol").where("record_date IS NOT NULL")
    held = units_on(flows, due, "record_date").where("units > 0")
    rate, bonus = F.coalesce("cash_div_tax", F.lit(0.0)), F.coalesce("stk_div", F.lit(0.0))
    gross = F.col("units") * rate
    return held.select(
        *BOOK, "ex_date", "pay_date", "div_listdate", "units", gross.alias("gross_cash"), (gross * TAX_RESERVE).alias("tax_reserved"),
        F.bround(gross * (1 - TAX_RESERVE), 2).alias("net_cash"), F.floor(F.col("units") * bonus + 1e-8).cast("double").alias("bonus_shares"))


def receivables(entitlements: DataFrame, sessions: DataFrame) -> DataFrame:
    """Open dividend claims per account and session: from the ex date until the payment date."""
    claim = F.col("net_cash")
    steps = entitlements.select("account", F.explode(F.array(
        F.struct(F.col("ex_date").alias("on"), claim.alias("change")), F.struct(F.col("pay_date").alias("on"), (-claim).alias("change")))).alias("e"))
    daily = steps.select("account", "e.*").where("on IS NOT NULL").groupBy("account", "on").agg(F.sum("change").alias("change"))
    total = daily.select("account", "on", running(F.sum, F.col("change"), ordered("account", by="on")).alias("claim"))
    grid = calendar_grid(entitlements.select("account").distinct(), sessions)
    found = asof_backward(grid, total, ["account"], "date", "on", ["claim"], bucket="year")
    return found.select("account", "date", F.coalesce("claim", F.lit(0.0)).alias("claim"))


def terminal_dates(bars: DataFrame, metadata: DataFrame) -> DataFrame:
    """Delisting date of retired symbols; without one, the day after the last bar, marked as inferred."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("_last"))
    return metadata.where("retired").join(last, "symbol").select(
        "symbol", F.coalesce("delist_date", F.date_add("_last", 1)).alias("terminal_date"),
        F.when(F.col("delist_date").isNull(), "inferred_after_last_bar_not_certified").otherwise("source_delist_date").alias("basis"))


def write_offs(fills: DataFrame, bars: DataFrame, terminals: DataFrame) -> DataFrame:
    """Remaining units × last mark of every account at a symbol's terminal date."""
    books = fills.select(*BOOK).distinct().join(terminals, "symbol")
    held = units_on(daily_flows(fills), books, "terminal_date").where("units > 0")
    close = bars.select("symbol", "date", "close")
    marked = asof_backward(held, close, ["symbol"], "terminal_date", "date", ["close"], bucket="year")
    return marked.select(*BOOK, "terminal_date", "basis", "units", (F.col("units") * F.col("close")).alias("loss"))


def factor_changes(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Changed factors without a known action: precision noise, or unexplained.

    ``bars`` carries ``pre_close``; ``actions`` the (symbol, date) of known ex dates.
    """
    w = ordered("symbol")
    d = bars.withColumns({"_factor": F.lag("adj_factor").over(w), "_close": F.lag("close").over(w)})
    changed = d.where(F.abs(F.col("adj_factor") / F.col("_factor") - 1) > 1e-7)
    unknown = changed.join(actions.select("symbol", "date"), ["symbol", "date"], "left_anti")
    noise = (F.abs(F.col("adj_factor") - F.col("_factor")) <= PRECISION_STEP) & (F.abs(F.col("pre_close") - F.col("_close")) <= PRECISION_CLOSE)
    return unknown.select("symbol", "date", F.when(F.coalesce(noise, F.lit(False)), "adjustment_precision").otherwise("unexplained").alias("type"))


def ex_reference_marks(panel: DataFrame, dividends: DataFrame) -> DataFrame:
    """Mark of a symbol without a quote on its ex date: the last mark less the distribution."""
    d = panel.select("symbol", "date", "close", forward_fill(F.col("close")).alias("_last"))
    j = d.where("close IS NULL AND _last > 0").join(
        dividends.select("symbol", F.col("ex_date").alias("date"), "cash_div_tax", "stk_div"), ["symbol", "date"])
    cash, bonus = F.coalesce("cash_div_tax", F.lit(0.0)), F.coalesce("stk_div", F.lit(0.0))
    return j.select("symbol", "date", F.greatest(F.lit(0.0), (F.col("_last") - cash) / (1 + bonus)).alias("reference_price"))


# --- replay ------------------------------------------------------------------------------

#: What an event of a book can change, with the value that changes nothing.
CHANGES = {"quantity": 0.0, "bonus": 0.0, "cash": 0.0, "claim": 0.0, "ratio": 1.0}


def event(on: Column, **changes: Column) -> Column:
    """One row of the event flow: a date and what changes on it."""
    return F.struct(on.alias("on"), *[F.coalesce(changes.get(c, F.lit(none)).cast("double"), F.lit(none)).alias(c) for c, none in CHANGES.items()])


def event_flow(flows: DataFrame, entitlements: DataFrame, ratios: DataFrame, sessions: DataFrame) -> DataFrame:
    """Fills and corporate events of all books, summed by book and session.

    ``flows`` are daily fills (``quantity``, ``cash``); ``ratios`` have symbol, date and the
    ``ratio`` by which reinvestment multiplies the units held before the day's fills. An
    entitlement opens a claim and bonus shares on its ex date; the payment turns the claim
    into cash, the listing turns the bonus shares into units. An event without a date has
    not happened yet, nor has one after the last session; other days count as the next session.
    """
    shares, net = F.col("bonus_shares"), F.col("net_cash")
    corporate = F.array(event(F.col("ex_date"), bonus=shares, claim=net), event(F.col("pay_date"), cash=net, claim=-net),
                        event(F.col("div_listdate"), quantity=shares, bonus=-shares))
    rows = flows.select(*BOOK, event(F.col("date"), quantity=F.col("quantity"), cash=F.col("cash")).alias("e"))
    rows = rows.unionByName(entitlements.select(*BOOK, F.explode(corporate).alias("e")))
    books = flows.select(*BOOK).distinct()
    rows = rows.unionByName(books.join(ratios, "symbol").select(*BOOK, event(F.col("date"), ratio=F.col("ratio")).alias("e")))
    flow = on_session(rows.select(*BOOK, "e.*"), sessions, "on")
    return flow.groupBy(*BOOK, "date").agg(
        *[(F.product(c) if c == "ratio" else F.sum(c)).alias(c) for c in CHANGES])


def on_session(rows: DataFrame, sessions: DataFrame, on: str) -> DataFrame:
    """``rows`` with the session ``date`` of a day: itself, or the next one. Days after the last session are dropped."""
    before = F.coalesce(F.lag("date").over(Window.orderBy("date")), F.date_sub("date", 1))
    days = sessions.withColumn("_before", before).select("date", F.explode(F.sequence(F.date_add("_before", 1), F.col("date"))).alias(on))
    return rows.join(F.broadcast(days), on).drop(on)  # the calendar: at most 366 rows a year


def event_marks(panel: DataFrame, dividends: DataFrame, sessions: DataFrame) -> DataFrame:
    """Last quote of each symbol on each session; on an ex date without a quote, the last one less the distribution.

    That reference holds until the next quote, so the distribution is not counted twice.
    """
    due = on_session(dividends.select("symbol", F.col("ex_date").alias("on"), "cash_div_tax", "stk_div", F.lit(True).alias("due")), sessions, "on")
    last = forward_fill(F.col("close"))
    cash, bonus = F.coalesce("cash_div_tax", F.lit(0.0)), F.coalesce("stk_div", F.lit(0.0))
    reference = F.when(F.col("due") & (F.col("_last") > 0), F.greatest(F.lit(0.0), (F.col("_last") - cash) / (1 + bonus)))
    d = panel.join(due, ["symbol", "date"], "left").withColumn("_last", last).withColumn("_quote", F.coalesce("close", reference))
    return d.select("symbol", "date", forward_fill(F.col("_quote")).alias("mark"))


def replay_nav(flow: DataFrame, marked: DataFrame, terminals: DataFrame, sessions: DataFrame, initial_cash: float, cash_rate: float = 0.0,
               extra: tuple[str, ...] = ()) -> DataFrame:
    """Cash, open claims, bonus shares and marked units of every account on every session, by folding its event flow.

    Units are the running product of the ratios times the running sum of quantities over it;
    cash earns interest in closed form; at a symbol's ``terminal_date`` the units left after
    the day's events are written off; ``terminals`` have that date and some of the book's
    columns. ``extra`` columns of ``flow`` belong to the book. One shuffle by book and one by account; a partition of a book has one
    row a session, however many fills stand behind it.
    """
    book = [*extra, *BOOK]
    own = [*extra, "account"]
    shared = [c for c in book if c in terminals.columns]
    end = on_session(terminals.select(*shared, F.col("terminal_date").alias("_on")), sessions, "_on").withColumnRenamed("date", "_end")
    d = complete_panel(flow, sessions, tuple(book)).join(end, shared, "left")
    w = ordered(*book)
    d = d.withColumn("_scale", F.exp(running(F.sum, F.ln(F.coalesce("ratio", F.lit(1.0))), w)))
    d = d.withColumn("_units", F.col("_scale") * running(F.sum, F.coalesce("quantity", F.lit(0.0)) / F.col("_scale"), w))
    written = F.when(F.col("date") == F.col("_end"), F.greatest("_units", F.lit(0.0)) / F.col("_scale"))
    units = F.col("_units") - F.coalesce(running(F.sum, written, w), F.lit(0.0)) * F.col("_scale")
    held = d.withColumns({"units": units, "bonus": running(F.sum, F.coalesce("bonus", F.lit(0.0)), w)})

    def worth(of: str) -> Column:
        return F.when(F.abs(F.col(of)) > 1e-8, F.col(of)).otherwise(0.0) * F.coalesce("mark", F.lit(0.0))

    by_day = held.join(marked, ["symbol", "date"], "left").groupBy(*own, "date").agg(
        F.sum(worth("units") + worth("bonus")).alias("holdings"), F.sum("cash").alias("cash"), F.sum("claim").alias("claim"))
    growth = F.pow(F.lit(1 + cash_rate), F.datediff("date", sessions.agg(F.min("date")).scalar()) / 365.25)
    aw = ordered(*own)
    grown = by_day.withColumn("_g", growth)
    cash = F.col("_g") * (initial_cash + running(F.sum, F.coalesce("cash", F.lit(0.0)) / F.col("_g"), aw))
    total = grown.withColumns({"cash": cash, "claim": running(F.sum, F.coalesce("claim", F.lit(0.0)), aw)})
    return total.select(*own, "date", "cash", "claim", "holdings", (F.col("cash") + F.col("claim") + F.col("holdings")).alias("equity"))


def replay_difference(replayed: DataFrame, recorded: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Sessions, largest difference and whether it is below the tolerance, of each account; a session of one side only is infinite."""
    j = replayed.select("account", "date", F.col("equity").alias("_a")).join(
        recorded.select("account", "date", F.col("equity").alias("_b")), ["account", "date"], "full")
    gap = F.max(F.coalesce(F.abs(F.col("_a") - F.col("_b")), F.lit(float("inf"))))
    return j.groupBy("account").agg(F.count(F.lit(1)).alias("sessions"), gap.alias("max_abs_difference"), (gap < tolerance).cast("int").alias("verified"))


# --- statistics --------------------------------------------------------------------------


def profit_attribution(fills: DataFrame, panel: DataFrame, sessions: DataFrame, assets: DataFrame) -> DataFrame:
    """Profit by asset with bucket and account subtotals: ending value + sells - buys - commission."""
    f = fills.groupBy(*BOOK).agg(
        F.sum(signed()).alias("units"), F.sum(signed("notional")).alias("paid"), F.sum("commission").alias("commission"))
    last = panel.where("close IS NOT NULL").groupBy("symbol").agg(F.max_by("close", "date").alias("mark"))
    p = f.join(last, "symbol").join(assets.select("symbol", "bucket"), "symbol").withColumn(
        "profit", F.col("units") * F.col("mark") - F.col("paid") - F.col("commission"))
    return p.rollup("account", "bucket", "symbol").agg(F.sum("profit").alias("profit")).where("account IS NOT NULL")


def trade_statistics(fills: DataFrame, nav: DataFrame, *, bps: float, minimum: float, initial_cash: float,
                     tiny: float = 5000, multiplier: float = 1.0) -> DataFrame:
    """Counts, costs, turnover and ticket sizes per account over the span of its NAV."""
    c, n = F.col("commission"), F.col("notional")
    f = fills.groupBy("account").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(c).alias("commission"), F.sum("slippage_cost").alias("slippage"), F.sum(n).alias("notional"),
        F.sum(F.greatest(c - n * bps / 10000 * multiplier, F.lit(0.0))).alias("floor_surcharge"),
        F.avg((c <= minimum * multiplier + 1e-8).cast("double")).alias("minimum_fee_fraction"),
        F.avg((n < tiny).cast("double")).alias("tiny_ticket_fraction"))
    e = nav.groupBy("account").agg(
        F.avg("equity").alias("mean_equity"), F.avg(F.col("cash") / F.col("equity")).alias("average_cash_weight"),
        F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1 / 365.25)).alias("years"))
    cost = F.col("commission") + F.col("slippage")
    j = f.join(e, "account").join(positive_quantile(fills, ["account"], "notional", 0.5, "median_ticket"), "account")
    return j.select(
        "account", "trades", (F.col("trades") / F.col("years")).alias("annual_trades"), "commission", "slippage", "floor_surcharge",
        "minimum_fee_fraction", (cost / initial_cash).alias("total_cost_of_initial"),
        (cost / F.col("mean_equity") / F.col("years") * 10000).alias("cost_bps_per_year"),
        (F.col("notional") / F.col("mean_equity") / F.col("years")).alias("annual_turnover"),
        "median_ticket", "average_cash_weight", "tiny_ticket_fraction")
