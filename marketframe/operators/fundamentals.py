"""Point-in-time fundamentals: statements, estimates, surprises, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.scalar import micros_after
from marketframe.functions.timeseries import divide
from marketframe.operators.asof import (
    asof_backward,
    by_month,
    cutoff_of,
    end_of_day,
    known_versions,
    latest_within,
    month_of,
)
from marketframe.operators.dedup import drop_conflicts

# Statement columns of each kind.
INCOME = ["revenue", "oper_cost", "operate_profit", "n_income", "n_income_attr_p", "basic_eps"]
CASHFLOW = ["net_profit", "n_cashflow_act", "c_pay_acq_const_fiolta"]
BALANCE = ["total_assets", "accounts_receiv", "inventories", "goodwill"]
KINDS = {"income": INCOME, "cashflow": CASHFLOW, "balance": BALANCE}

# Age limits in days and floors that keep ratios meaningful.
REPORT_AGE, ESTIMATE_AGE, EVENT_AGE = 550, 180, 90
MIN_BROKERS, MIN_OLD_ESTIMATE, MIN_SURPRISE_SPREAD = 3, 1e6, 1e6


def prepare_statements(raw: DataFrame, kind: str) -> DataFrame:
    """Usable versions with the moment they became known.

    Originals count, and comparatives that were published in a later year; a version
    is known at the end of the later announcement day, which must follow the period.
    Contradictory versions of one moment are dropped.
    """
    values = KINDS[kind]
    original = F.col("report_type").isin("1", "5") & (F.col("update_flag") == "0")
    known = end_of_day(F.greatest("ann_date", "f_ann_date"))
    d = raw.withColumn("available_at", known)
    comparative = (F.col("report_type") == "4") & (F.year("available_at") > F.year("end_date"))
    d = d.where((original | comparative) & (F.col("available_at") > F.col("end_date").cast("timestamp_ntz")))
    d = d.select("ts_code", "end_date", "available_at", "comp_type", "report_type", *values)
    return drop_conflicts(d, ["ts_code", "end_date", "available_at"], [*values, "comp_type"])


def prepare_estimates(raw: DataFrame) -> DataFrame:
    """Usable analyst estimates: update within a week, a real fiscal quarter, no contradictions."""
    lag = micros_after(F.col("report_date"), F.col("create_time"))
    good = F.coalesce(F.regexp_like("quarter", F.lit("^[0-9]{4}Q[1-4]$")), F.lit(False))
    d = raw.where(good & lag.between(0, 7 * 86400 * 1000000) & F.col("org_name").isNotNull()).select(
        "ts_code", "org_name", "quarter", F.col("report_date").alias("reported_at"),
        F.greatest(end_of_day(F.col("report_date")), F.col("create_time")).alias("available_at"),
        (F.col("np") * 10000).alias("np_cny"),
    )
    return drop_conflicts(d, ["ts_code", "org_name", "quarter", "reported_at", "available_at"], ["np_cny"])


def _seen_estimates(estimates: DataFrame, dates: DataFrame) -> DataFrame:
    """Estimates in sight of each day ``at``, with a number that orders them by age.

    One number orders by report day, then by moment of knowledge (at most 8 days later).
    """
    spread = by_month(estimates, F.col("available_at"), F.date_add("reported_at", ESTIMATE_AGE).cast("timestamp_ntz"), "_m")
    seen = spread.join(
        dates.withColumn("_m", month_of(F.col("at"))).withColumnRenamed("fiscal", "quarter"), ["_m", "quarter"]
    ).where(
        (F.col("available_at") < cutoff_of(F.col("at")))
        & (F.col("reported_at") >= F.date_sub("at", ESTIMATE_AGE))
    )
    later = micros_after(F.col("reported_at"), F.col("available_at"))
    return seen.withColumn("_rank", F.unix_date("reported_at").cast("bigint") * F.lit(2**40) + later)


def latest_estimates(estimates: DataFrame, dates: DataFrame) -> DataFrame:
    """Last estimate of each broker for the fiscal year of ``at``, at most 180 days old.

    ``dates`` carries ``date`` (a label), ``at`` (the day whose 18:30 is the cutoff)
    and ``fiscal``. The newest report decides first and a missing number drops it
    afterwards, so an older number never survives a newer missing one.
    """
    return (
        _seen_estimates(estimates, dates).groupBy("date", "ts_code", "org_name")
        .agg(F.max_by("np_cny", "_rank").alias("np_cny"), F.max_by("available_at", "_rank").alias("available_at"))
        .where("np_cny IS NOT NULL")
    )


def paired_estimates(estimates: DataFrame, dates: DataFrame) -> DataFrame:
    """Estimates of the same broker now and at the earlier day; ``dates(date, at, before)``.

    Both days are looked up in one pass and meet in one aggregate instead of a join.
    """
    fiscal = F.concat(F.year("at").cast("string"), F.lit("Q4"))
    days = dates.withColumn("fiscal", fiscal).select("date", "fiscal", F.explode(F.array(
        F.struct(F.lit(True).alias("now"), F.col("at").alias("at")), F.struct(F.lit(False).alias("now"), F.col("before").alias("at")))).alias("d"))
    seen = _seen_estimates(estimates, days.select("date", "fiscal", "d.now", "d.at"))
    new, old = F.when(F.col("now"), F.col("_rank")), F.when(~F.col("now"), F.col("_rank"))
    return (
        seen.groupBy("date", "ts_code", "org_name")
        .agg(F.max_by("np_cny", new).alias("np_cny"), F.max_by("available_at", new).alias("available_at"), F.max_by("np_cny", old).alias("np_old"))
        .where("np_cny IS NOT NULL AND np_old IS NOT NULL")
    )


def analyst_revision(pairs: DataFrame) -> DataFrame:
    """Median revision and breadth per stock; fewer than three brokers give none."""
    big = pairs.where(F.abs("np_old") >= MIN_OLD_ESTIMATE)
    step = F.col("np_cny") - F.col("np_old")
    g = big.groupBy("date", "ts_code").agg(
        F.median(step / F.abs("np_old")).alias("_m"),
        F.avg(F.signum(step)).alias("_b"),
        F.count(F.lit(1)).alias("paired_brokers"),
        F.max("available_at").alias("analyst_available_at"),
    )
    enough = F.col("paired_brokers") >= MIN_BROKERS
    return g.select("date", "ts_code", F.when(enough, F.col("_m")).alias("np_revision_63"),
                    F.when(enough, F.col("_b")).alias("revision_breadth_63"), "paired_brokers", "analyst_available_at")


def by_quarter(keys: tuple[str, ...] = ("cutoff", "ts_code")) -> WindowSpec:
    """One stock's periods as known at one cutoff, ordered by quarter number."""
    return Window.partitionBy(*keys).orderBy(F.year("end_date") * 4 + F.quarter("end_date"))


def quarters_before(x: Column, k: int) -> Column:
    """Value exactly ``k`` quarters earlier, missing when that period is unknown."""
    return F.first(x).over(by_quarter().rangeBetween(-k, -k))


def ttm(x: Column) -> Column:
    """Trailing twelve months: year to date + last full year - last year to date."""
    last_year = quarters_before(x, 4)
    quarter = F.quarter("end_date")
    full = F.when(quarter == 1, quarters_before(x, 1)).when(quarter == 2, quarters_before(x, 2)).otherwise(quarters_before(x, 3))
    return F.when(quarter == 4, x).otherwise(x + full - last_year)


def single_quarter(x: Column) -> Column:
    """Quarter value from year-to-date figures; the first quarter stands as it is."""
    return F.when(F.quarter("end_date") == 1, x).otherwise(x - quarters_before(x, 1))


def with_seasonal_surprise(known: DataFrame, field: str = "n_income_attr_p") -> DataFrame:
    """Year-on-year change of the quarter over the spread of its eight predecessors."""
    q = known.withColumn("_q", single_quarter(F.col(field)))
    d = q.withColumn("_d", F.col("_q") - quarters_before(F.col("_q"), 4))
    past = by_quarter().rangeBetween(-8, -1)
    d = d.withColumns({"_n": F.count("_d").over(past), "_sd": F.stddev_samp("_d").over(past)})
    sue = F.when((F.col("_n") >= 6) & (F.col("_sd") > MIN_SURPRISE_SPREAD), F.col("_d") / F.col("_sd"))
    return d.withColumn("seasonal_sue", sue).drop("_q", "_d", "_n", "_sd")


def financial_factors(income: DataFrame, cashflow: DataFrame, balance: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Surprise and quality factors per cutoff and stock, all cutoffs in one job.

    The whole known history counts: availability is the latest over all earlier
    periods, and a stock whose newest report is old keeps its row.
    """
    keys = ["cutoff", "ts_code"]
    running = by_quarter().rangeBetween(Window.unboundedPreceding, 0)

    def known(df: DataFrame, name: str) -> DataFrame:
        d = known_versions(df, cutoffs.select("cutoff"), ["ts_code", "end_date"])
        return d.withColumn(f"{name}_at", F.max("available_at").over(running))

    capital = F.col("accounts_receiv") + F.col("inventories")
    inc = with_seasonal_surprise(known(income, "income")).withColumns({
        "profit": ttm(F.col("n_income")), "gross": ttm(F.col("revenue")) - ttm(F.col("oper_cost")),
        "old_sales": quarters_before(F.col("revenue"), 4)})
    cf = known(cashflow, "cashflow").withColumn("cash", ttm(F.col("n_cashflow_act")))
    bs = known(balance, "balance").withColumns({
        "assets": (F.col("total_assets") + quarters_before(F.col("total_assets"), 4)) / 2,
        "capital": capital, "old_capital": quarters_before(F.col("accounts_receiv"), 4) + quarters_before(F.col("inventories"), 4)})
    age = F.datediff(F.col("cutoff").cast("date"), "end_date")

    latest = inc.groupBy(*keys).agg(F.max_by(F.struct("end_date", "seasonal_sue", "income_at"), "end_date").alias("s")).select(*keys, "s.*")
    fresh = age <= REPORT_AGE
    surprise = latest.select(*keys, F.when(fresh, F.col("seasonal_sue")).alias("seasonal_sue"), F.when(fresh, F.col("end_date")).alias("sue_period"),
                             F.when(fresh, F.col("income_at")).alias("sue_available_at"))

    period = [*keys, "end_date"]
    common = inc.select(*period, "comp_type", "profit", "gross", "revenue", "old_sales", "income_at").join(
        cf.select(*period, "cash", "cashflow_at"), period).join(
        bs.select(*period, "assets", "capital", "old_capital", "balance_at"), period)
    values = [c for c in common.columns if c not in keys]
    best = common.groupBy(*keys).agg(F.max_by(F.struct(*values), "end_date").alias("q")).select(*keys, "q.*")
    best = best.where((age <= REPORT_AGE) & (F.col("comp_type") == "1") & (F.col("assets") > 0))
    discipline = F.when((F.col("old_capital") > 0) & (F.col("old_sales") > 0),
                        -(F.col("capital") / F.col("old_capital") - F.col("revenue") / F.col("old_sales")))
    quality = best.select(
        *keys, (F.col("cash") / F.col("assets")).alias("cash_profitability"),
        ((F.col("cash") - F.col("profit")) / F.col("assets")).alias("negative_accruals"),
        (F.col("gross") / F.col("assets")).alias("gross_profitability"), discipline.alias("working_capital_discipline"),
        F.col("end_date").alias("quality_period"), F.greatest("income_at", "cashflow_at", "balance_at").alias("quality_available_at"))
    return surprise.join(quality, keys, "left")


def disclosure_events(guidance: DataFrame, income: DataFrame) -> DataFrame:
    """Guidance ranges and original results as events (lower, upper) without contradictions."""
    dated = (F.col("update_flag") == "0") | (F.col("ann_date") > F.col("first_ann_date"))
    low, high = F.col("net_profit_min") * 10000, F.col("net_profit_max") * 10000
    g = guidance.where(dated & (low <= high)).select(
        "ts_code", "end_date", end_of_day(F.col("ann_date")).alias("available_at"),
        low.alias("lower"), high.alias("upper"), F.lit("guidance").alias("source"))
    a = income.where(F.col("report_type").isin("1", "5")).select(
        "ts_code", "end_date", "available_at", F.col("n_income_attr_p").alias("lower"),
        F.col("n_income_attr_p").alias("upper"), F.lit("initial_parent_actual").alias("source"))
    both = g.unionByName(a).where("lower IS NOT NULL AND upper IS NOT NULL")
    return drop_conflicts(both, ["ts_code", "end_date", "available_at"], ["lower", "upper"])


def with_prior_event(events: DataFrame) -> DataFrame:
    """Each event beside the previous one of the same stock and period."""
    w = Window.partitionBy("ts_code", "end_date").orderBy("available_at")
    prior = F.lag(F.struct("available_at", "lower", "upper")).over(w)
    return events.withColumn("_p", prior).select(
        *events.columns, F.col("_p.available_at").alias("prior_available_at"),
        F.col("_p.lower").alias("prior_lower"), F.col("_p.upper").alias("prior_upper"))


def with_intervening(events: DataFrame, express: DataFrame) -> DataFrame:
    """Flag events with an express report between the prior event and this one.

    The last express report at or before the event is enough to decide: there is one
    in between exactly when that last one is not before the prior event.
    """
    quick = express.select("ts_code", "end_date", end_of_day(F.col("ann_date")).alias("express_at"))
    found = asof_backward(events, quick, ["ts_code", "end_date"], "available_at", "express_at", [],
                          bucket="year", matched="_express")
    between = F.col("_express") >= F.col("prior_available_at")
    return found.withColumn("intervening", F.coalesce(between, F.lit(False))).drop("_express")


def with_known_assets(events: DataFrame, balance: DataFrame) -> DataFrame:
    """Latest balance known before the event's day whose period is at most 550 days old."""
    day = F.date_trunc("day", "available_at")
    spread = by_month(
        balance.select("ts_code", F.col("end_date").alias("b_end"), F.col("available_at").alias("b_at"), "total_assets"),
        F.col("b_at"), F.date_add("b_end", REPORT_AGE).cast("timestamp_ntz"), "_m")
    seen = spread.join(
        events.select("ts_code", "end_date", "available_at").withColumn("_m", month_of(day)), ["ts_code", "_m"]
    ).where(
        (F.col("b_at") < day) & (F.col("b_end").cast("timestamp_ntz") < F.col("available_at"))
        & (F.datediff(day, "b_end") <= REPORT_AGE))
    best = seen.groupBy("ts_code", "end_date", "available_at").agg(
        F.max(F.struct("b_end", "b_at", "total_assets")).alias("_b")
    ).select("ts_code", "end_date", "available_at", F.col("_b.total_assets").alias("assets"), F.col("_b.b_at").alias("asset_available_at"))
    return events.join(best, ["ts_code", "end_date", "available_at"], "left")


def disclosure_surprises(guidance: DataFrame, express: DataFrame, income: DataFrame, balance: DataFrame) -> DataFrame:
    """Gap between consecutive company statements of one period over known assets.

    Overlapping ranges carry no sign and score zero; an express report in between
    leaves the surprise missing and says why.
    """
    events = with_prior_event(disclosure_events(guidance, income))
    d = with_known_assets(with_intervening(events, express), balance)
    gap = (
        F.when(F.col("lower") > F.col("prior_upper"), F.col("lower") - F.col("prior_upper"))
        .when(F.col("upper") < F.col("prior_lower"), F.col("upper") - F.col("prior_lower"))
        .otherwise(0.0)
    )
    has_prior = F.col("prior_available_at").isNotNull()
    scored = has_prior & ~F.col("intervening") & F.coalesce(F.col("assets") > 0, F.lit(False))
    reason = (
        F.when(has_prior & F.col("intervening"), "intervening_express_profit_scope_not_certified")
        .when(scored, "nonoverlap_interval_gap_over_known_assets")
        .otherwise("no_prior_comparable_company_disclosure")
    )
    return d.select(
        F.col("ts_code").alias("symbol"), F.col("end_date").alias("period"), "available_at", "source", "lower", "upper",
        "prior_available_at", "prior_lower", "prior_upper",
        F.when(scored, gap / F.col("assets")).alias("incremental_surprise"), reason.alias("reason"),
        F.when(scored, F.col("asset_available_at")).alias("asset_available_at"))


def recent_events(events: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Last event of each stock within 90 days before each cutoff."""
    spread = by_month(events, F.col("available_at"), F.col("available_at") + F.expr(f"INTERVAL {EVENT_AGE} DAY"), "_m")
    seen = spread.join(cutoffs.select("cutoff").withColumn("_m", month_of(F.col("cutoff"))), "_m").where(
        (F.col("available_at") < F.col("cutoff"))
        & (F.col("available_at") >= F.col("cutoff") - F.expr(f"INTERVAL {EVENT_AGE} DAY")))
    best = F.max(F.struct("available_at", "period", "incremental_surprise")).alias("_e")
    return seen.groupBy("cutoff", "symbol").agg(best).select(
        "cutoff", "symbol", "_e.incremental_surprise", F.col("_e.available_at").alias("surprise_available_at"))


def latest_reports(reports: DataFrame, dates: DataFrame, values: list[str]) -> DataFrame:
    """Latest original report per stock before each date, at most 550 days old, no contradictions."""
    originals = reports.where("update_flag = '0'").select("ts_code", "ann_date", "end_date", *values)
    clean = drop_conflicts(originals, ["ts_code", "ann_date", "end_date"], values)
    return latest_within(clean, dates, "ann_date", "end_date", REPORT_AGE, ["ts_code"],
                         ["end_date", "ann_date"], ["ann_date", "end_date", *values])


def annualized(ratio: Column, period: Column) -> Column:
    """Scale a year-to-date ratio to twelve months; odd fiscal months give none."""
    return ratio * F.when(F.month(period).isin(3, 6, 9, 12), F.lit(12.0) / F.month(period))


def positive_inverse(x: Column) -> Column:
    return divide(F.lit(1.0), F.when(x > 0, x))
