"""Calendar-aligned panels and the masks that live on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import (
    by_symbol,
    YEAR_SESSIONS,
    change,
    divide,
    flag,
    forward_fill,
    holds,
    rolling_count,
    rolling_max,
    rolling_mean,
    rolling_std,
    rolling_sum,
    running,
)


def number_sessions(dates: DataFrame) -> DataFrame:
    """Distinct dates with their session number, counted from 1.

    The distinct runs distributed; only the calendar itself (about 250 rows a
    year) is ordered in one place.
    """
    return dates.distinct().select(
        "date", F.row_number().over(Window.orderBy("date")).cast("int").alias("session_no")
    )


def calendar_grid(symbols: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every symbol (or other key) on every session, as an equi-join over years.

    Each key emits the calendar's years and meets the sessions of a year, so the
    grid spreads over (key, year) and needs no cross join.
    """
    first = sessions.agg(F.min(F.year("date"))).scalar()
    last = sessions.agg(F.max(F.year("date"))).scalar()
    by_year = symbols.withColumn("_year", F.explode(F.sequence(first, last)))
    return by_year.join(sessions.withColumn("_year", F.year("date")), "_year").drop("_year")


def numbered(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``session_no``. A calendar has at most 366 rows a year, hence the broadcast."""
    return df.join(F.broadcast(sessions), "date")


def session_dates(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add the ``date`` of ``session_no``; the calendar's size is bounded as above."""
    return df.join(F.broadcast(sessions), "session_no")


def complete_panel(bars: DataFrame, sessions: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Reindex bars to the shared calendar; a session without a bar stays missing.

    Each bar also emits the sessions up to the next bar of its key (the first one the
    sessions before it, the last one the sessions after it). That needs one shuffle by
    key, which the windows on the panel then share, and reads the bars only once.
    """
    w = Window.partitionBy(*keys).orderBy("session_no")
    end = sessions.agg(F.max("session_no")).scalar()
    d = numbered(bars, sessions).withColumn("_end", end)
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("session_no"))
    until = F.coalesce(F.lead("session_no").over(w) - 1, F.col("_end"))
    spans = d.withColumn("_no", F.sequence(first, until)).withColumn("_no", F.explode("_no"))
    own = F.col("_no") == F.col("session_no")
    values = [c for c in bars.columns if c not in (*keys, "date")]
    filled = spans.select(*keys, F.col("_no").alias("session_no"), *[F.when(own, F.col(c)).alias(c) for c in values])
    return session_dates(filled, sessions).select(*keys, "date", "session_no", *values)


def rebase_to_first_factor(bars: DataFrame) -> DataFrame:
    """Total-return OHLC: each price times factor / first factor of the symbol."""
    whole = Window.partitionBy("symbol")
    first = F.min_by("adj_factor", "date").over(whole)
    ratio = F.col("adj_factor") / first
    return bars.withColumns({c: F.col(c) * ratio for c in ("open", "high", "low", "close")})


def mark_prices(panel: DataFrame) -> DataFrame:
    """Add the valuation price, its return and its absolute move.

    Prices are forward filled for valuation only; eligibility looks at real bars.
    """
    marked = panel.withColumn("marked", forward_fill(F.col("close")))
    m = F.col("marked")
    return marked.withColumns({"ret": change(m), "move": F.abs(m - F.lag(m).over(by_symbol()))})


def rotation_features(panel: DataFrame, min_history: int, min_amount: float) -> DataFrame:
    """Momentum, trend, risk and eligibility of every symbol on filled marks."""
    m, r = F.col("marked"), F.col("ret")
    annual = YEAR_SESSIONS**0.5
    loss = F.when(r.isNotNull(), F.least(r, F.lit(0.0)))
    marked = mark_prices(panel).withColumns({"loss2": loss * loss, "vol": rolling_std(r, 60) * annual})
    return marked.select(
        "symbol", "date", "session_no", "open", "close", "amount", "volume", "marked", "ret", "vol",
        (F.sqrt(rolling_mean(F.col("loss2"), 60)) * annual).alias("downside"),
        *[change(m, k).alias(f"mom{k}") for k in (21, 63, 126, 252)],
        *[trend_distance(m, k).alias(f"trend{k}") for k in (60, 120, 200)],
        trend_efficiency(m, F.col("move"), 63).alias("efficiency"),
        drawdown_from_high(m, 126).alias("drawdown"),
        (fixed_eligibility(min_history, min_amount) & F.col("vol").isNotNull()).alias("eligible"),
    )


def trend_distance(m: Column, window: int) -> Column:
    return divide(m, rolling_mean(m, window)) - 1


def trend_efficiency(m: Column, move: Column, window: int) -> Column:
    """Absolute net move over the sum of absolute moves; ``move`` is a finished column."""
    return divide(F.abs(m - F.lag(m, window).over(by_symbol())), rolling_sum(move, window))


def drawdown_from_high(m: Column, window: int) -> Column:
    return divide(m, rolling_max(m, window)) - 1


def skip_momentum(p: Column, skip: int, legs: tuple[int, ...]) -> Column:
    """Mean of returns over several legs, all ending ``skip`` sessions ago."""
    parts = [divide(F.lag(p, skip).over(by_symbol()), F.lag(p, leg).over(by_symbol())) - 1 for leg in legs]
    return sum(parts[1:], parts[0]) / len(legs)


def fixed_eligibility(min_history: int, min_amount: float) -> Column:
    """Observed now, seasoned, liquid over 20 sessions and traded today."""
    return (
        F.col("close").isNotNull()
        & (running(F.count, F.col("close")) >= min_history)
        & holds(rolling_mean(F.col("amount"), 20) >= min_amount)
        & holds(F.col("volume") > 0)
    )


def trend_vote(x: Column, windows: tuple[int, ...], strict: bool = False) -> Column:
    """Share of moving averages the value is at or above (strictly above if asked)."""
    votes = [
        flag(x > rolling_mean(x, w)) if strict else flag(x >= rolling_mean(x, w)) for w in windows
    ]
    return sum(votes[1:], votes[0]) / len(windows)


def stock_eligibility(
    max_lot_price: float | None, min_amount: float, observed: int = 253, window: int = 270, amount_days: int = 15
) -> Column:
    """Stock rule: 253 of 270 sessions observed, liquid, affordable, traded and quoted today."""
    price = F.col("close") * F.col("adj_factor")
    ok = holds(rolling_count(price, window) >= observed)
    ok &= holds(rolling_mean(F.col("amount"), 20, amount_days) >= min_amount)
    ok &= holds(F.col("volume") > 0) & price.isNotNull()
    return ok if max_lot_price is None else ok & holds(F.col("close") * 100 <= max_lot_price)


def sector_eligibility(min_history: int, min_amount: float) -> Column:
    """Fund rule: seasoned, 120 of 126 sessions observed, liquid and traded today."""
    close = F.col("close")
    return (
        close.isNotNull()
        & (running(F.count, close) >= min_history)
        & holds(F.when(rolling_count(F.col("session_no"), 126) >= 126, rolling_count(close, 126)) >= 120)
        & holds(rolling_mean(F.col("amount"), 20) >= min_amount)
        & holds(F.col("volume") > 0)
    )


def listed_on(date: Column, listing: Column, delisting: Column) -> Column:
    """From the listing date on, and only before the delisting date."""
    return holds(date >= listing) & (delisting.isNull() | (date < delisting))


def first_of(unit: str, sessions: DataFrame) -> DataFrame:
    """Flag the first session of each week (starting Monday) or month; the first row counts."""
    w = Window.orderBy("date")
    period = F.date_trunc(unit, "date")
    before = F.date_trunc(unit, F.lag("date").over(w))
    return sessions.withColumn("decision", before.isNull() | (period != before))


def month_firsts(sessions: DataFrame) -> DataFrame:
    """First session of each month with its session number."""
    return sessions.groupBy(F.trunc("date", "MM").alias("month")).agg(
        F.min("date").alias("date"), F.min("session_no").alias("session_no")
    )


def sessions_around(calendar: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Last open day up to a cutoff's ``day`` and the first one after it.

    The open days form one sorted array (bounded by the calendar), so a cutoff
    finds its neighbours without a range join.
    """
    days = calendar.where("is_open = 1").agg(F.array_sort(F.collect_list("cal_date"))).scalar()
    return (
        cutoffs.withColumn("days", days)
        .select(
            "cutoff",
            F.array_max(F.filter("days", lambda d: d <= F.col("day"))).alias("signal_date"),
            F.array_min(F.filter("days", lambda d: d > F.col("day"))).alias("execution_date"),
        )
    )


def freeze_mask(reference: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions on which a plan may be made.

    A month's first session counts only while the reference asset's 20-bar input
    is complete; the very first plan is made on the first healthy session.
    """
    healthy = F.col("close").isNotNull() & rolling_mean(F.col("amount"), 20).isNotNull()
    state = reference.select("date", healthy.alias("healthy"))
    decisions = first_of("month", sessions).select("date", "decision")
    joined = decisions.join(state, "date", "left").withColumn("healthy", holds(F.col("healthy")))
    start = joined.where("healthy").agg(F.min("date")).scalar()
    due = F.col("decision") | (F.col("date") == F.col("start"))
    ok = (F.col("date") >= F.col("start")) & due & F.col("healthy")
    return joined.withColumn("start", start).select("date", holds(ok).cast("int").alias("plan"))


def relative_strength(scores: DataFrame, benchmark: str, columns: list[str]) -> DataFrame:
    """Mean difference to the benchmark symbol's values on the same date."""
    base = scores.where(F.col("symbol") == benchmark).select("date", *[F.col(c).alias(f"_b_{c}") for c in columns])
    parts = [F.col(c) - F.col(f"_b_{c}") for c in columns]
    joined = scores.join(base, "date")
    return joined.withColumn("relative", sum(parts[1:], parts[0]) / len(parts)).drop(*[f"_b_{c}" for c in columns])


def seasoned_since(bars: DataFrame, n: int) -> DataFrame:
    """Date of each symbol's n-th bar (its last one if there are fewer) and the latest of these."""
    place = F.row_number().over(by_symbol())
    per = bars.select("symbol", "date", place.alias("_k")).where(F.col("_k") <= n).groupBy("symbol").agg(F.max("date").alias("date"))
    return per.withColumn("all_seasoned", per.agg(F.max("date")).scalar())
