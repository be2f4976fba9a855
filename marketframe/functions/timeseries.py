"""Windows over one symbol's sessions: lags, fills and rolling statistics.

A window partition holds one row per session, so its size is bounded by the
calendar and never by the volume of trades behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

YEAR_SESSIONS = 252


def ordered(*keys: str, by: str | Column = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def by_symbol() -> WindowSpec:
    """One symbol's sessions in date order: the default window of this module."""
    return ordered("symbol")


def divide(a: Column, b: Column) -> Column:
    """Quotient that is missing when the divisor is zero, in ANSI mode as well."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(x: Column) -> Column:
    """Missing instead of NaN or an infinity."""
    infinity = F.lit(float("inf"))
    return F.when(~F.isnan(x) & (F.abs(x) != infinity), x)


def clip(x: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bound a value; a missing value stays missing."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low) if not isinstance(low, Column) else low)
    if high is not None:
        out = F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    return F.when(x.isNotNull(), out)


def holds(condition: Column) -> Column:
    """A comparison with a missing side counts as false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return holds(condition).cast("double")


def rolling(
    fn: Callable[[Column], Column],
    x: Column,
    window: int,
    min_periods: int | None = None,
    over: WindowSpec | None = None,
) -> Column:
    """``fn`` over the last ``window`` sessions, missing below ``min_periods`` values."""
    frame = (over or by_symbol()).rowsBetween(1 - window, Window.currentRow)
    needed = window if min_periods is None else min_periods
    return F.when(F.count(x).over(frame) >= needed, fn(x).over(frame))


def rolling_mean(x, window, min_periods=None, over=None):
    return rolling(F.avg, x, window, min_periods, over)


def rolling_std(x, window, min_periods=None, over=None):
    return rolling(F.stddev_samp, x, window, min_periods, over)


def rolling_sum(x, window, min_periods=None, over=None):
    return rolling(F.sum, x, window, min_periods, over)


def rolling_max(x, window, min_periods=None, over=None):
    return rolling(F.max, x, window, min_periods, over)


def rolling_count(x, window, over=None):
    return F.count(x).over((over or by_symbol()).rowsBetween(1 - window, Window.currentRow))


def running(fn, x, over=None):
    return fn(x).over((over or by_symbol()).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def change(x: Column, k: int = 1, over: WindowSpec | None = None) -> Column:
    return divide(x, F.lag(x, k).over(over or by_symbol())) - 1


def forward_fill(x: Column, over: WindowSpec | None = None) -> Column:
    """Last known value, for valuation only; never a sign of eligibility."""
    frame = (over or by_symbol()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(x, ignorenulls=True).over(frame)


def forward_fill_limited(x: Column, limit: int, over: WindowSpec | None = None) -> Column:
    """Forward fill over at most ``limit`` missing sessions."""
    frame = (over or by_symbol()).rowsBetween(-limit, Window.currentRow)
    return F.last(x, ignorenulls=True).over(frame)


def rolling_percent_rank(x: Column, window: int, min_periods: int, over: WindowSpec | None = None) -> Column:
    """Average-tie percentile rank of the current value among the last ``window`` values.

    Costs O(window) per row, so it is meant for index series, not for every stock.
    """
    frame = (over or by_symbol()).rowsBetween(1 - window, Window.currentRow)
    seen = F.collect_list(x).over(frame)
    below = F.size(F.filter(seen, lambda v: v < x))
    equal = F.size(F.filter(seen, lambda v: v == x))
    n = F.size(seen)
    return F.when(x.isNotNull() & (n >= min_periods), (below + (equal + 1) / 2) / n)


# --- expression vocabulary for factors on a symbol's own rows -----------------


def _positive(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, (int, float)) or n < 1:
        raise ValueError("lookback windows are positive literals; forward references are not allowed")
    return int(n)


def ref(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    return F.lag(x, _positive(n)).over(over or by_symbol())


delay = ref


def delta(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    return x - ref(x, n, over)


def ts_mean(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    return rolling_mean(x, _positive(n), over=over)


def ts_std(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    return rolling_std(x, _positive(n), over=over)
