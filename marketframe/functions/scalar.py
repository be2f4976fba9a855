"""Row-level rules: fees, drift bands, lots, tradability, text classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dated tax and transfer-fee steps and their rates.
STAMP_CUT = "2023-08-28"
STAMP_BEFORE, STAMP_AFTER = 0.001, 0.0005
TRANSFER_STEP_2 = "2022-04-29"
TRANSFER_STEP_1 = "2015-08-01"
TRANSFER_LATEST, TRANSFER_MIDDLE = 0.00001, 0.00002
TRANSFER_EARLY_PER_SHARE, TRANSFER_EARLY_PER_VALUE = 0.0003, 0.0000255


def fee(notional: Column, bps: float, minimum: float, multiplier: float = 1.0) -> Column:
    return F.greatest(F.lit(float(minimum)), F.abs(notional) * bps / 10000) * multiplier


def stamp_tax(notional: Column, side: Column, date: Column) -> Column:
    rate = F.when(date >= F.lit(STAMP_CUT).cast("date"), STAMP_AFTER).otherwise(STAMP_BEFORE)
    return F.when(side == "SELL", notional * rate).otherwise(F.lit(0.0))


def transfer_fee(notional: Column, quantity: Column, symbol: Column, date: Column) -> Column:
    early = F.when(symbol.endswith(".SH"), quantity * TRANSFER_EARLY_PER_SHARE).otherwise(
        notional * TRANSFER_EARLY_PER_VALUE
    )
    return (
        F.when(date >= F.lit(TRANSFER_STEP_2).cast("date"), notional * TRANSFER_LATEST)
        .when(date >= F.lit(TRANSFER_STEP_1).cast("date"), notional * TRANSFER_MIDDLE)
        .otherwise(early)
    )


def rebalance_needed(
    target: Column, current: Column, band: float, relative: float | None = None, minimum_band: float = 0.005
) -> Column:
    """Entries and full exits always pass; otherwise the drift must reach the band."""
    none = F.lit(1e-12)
    limit = F.lit(float(band))
    if relative is not None:
        limit = F.least(limit, F.greatest(F.lit(minimum_band), target * relative))
    return (
        F.when((target <= none) & (current <= none), False)
        .when((target <= none) | (current <= none), True)
        .otherwise(F.abs(target - current) >= limit)
    )


def risk_exit_due(target: Column, current: Column, ratio: float | None) -> Column:
    if ratio is None:
        return F.lit(False)
    return (current > 1e-12) & (target < current * ratio)


def tradable_at_open(price: Column, up: Column, down: Column, side: Column) -> Column:
    known = price.isNotNull() & up.isNotNull() & down.isNotNull()
    return F.when(~known, False).otherwise(
        F.when(side == "BUY", price < up - 1e-8).otherwise(price > down + 1e-8)
    )


def locked_bar(high: Column, low: Column) -> Column:
    return high == low


def round_to_lot(quantity: Column, lot: int) -> Column:
    return F.floor(quantity / lot) * lot


def volume_cap(volume: Column, participation: float, lot: int) -> Column:
    return round_to_lot(volume * participation, lot)


def classify(text: Column, rules: list[tuple[str, str]], exclude: str) -> Column:
    """First matching rule names the class; an excluded text has none."""
    out = None
    for name, pattern in rules:
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(text.rlike(exclude), None).otherwise(out)


def micros_after(date: Column, moment: Column) -> Column:
    """Microseconds from the start of a date to a zone-free timestamp, whatever the session's zone."""
    seconds = F.datediff(moment.cast("date"), date).cast("bigint") * 86400 + F.hour(moment) * 3600 + F.minute(moment) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), moment) * 1000000).cast("bigint")
