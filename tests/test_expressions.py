"""User expressions: what the guard refuses and accepts, and that accepted ones do not look ahead."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketframe.operators import expressions

W = "OVER (PARTITION BY symbol ORDER BY date"
REFUSED = [
    f"lead(close, 1) {W})", f"lag(close, -1) {W})", f"lag(close, 5 - 10) {W})", "max(close) OVER (PARTITION BY symbol)",
    f"avg(close) {W} ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING)", f"avg(close) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    f"last(close) {W} RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "lag(close, 1) OVER (ORDER BY date)",
    "lag(close, 1) OVER (PARTITION BY symbol ORDER BY date DESC)", "avg(close) OVER (PARTITION BY date)", "avg(close) OVER (PARTITION BY symbol, volume ORDER BY date)",
    f"percent_rank() {W})", f"ntile(4) {W})", "close / lag(close, 1) OVER (PARTITION BY symbol ORDER BY volume)", "explode(array(close, 1))",
    f"close + nth_value(close, 3) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    f"CASE WHEN close > 5 THEN 1 ELSE lead(volume) {W}) END"]
ACCEPTED = [
    "close - volume", f"close / lag(close, 20) {W}) - 1", f"avg(close) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    f"max(close) {W} ROWS BETWEEN 9 PRECEDING AND 2 PRECEDING)", f"sum(volume) {W})", f"rank() {W})", f"ln(close) - ln(first(close) {W}))",
    f"if(volume > 5, lag(close) {W}), NULL)"]


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(1)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=n), rng.uniform(5, 9), float(rng.randint(1, 9))) for s in "ab" for n in range(40)]
    return spark.createDataFrame(rows, "symbol string, date date, close double, volume double")


@pytest.mark.parametrize("text", REFUSED)
def test_refused(bars, text):
    with pytest.raises(ValueError):
        expressions.user_factors(bars, {"f": text})


def test_accepted_ones_do_not_change_when_later_rows_do(bars):
    texts = {f"f{i}": t for i, t in enumerate(ACCEPTED)}
    cut = dt.date(2020, 1, 25)
    later = F.col("date") > F.lit(cut)
    moved = bars.withColumns({"close": F.when(later, F.col("close") * 30).otherwise(F.col("close")), "volume": F.when(later, 0.0).otherwise(F.col("volume"))})
    a, b = ({(r.symbol, r.date, r.factor): r.value for r in expressions.user_factors(t, texts).where(~later).collect()} for t in (bars, moved))
    assert a == b and len(a) == 2 * 25 * len(ACCEPTED)


def test_values_are_spark_values(bars):
    got = expressions.user_factors(bars, {"m": f"close / lag(close, 20) {W}) - 1"})
    closes = {(r.symbol, r.date): r.close for r in bars.collect()}
    for r in got.collect():
        before = closes.get((r.symbol, r.date - dt.timedelta(days=20)))
        assert r.value == (None if before is None else pytest.approx(closes[r.symbol, r.date] / before - 1))


def test_wide_tables_are_not_judged(bars):
    wide = bars.select("*", *[F.lit(1.0).alias(f"c{i}") for i in range(200)])
    with pytest.raises(ValueError, match="columns"):
        expressions.refuse_look_ahead(wide, "close + " + " + ".join(f"c{i}" for i in range(200)) + f" + greatest({', '.join(f'c{i}' for i in range(200))})")
