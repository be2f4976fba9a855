"""Curve, share, benchmark and bar series: readers' rules and completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Curve and tenor of each study column.
CURVE_COLUMNS = {"gov_1y": ("gov", "1y"), "gov_3y": ("gov", "3y"), "gov_10y": ("gov", "10y"), "aaa_3y": ("aaa", "3y")}


def curve_columns(curves: DataFrame, columns: dict[str, tuple[str, str]] = CURVE_COLUMNS) -> DataFrame:
    """Chosen curve points as columns, one row per date."""
    point = F.concat_ws("_", "curve", "tenor")
    names = {f"{c}_{t}": name for name, (c, t) in columns.items()}
    wide = curves.select("date", point.alias("point"), "yield").groupBy("date").pivot("point", list(names)).agg(F.first("yield"))
    return wide.withColumnsRenamed(names)


def incomplete_halves(curves: DataFrame, needed: int = 20) -> DataFrame:
    """Half-year and curve partitions with too few rows, a repeated point or a missing yield."""
    half = F.concat_ws("H", F.year("date").cast("string"), F.when(F.month("date") <= 6, "1").otherwise("2"))
    points = curves.groupBy(half.alias("half"), "curve", "tenor", "date").agg(
        F.count(F.lit(1)).alias("copies"), F.count("yield").alias("known"))
    return points.groupBy("half", "curve", "tenor").agg(
        F.count(F.lit(1)).alias("rows"), F.max("copies").alias("copies"), F.min("known").alias("known"),
    ).where((F.col("rows") < needed) | (F.col("copies") > 1) | (F.col("known") < 1)).select("half", "curve", "tenor", "rows")


def share_manifest(shares: DataFrame) -> DataFrame:
    """Rows, span, size and distinct dates of each symbol's share history."""
    return shares.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.count_distinct("date").alias("dates"), F.max("total_share").alias("largest"))


def uncovered_sessions(sessions: DataFrame, index: DataFrame) -> DataFrame:
    """Sessions a benchmark series lacks; it must be empty before the series is used."""
    return sessions.select("date").join(index.select("date"), "date", "left_anti")


def append_tail(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """History plus the fresh rows after its last date."""
    return history.unionByName(fresh.where(F.col("date") > F.coalesce(
        history.agg(F.max("date")).scalar(), F.lit("0001-01-01").cast("date"))))
