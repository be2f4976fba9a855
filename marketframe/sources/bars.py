"""Bar tables: reading, validated writing, refreshing, coverage, source preference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.operators.quality import duplicate_keys, invalid_bars
from marketframe.session import cut_lineage

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount", "adj_factor")],
])
OVERLAP_DAYS = 40


def read_bars(spark: SparkSession, path: str, assets: DataFrame) -> DataFrame:
    """Bars of the wanted symbols; the year partitions and columns prune at the scan."""
    bars = spark.read.schema(BAR_SCHEMA).parquet(path)
    return bars.join(assets.select("symbol"), "symbol", "left_semi")


def absent_symbols(bars: DataFrame, assets: DataFrame) -> DataFrame:
    """Wanted symbols without a single bar."""
    return assets.select("symbol").join(bars.select("symbol").distinct(), "symbol", "left_anti")


def require_all(bars: DataFrame, assets: DataFrame) -> DataFrame:
    missing = absent_symbols(bars, assets).limit(5).collect()
    if missing:
        raise ValueError(f"no bars for {[r.symbol for r in missing]}; refresh the table first")
    return bars


def write_bars(bars: DataFrame, path: str) -> None:
    """Write bars by year after the checks; the commit protocol makes the swap atomic.

    With dynamic partition overwrite only the years present in ``bars`` are replaced. The
    bars are computed once; checks and write read the settled table.
    """
    bars = cut_lineage(bars)
    if invalid_bars(bars).limit(1).count():
        raise ValueError("invalid bars; nothing was written")
    if duplicate_keys(bars, ["symbol", "date"]).limit(1).count():
        raise ValueError("duplicate symbol and date; nothing was written")
    (bars.withColumn("year", F.year("date")).repartition("year", "symbol").sortWithinPartitions("symbol", "date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path))


def normalize(raw: DataFrame) -> DataFrame:
    """Vendor bars to the bar schema: names, dates, numbers, lots to shares, thousands to units."""
    number = {c: F.expr(f"try_cast({c} AS double)") for c in ("open", "high", "low", "close", "vol", "amount", "adj_factor")}
    return raw.select(
        F.col("ts_code").alias("symbol"), F.to_date(F.col("trade_date").cast("string"), "yyyyMMdd").alias("date"),
        number["open"].alias("open"), number["high"].alias("high"), number["low"].alias("low"), number["close"].alias("close"),
        (number["vol"] * 100).alias("volume"), (number["amount"] * 1000).alias("amount"), number["adj_factor"].alias("adj_factor"))


def attach_factor(raw: DataFrame, factors: DataFrame, constant_for: DataFrame | None = None) -> DataFrame:
    """Left join of the factor; symbols in ``constant_for`` (indexes) get 1."""
    joined = raw.join(factors.select("ts_code", "trade_date", "adj_factor"), ["ts_code", "trade_date"], "left")
    if constant_for is None:
        return joined
    fixed = joined.join(constant_for.select("ts_code", F.lit(1).alias("_fixed")), "ts_code", "left")
    return fixed.withColumn("adj_factor", F.when(F.col("_fixed") == 1, 1.0).otherwise(F.col("adj_factor"))).drop("_fixed")


def refresh_starts(old: DataFrame, days: int = OVERLAP_DAYS) -> DataFrame:
    """Per symbol the first date to load again."""
    return old.groupBy("symbol").agg(F.date_sub(F.max("date"), days).alias("start"))


def merge_refresh(old: DataFrame, new: DataFrame, days: int = OVERLAP_DAYS) -> DataFrame:
    """Old rows strictly before the overlap, new rows from it on."""
    starts = refresh_starts(old, days)
    kept = old.join(starts, "symbol").where("date < start").drop("start")
    fresh = new.join(starts, "symbol", "left").where("start IS NULL OR date >= start").drop("start")
    return kept.unionByName(fresh)


def coverage(bars: DataFrame) -> DataFrame:
    """Rows, first and last date of each symbol."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).orderBy("symbol")


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of ``first``, and of ``second`` the symbols that ``first`` lacks."""
    rest = second.join(first.select("symbol").distinct(), "symbol", "left_anti")
    return first.unionByName(rest)


def usable_universe(bars: DataFrame, core: DataFrame, min_rows: int = 127) -> DataFrame:
    """Symbols outside the core with their row count and whether it suffices."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    outside = n.join(core.select("symbol"), "symbol", "left_anti")
    return outside.withColumn("usable", (F.col("rows") >= min_rows).cast("int"))
