"""Incremental refresh from landed vendor files.

Each micro-batch is normalized and written to its own ``batch=N`` folder with
overwrite, so a replayed batch replaces itself. Readers take the newest version of
every (symbol, date), which lets a later download correct the overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketframe.operators.dedup import keep_last
from marketframe.operators.quality import split_quarantine
from marketframe.sources.bars import BAR_SCHEMA, normalize

VENDOR_SCHEMA = T.StructType([
    T.StructField("ts_code", T.StringType()), T.StructField("trade_date", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("open", "high", "low", "close", "vol", "amount", "adj_factor")],
])


def landed_bars(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed CSV files as a stream of normalized bars."""
    raw = (
        spark.readStream.schema(VENDOR_SCHEMA).option("header", True)
        .option("maxFilesPerTrigger", files_per_batch).csv(folder)
    )
    return normalize(raw)


def start_refresh(bars: DataFrame, table: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Write every batch's usable bars to ``table`` and the others to ``quarantine``; stop when caught up."""

    def write(batch: DataFrame, number: int) -> None:
        good, bad = split_quarantine(batch)
        good.write.mode("overwrite").parquet(f"{table}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_bars(spark: SparkSession, table: str) -> DataFrame:
    """Newest version of every symbol and date."""
    versions = spark.read.schema(T.StructType([*BAR_SCHEMA.fields, T.StructField("batch", T.LongType())])).parquet(table)
    return keep_last(versions, ["symbol", "date"], ["batch"]).drop("batch")
