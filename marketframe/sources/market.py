"""Market tables derived from the order-flow tables.

The given star schema has no price bars, so they are built from trades: a line
item is a trade of a brand (or a part type) on its order date. Everything below
is lazy; the large work is one pass over ``lineitem`` joined to ``orders`` and
``part``, with partial aggregation before the shuffle to (symbol, date).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import clip
from marketframe.operators.panel import complete_panel, number_sessions
from marketframe.session import cut_lineage, write_once

# The allocation universe of six part types.
TYPE_ASSETS = [
    # position, symbol, bucket, weight
    (1, "ECONOMY", "cn_equity", 0.20),
    (2, "LARGE", "us_equity", 0.15),
    (3, "MEDIUM", "hk_equity", 0.05),
    (4, "PROMO", "gold", 0.20),
    (5, "SMALL", "bond", 0.30),
    (6, "STANDARD", "commodity", 0.10),
]


def exact(x: Column) -> Column:
    """Decimal view of a two-digit amount, so that sums do not depend on order."""
    return x.cast("decimal(18,2)")


def traded() -> list[Column]:
    """What a bar keeps of its trades; mergeable, so finer groups can be brought together by ``merged``."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return [F.min(price).alias("low"), F.max(price).alias("high"), F.sum(exact(F.col("l_extendedprice"))).alias("amount"),
            F.sum(exact(F.col("l_quantity"))).alias("volume")]


def merged() -> list[Column]:
    return [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("amount").alias("amount"), F.sum("volume").alias("volume")]


def priced(daily: DataFrame) -> DataFrame:
    """Bars from ``traded`` rows of symbol and date."""
    age = F.datediff("date", F.lit("1995-01-01").cast("date")) + 30 * F.length("symbol")
    amount, volume = F.col("amount").cast("double"), F.col("volume").cast("double")
    return daily.select(
        "symbol", "date", ((F.col("low") + F.col("high")) / 2).alias("open"), "high", "low", (amount / volume).alias("close"),
        volume.alias("volume"), amount.alias("amount"), (1 + 0.05 * F.floor(age / 365)).alias("adj_factor"))


class Market:
    """Lazy tables over one data folder; every table is declared at most once per query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._memo: dict = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._memo[name]

    def _once(self, key, build):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def settle(self, key, build) -> DataFrame:
        """Write a table once that several branches of a plan read again and again."""
        settled = ("settled", key)
        if settled not in self._memo:
            self._memo[settled] = self._memo[key] = cut_lineage(build())
        return self._memo[settled]

    def store(self, key, build) -> DataFrame:
        """Like ``settle``, for tables about as large as the trades, and for small ones whose readers should know their size."""
        stored = ("stored", key)
        if stored not in self._memo:
            self._memo[stored] = self._memo[key] = write_once(build(), key if isinstance(key, str) else "-".join(map(str, key)))
        return self._memo[stored]

    def store_trades(self, *columns: str) -> None:
        """Join the trades once, with the columns that a query reads, when several of its branches read all of them."""
        self.trades = self.store("trades", lambda: self.trades.select(*columns, "date"))

    def store_sessions(self) -> None:
        """Write the calendar once, when many branches of a query would each read the orders for it."""
        self.sessions = self.store("sessions", lambda: self.sessions)

    # --- calendar ---------------------------------------------------------

    @cached_property
    def sessions(self) -> DataFrame:
        """date, session_no (from 1)."""
        return number_sessions(self.table("orders").select(F.col("o_orderdate").cast("date").alias("date")))

    @cached_property
    def calendar(self) -> DataFrame:
        """cal_date 'yyyyMMdd', is_open over all days between first and last session."""
        span = self.sessions.agg(F.min("date").alias("a"), F.max("date").alias("b"))
        days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
        return (
            days.join(self.sessions, "date", "left")
            .select(
                F.date_format("date", "yyyyMMdd").alias("cal_date"),
                F.col("session_no").isNotNull().cast("int").alias("is_open"),
            )
        )

    # --- trades and bars ---------------------------------------------------

    @cached_property
    def trades(self) -> DataFrame:
        """One row per line item with its order date, account and symbols."""
        return (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .withColumn("date", F.col("o_orderdate").cast("date"))
        )

    def bars(self, by: str) -> DataFrame:
        """Daily bars of ``by`` (``p_brand``: 25 symbols with gaps, ``p_type``: 6 symbols)."""

        def build():
            return priced(self.trades.groupBy(F.col(by).alias("symbol"), "date").agg(*traded()))

        return self._once(("bars", by), build)

    def panel(self, by: str) -> DataFrame:
        """Bars on the shared calendar: one row per symbol and session, gaps missing."""
        return self._once(("panel", by), lambda: complete_panel(self.bars(by), self.sessions))

    def adjusted(self, by: str) -> DataFrame:
        """Panel with total-return prices rebased to each symbol's first factor."""

        def build():
            from marketframe.operators.panel import rebase_to_first_factor

            return complete_panel(rebase_to_first_factor(self.bars(by)), self.sessions)

        return self._once(("adjusted", by), build)

    # --- assets ------------------------------------------------------------

    @cached_property
    def type_assets(self) -> DataFrame:
        """symbol, position, bucket, weight of the part types that occur."""
        known = F.create_map(*[x for p, s, b, w in TYPE_ASSETS for x in (F.lit(s), F.struct(
            F.lit(p).alias("position"), F.lit(b).alias("bucket"), F.lit(w).alias("weight")))])
        return (
            self.table("part").select(F.col("p_type").alias("symbol")).distinct()
            .select("symbol", known[F.col("symbol")].alias("a"))
            .where("a IS NOT NULL")
            .select("symbol", "a.position", "a.bucket", "a.weight")
        )

    @cached_property
    def brand_assets(self) -> DataFrame:
        """symbol, position, bucket, weight of the brands: 3 % each, bucket by position."""
        position = F.substring("symbol", 7, 9).cast("int")
        bucket = (
            F.when(position <= 5, "cn_equity").when(position <= 10, "us_equity")
            .when(position <= 12, "hk_equity").when(position <= 15, "gold")
            .when(position <= 20, "bond").otherwise("commodity")
        )
        return (
            self.table("part").select(F.col("p_brand").alias("symbol")).distinct()
            .select("symbol", position.alias("position"), bucket.alias("bucket"), F.lit(0.03).alias("weight"))
        )

    def nav(self) -> DataFrame:
        """Candidate curves: compounded, bounded daily returns of each part type."""
        w = Window.partitionBy("symbol").orderBy("date")
        r = F.ln(F.col("close") / F.lag("close").over(w)) / 50
        bounded = F.coalesce(clip(r, -0.03, 0.03), F.lit(0.0))
        return (
            self.bars("p_type").select("symbol", "date", bounded.alias("r"))
            .select(
                F.col("symbol").alias("strategy_id"),
                "date",
                (1000000 * F.exp(F.sum(F.log1p("r")).over(
                    w.rowsBetween(Window.unboundedPreceding, 0)))).alias("equity"),
            )
        )
