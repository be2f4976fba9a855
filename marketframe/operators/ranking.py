"""Exact percentile ranks in groups of any size.

A window over a whole group sorts it in one task. Here equal values are counted first, the
counts are summed in narrow buckets of the value, the buckets of a group (at most a fixed
number) get running totals, and only the values of one bucket are ordered together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Buckets per factor e (a bucket spans about 0.1 % of its values), and a number
# above that of all buckets between one and the smallest double.
RESOLUTION = 1024
ONE = 1 << 20


def bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises; not-a-number lies in the last bucket."""
    x = value.cast("double")
    size = F.floor(F.ln(F.abs(x)) * RESOLUTION) + ONE
    far = F.lit(4 * ONE)
    size = F.when(F.abs(x) < F.lit(float("inf")), size).otherwise(far)
    return F.when(F.isnan(x), far).when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def _met(left: DataFrame, right: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    """Join on columns of both sides, a null equal to a null, without the right side's."""
    rule = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in on.items()])
    return left.join(right, rule, how).drop(*on.values())


def average_ranks(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row per key and known value: the keys as ``__k0`` and so on, ``__v`` and ``__rank``."""
    own = [f"__k{i}" for i in range(len(keys))]
    again = {k: f"{k}_" for k in [*own, "__b"]}
    counts = df.where(F.col(column).isNotNull()).groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(column).alias("__v"))
    counts = counts.agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", bucket(F.col("__v")))
    whole = Window.partitionBy(*own)
    sizes = counts.groupBy(*own, "__b").agg(F.sum("__n").alias("__size")).withColumns({
        "__below": F.sum("__size").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"),
        "__all": F.sum("__size").over(whole)})
    inside = Window.partitionBy(*own, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = _met(counts.withColumn("__upto", F.sum("__n").over(inside)), sizes.withColumnsRenamed(again), again, "inner")
    first = F.col("__below") + F.col("__upto") - F.col("__n") + 1
    return placed.select(*own, "__v", ((first + (F.col("__n") - 1) / 2) / F.col("__all")).alias("__rank"))


def with_spread_ranks(df: DataFrame, columns: list[str], keys: list[str], suffix: str = "_rank") -> DataFrame:
    """Average-tie percentile rank of each column among a key's rows, however many a key has.

    A missing value has no rank and takes no part, a missing key is a key of its own, and
    not-a-number ranks above all numbers. Rows keep their number and columns.
    """
    for c in columns:
        own = {k: f"__k{i}" for i, k in enumerate(keys)} | {c: "__v"}
        df = _met(df, average_ranks(df, c, keys), own, "left").withColumnRenamed("__rank", c + suffix)
    return df


def with_subset_ranks(df: DataFrame, whole: DataFrame, column: str, among: dict[str, Column], group: str) -> DataFrame:
    """Average-tie percentile ranks of ``column`` among several subsets of a group at once, a column for each name in ``among``.

    ``among`` has a subset's condition on the row; rows outside it and missing values have no rank. ``group`` is never
    null (a struct of keys may hold nulls). ``whole`` has the rows of ``df`` and gives the totals of the buckets, so
    that calls in a row need not compute ``df`` again. Rows are shuffled once, by group and bucket; a missing value
    goes to a bucket by the hash of its row.
    """
    x = F.col(column)
    flags = {n: F.when(x.isNotNull() & c, 1).otherwise(0) for n, c in among.items()}
    totals = whole.where(x.isNotNull()).groupBy(group, bucket(x).alias("__b")).agg(*[F.sum(f).alias(f"__n_{n}") for n, f in flags.items()])
    every = Window.partitionBy(group)
    running = every.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select(group, "__b", *[e for n in among for e in (
        (F.sum(f"__n_{n}").over(running) - F.col(f"__n_{n}")).alias(f"__below_{n}"), F.sum(f"__n_{n}").over(every).alias(f"__all_{n}"))])
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != group]), F.lit(4 * ONE)) + 8 * ONE
    placed = df.withColumn("__b", F.when(x.isNull(), spread).otherwise(bucket(x)))
    placed = placed.join(totals.hint("shuffle_hash"), [group, "__b"], "left")
    order = Window.partitionBy(group, "__b").orderBy(column)  # a range takes in the ties of a value; one sort serves both
    inside, ties = order.rangeBetween(Window.unboundedPreceding, Window.currentRow), order.rangeBetween(Window.currentRow, Window.currentRow)
    placed = placed.withColumns({k: v for n, f in flags.items() for k, v in {f"__upto_{n}": F.sum(f).over(inside), f"__ties_{n}": F.sum(f).over(ties)}.items()})
    ranks = [F.when(f == 1, (F.col(f"__below_{n}") + F.col(f"__upto_{n}") - (F.col(f"__ties_{n}") - 1) / 2) / F.col(f"__all_{n}")).alias(n)
             for n, f in flags.items()]
    return placed.select(*df.columns, *ranks)
