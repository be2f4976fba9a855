"""Circular block bootstrap as joins and sums.

A full block contributes the sum over ``block`` consecutive values, which is known
for every start once per curve. A resample is therefore the sum of about N/block
looked-up block sums; only its last, shortened block is spelled out value by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions.timeseries import YEAR_SESSIONS
from marketframe.operators.metrics import daily_rate

# Fixed values of the arithmetic start hash, shared with the SQL twins.
PRIME, MULTIPLIER, RESAMPLE_STEP, BLOCK_STEP = 2147483647, 48271, 7919, 104729


def block_start(seed: int, n: Column) -> Column:
    """Start position in [0, n) of block ``_b`` of resample ``_k``."""
    x = (F.col("_k") * RESAMPLE_STEP + F.col("_b") * BLOCK_STEP + seed) % PRIME
    x = (x * MULTIPLIER) % PRIME
    x = (x * MULTIPLIER) % PRIME
    return x % n


def positions(values: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Number each curve's values from 0 and count them."""
    w = Window.partitionBy(*keys)
    return values.withColumns({
        "_p": (F.row_number().over(w.orderBy(order)) - 1).cast("bigint"),
        "_n": F.count(F.lit(1)).over(w),
    })


def block_sums(values: DataFrame, keys: list[str], columns: list[str], block: int) -> DataFrame:
    """For every start the sums of the next ``block`` values, going round at the end."""
    head = values.where(F.col("_p") < block - 1).withColumn("_p", F.col("_p") + F.col("_n"))
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(0, block - 1)
    around = values.unionByName(head)
    return around.withColumns({c: F.sum(c).over(w) for c in columns}).where(F.col("_p") < F.col("_n"))


def resample(values: DataFrame, keys: list[str], columns: list[str], block: int, resamples: int, seed: int) -> DataFrame:
    """Sums of ``columns`` per resample; ``values`` carries ``_p`` and ``_n``."""
    sizes = values.groupBy(*keys).agg(F.max("_n").alias("_n"))
    draws = (
        sizes.withColumn("_blocks", F.ceil(F.col("_n") / block).cast("bigint"))
        .withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(resamples - 1).cast("bigint"))))
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
        .withColumn("_p", block_start(seed, F.col("_n")))
    )
    rest = F.col("_n") - (F.col("_blocks") - 1) * block
    whole = draws.where((F.col("_b") < F.col("_blocks") - 1) | (rest == block))
    last = (
        draws.where((F.col("_b") == F.col("_blocks") - 1) & (rest < block))
        .withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), rest - 1)))
        .withColumn("_p", (F.col("_p") + F.col("_o")) % F.col("_n"))
    )
    sums = block_sums(values.select(*keys, "_p", "_n", *columns), keys, columns, block).drop("_n")
    picked = whole.select(*keys, "_k", "_p", "_n").join(sums, [*keys, "_p"])
    single = last.select(*keys, "_k", "_p", "_n").join(values.select(*keys, "_p", *columns), [*keys, "_p"])
    picked = picked.unionByName(single)
    return picked.groupBy(*keys, "_k", "_n").agg(*[F.sum(c).alias(c) for c in columns])


def _spread(total: str, squares: str, n: Column) -> Column:
    return F.sqrt((F.col(squares) - F.col(total) * F.col(total) / n) / (n - 1))


def _interval(df: DataFrame, keys: list[str], value: Column, middle: bool = True) -> DataFrame:
    cols = [F.percentile(value, 0.025).alias("lower_95")]
    if middle:
        cols.append(F.percentile(value, 0.5).alias("median"))
    cols.append(F.percentile(value, 0.975).alias("upper_95"))
    return df.groupBy(*keys).agg(*cols)


def bootstrap_sharpe(returns: DataFrame, keys: list[str], rf: float = 0.02, resamples: int = 500, block: int = 20,
                     seed: int = 1729, order: str = "date") -> DataFrame:
    """2.5 %, 50 % and 97.5 % quantiles of the resampled Sharpe ratio; needs 252 returns."""
    r = F.col("ret")
    v = positions(returns.where("ret IS NOT NULL").select(*keys, order, "ret"), keys, order).where(F.col("_n") >= YEAR_SESSIONS)
    s = resample(v.withColumn("_sq", r * r), keys, ["ret", "_sq"], block, resamples, seed)
    n, sd = F.col("_n"), _spread("ret", "_sq", F.col("_n"))
    sharpe = F.when(sd > 1e-12, (F.col("ret") / n - daily_rate(rf)) / sd * YEAR_SESSIONS**0.5)
    return _interval(s, keys, sharpe)


def paired_sharpe(pairs: DataFrame, keys: list[str], rf: float = 0.02, resamples: int = 500, block: int = 20,
                  seed: int = 8192, order: str = "date") -> DataFrame:
    """Interval of the Sharpe difference of two curves under the same blocks (columns ra, rb)."""
    v = positions(pairs.where("ra IS NOT NULL AND rb IS NOT NULL").select(*keys, order, "ra", "rb"), keys, order)
    a, b = F.col("ra"), F.col("rb")
    s = resample(v.withColumns({"_qa": a * a, "_qb": b * b}), keys, ["ra", "rb", "_qa", "_qb"], block, resamples, seed)
    n, free = F.col("_n"), daily_rate(rf)
    gap = (a / n - free) / _spread("ra", "_qa", n) - (b / n - free) / _spread("rb", "_qb", n)
    return _interval(s, keys, gap * YEAR_SESSIONS**0.5)


def block_mean(series: DataFrame, keys: list[str], value: str, block: int, resamples: int = 1000, seed: int = 2031,
               order: str = "date", needed: int = 24) -> DataFrame:
    """Interval of a mean; missing slots keep their place and are left out of the average."""
    v = positions(series.select(*keys, order, F.col(value).cast("double").alias("_v")), keys, order)
    known = F.count("_v").over(Window.partitionBy(*keys))
    v = v.withColumn("_known", known).where(F.col("_known") >= needed).drop("_known")
    v = v.withColumns({"_c": F.col("_v").isNotNull().cast("double"), "_v": F.coalesce("_v", F.lit(0.0))})
    s = resample(v, keys, ["_v", "_c"], block, resamples, seed)
    return _interval(s, keys, F.when(F.col("_c") > 0, F.col("_v") / F.col("_c")), middle=False)
