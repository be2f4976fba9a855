"""Data-quality checks. Each returns the offending rows or one row of counts.

Everything is a filter, an anti join or an aggregate with a map-side part, so a
check costs one pass whatever the size of a single symbol or file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField
from pyspark.sql.window import Window

from marketframe.functions.scalar import micros_after
from marketframe.operators.dedup import keep_last
from marketframe.operators.panel import numbered, session_dates

PRICES = ("open", "high", "low", "close")
TOLERANCE = 1e-8


def bar_faults() -> Column:
    """Array of the rules a bar breaks; empty for a valid bar."""
    values = [F.col(c) for c in (*PRICES, "volume", "amount", "adj_factor")]
    infinite = F.lit(float("inf"))
    broken = [c.isNull() | F.isnan(c) | (F.abs(c) == infinite) for c in values]
    odd = broken[0]
    for b in broken[1:]:
        odd = odd | b
    rules = {
        "non_finite": odd,
        "nonpositive_price_or_factor": F.least(*PRICES, "adj_factor") <= 0,
        "negative_volume_or_amount": F.least("volume", "amount") < 0,
        "high_below_bar": F.col("high") + TOLERANCE < F.greatest("open", "close", "low"),
        "low_above_bar": F.col("low") - TOLERANCE > F.least("open", "close", "high"),
    }
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def invalid_bars(bars: DataFrame) -> DataFrame:
    return bars.withColumn("faults", bar_faults()).where(F.size("faults") > 0)


def quarantine_reason() -> Column:
    return (
        F.when(F.col("adj_factor").isNull(), "source_missing_adjustment_factor")
        .when((F.col("volume") == 0) & (F.col("amount") == 0), "zero_volume_placeholder")
        .when(F.size(bar_faults()) > 0, "invalid_ohlc")
    )


def split_quarantine(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable bars, and the others with the reason they are kept out."""
    tagged = bars.withColumn("reason", quarantine_reason())
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def merge_quarantine(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Quarantine upsert: the newer record of a key replaces the older one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_last(both, keys, ["_new"]).drop("_new")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Raise if a key occurs twice; the check stops at the first offending key."""
    if duplicate_keys(df, keys).limit(1).count():
        raise ValueError(f"{name}: duplicate keys in {keys}")
    return df


def mislabelled(df: DataFrame, expected: dict[str, list]) -> DataFrame:
    """Rows whose labels are not among the requested ones."""
    wrong = None
    for column, allowed in expected.items():
        bad = ~F.coalesce(F.col(column).isin(allowed), F.lit(False))
        wrong = bad if wrong is None else wrong | bad
    return df.where(wrong)


def calendar_gaps(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions between a symbol's first and last bar that have no bar.

    A gap shows as a jump of the session number from one bar to the next.
    """
    w = Window.partitionBy("symbol").orderBy("session_no")
    d = numbered(bars.select("symbol", "date"), sessions).withColumn("_next", F.lead("session_no").over(w))
    jumps = d.where(F.col("_next") > F.col("session_no") + 1)
    missing = jumps.select("symbol", F.explode(F.sequence(F.col("session_no") + 1, F.col("_next") - 1)).alias("session_no"))
    return session_dates(missing, sessions).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("missing"), F.min("date").alias("first_gap"), F.max("date").alias("last_gap"))


def before_listing(bars: DataFrame, listings: DataFrame) -> DataFrame:
    return bars.join(listings, "symbol").where("date < listing")


def freshness(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Whether each symbol's latest bar is of the last session and was traded."""
    last = bars.groupBy("symbol").agg(F.max_by(F.struct("date", "volume"), "date").alias("b"))
    expected = sessions.agg(F.max("date")).scalar()
    ready = (F.col("b.date") == expected) & (F.col("b.volume") > 0)
    return last.select("symbol", F.col("b.date").alias("last_date"), ready.cast("int").alias("fresh"))


def wrong_membership(members: DataFrame, expected: int) -> DataFrame:
    """Snapshots whose number of distinct members is not the expected one."""
    return (members.groupBy("snapshot").agg(F.count_distinct("symbol").alias("members"))
            .where(F.col("members") != expected))


def snapshot_audit(bars: DataFrame, factors: DataFrame, limits: DataFrame, members: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: size, span, members, rows without factor or limit, original share, thinnest quarter."""
    joined = bars.select("symbol", "date").join(
        factors.select("symbol", "date", F.lit(1).alias("_f")), ["symbol", "date"], "left"
    ).join(limits.select("symbol", "date", F.lit(1).alias("_l")), ["symbol", "date"], "left")
    size = joined.agg(
        F.count_distinct("symbol").alias("stocks"), F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"),
        F.max("date").alias("last"), F.count_if(F.col("_f").isNull()).alias("missing_adjustment_rows"),
        F.count_if(F.col("_l").isNull()).alias("missing_limit_rows"))
    quarters = reports.groupBy("end_date").agg(F.count_distinct("ts_code").alias("n"))
    return size.withColumns({
        "membership_snapshots": members.agg(F.count_distinct("snapshot")).scalar(),
        "original_report_fraction": reports.agg(F.avg((F.col("update_flag") == "0").cast("double"))).scalar(),
        "thinnest_quarter": quarters.agg(F.min("n")).scalar(),
    })


def column_profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Rows, nulls, distinct values, smallest and largest value of each column, as text.

    The table is read once: each row is turned into (column, value) pairs that are
    combined before the shuffle. Distinct values are counted by grouping, or with a
    sketch for columns with very many values.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns])).alias("p")).select("p.*")
    if approximate:
        return pairs.groupBy("field").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("missing"),
            F.approx_count_distinct("v").alias("unique_values"), F.min("v").alias("smallest"), F.max("v").alias("largest"))
    values = pairs.groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("field").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("v").alias("unique_values"), F.min("v").alias("smallest"), F.max("v").alias("largest"))


def lag_profile(reports: DataFrame) -> DataFrame:
    """Reporting lag in days, its median and maximum, late rows and malformed quarters.

    The lags are counted per distinct value first, so the median works on the few
    distinct lags and not on all rows.
    """
    lag = micros_after(F.col("report_date"), F.col("create_time")) / (86400 * 1000000)
    bad = ~F.coalesce(F.regexp_like("quarter", F.lit("^[0-9]{4}Q[1-4]$")), F.lit(False))
    d = reports.select(lag.alias("lag"), bad.cast("int").alias("bad"))
    counts = d.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    return counts.agg(
        F.sum("n").alias("rows"), F.percentile("lag", F.lit(0.5), F.col("n")).alias("lag_days_median"),
        F.max("lag").alias("lag_days_max"), F.sum(F.when(F.col("lag") > 7, F.col("n")).otherwise(0)).alias("lag_above_7_days"),
        F.sum("bad").alias("invalid_quarter"))


def canonical(df: DataFrame) -> Column:
    """A row as text, the same in every engine: columns by name, numbers as decimals, times in microseconds, nulls apart from any text."""
    def text(field: StructField) -> Column:
        c, kind = F.col(field.name), field.dataType.typeName()
        if kind in ("double", "float"):
            c = c.cast("decimal(38,6)")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.unix_micros(c.cast("timestamp"))
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))

    return F.concat_ws("|", *[text(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def range_fingerprints(df: DataFrame, name: str, key: str, width: int) -> DataFrame:
    """Order-free fingerprints of a table by ranges of ``width`` keys: rows, and the sum of 60 bits of each row's MD5.

    Sums and counts of ranges add up to those of wider ranges and of the table, so the
    fingerprints of parts that are written apart can be merged (see ``merged_fingerprints``).
    """
    digest = F.conv(F.substring(F.md5(canonical(df).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(F.floor(F.col(key) / width).cast("long").alias("range"), digest.alias("h")).groupBy("range").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("h").alias("digest")).select(F.lit(name).alias("table"), "range", "rows", "digest")


def merged_fingerprints(prints: DataFrame, factor: int | None = None) -> DataFrame:
    """Fingerprints of ranges ``factor`` times as wide, or of whole tables."""
    at = F.floor(F.col("range") / factor).cast("long") if factor else F.lit(0).cast("long")
    return prints.groupBy("table", at.alias("range")).agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ranges whose fingerprint differs between two manifests, or that exist in only one."""
    b, a = before.alias("b"), after.alias("a")
    j = b.join(a, ["table", "range"], "full_outer")
    same = F.col("b.rows").eqNullSafe(F.col("a.rows")) & F.col("b.digest").eqNullSafe(F.col("a.digest"))
    return j.where(~same).select("table", "range", F.coalesce("b.rows", F.lit(0)).alias("rows_before"), F.coalesce("a.rows", F.lit(0)).alias("rows_after"))


def causality_breaks(pipeline: Callable[[DataFrame], DataFrame], source: DataFrame, cutoff: str,
                     columns: list[str], digits: int = 9) -> DataFrame:
    """Rows of ``pipeline`` up to a cutoff that change when later input is removed."""
    limit = F.lit(cutoff).cast("date")

    def shown(df: DataFrame) -> DataFrame:
        floats = {f.name for f in df.schema if f.dataType.typeName() == "double"}
        return df.where(F.col("date") <= limit).select(*[
            F.round(F.col(c), digits).alias(c) if c in floats else F.col(c) for c in columns])

    full = shown(pipeline(source))
    truncated = shown(pipeline(source.where(F.col("date") <= limit)))
    return full.exceptAll(truncated).unionByName(truncated.exceptAll(full))


def table_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Largest absolute difference per column and rows present on one side only."""
    left = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_la"))
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_lb"))
    j = left.join(right, keys, "full_outer")
    return j.agg(
        *[F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))).alias(c) for c in columns],
        F.count_if(F.col("_lb").isNull()).alias("only_left"), F.count_if(F.col("_la").isNull()).alias("only_right"))


def target_violations(targets: DataFrame, assets: DataFrame, cap: float, group_caps: dict[str, float]) -> DataFrame:
    """Dates whose weights are negative, above the cap, above one in sum, or above a group cap."""
    w = targets.join(assets.select("symbol", "bucket"), "symbol")
    limit = F.create_map(*[F.lit(x) for kv in group_caps.items() for x in kv])
    group = w.groupBy("strategy_id", "date", "bucket").agg(
        F.sum("weight").alias("s"), F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    day = group.groupBy("strategy_id", "date").agg(
        F.sum("s").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max(F.col("s") - F.try_element_at(limit, F.col("bucket"))).alias("excess"))
    rules = {"negative": F.col("lo") < -1e-10, "above_cap": F.col("hi") > cap + 1e-8,
             "above_one": F.col("total") > 1 + 1e-8, "above_group_cap": F.col("excess") > 1e-8}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return day.withColumn("violations", found).where(F.size("violations") > 0).select("strategy_id", "date", "violations")


def asset_faults(assets: DataFrame) -> DataFrame:
    """One row of counts: duplicate symbols, weights outside [0, 0.30], total above one."""
    per = assets.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("a"), F.max("weight").alias("b"), F.sum("weight").alias("s"))
    return per.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_symbols"), F.count_if((F.col("a") < 0) | (F.col("b") > 0.30)).alias("weights_out_of_range"),
        (F.sum("s") > 1 + 1e-9).cast("int").alias("total_above_one"))


def conflicting_kinds(universes: DataFrame, column: str = "kind") -> DataFrame:
    """Symbols that appear with different kinds in a union of universes."""
    return universes.groupBy("symbol").agg(F.count_distinct(column).alias("kinds")).where("kinds > 1")


def bad_bounds(caps: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Dates without a bound or with one outside the allowed range."""
    return caps.where(F.col(column).isNull() | F.isnan(column) | ~F.col(column).between(low, high))
