"""Point-in-time joins: nothing is visible before it was known.

Two patterns replace range joins. A backward as-of join is a union, one sort and a
running last value; it works on (key, time bucket) groups, so a key that holds a
third of all rows is still spread over its buckets. Validity intervals and age
limits are turned into the calendar months they touch, which makes them equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTOFF_HOUR, CUTOFF_MINUTE = 18, 30


def end_of_day(date: Column) -> Column:
    """Last representable moment of a date."""
    return F.date_add(date, 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")


def cutoff_of(date: Column) -> Column:
    """Knowledge cutoff on a session: 18:30."""
    return date.cast("timestamp_ntz") + F.expr(f"INTERVAL '{CUTOFF_HOUR}:{CUTOFF_MINUTE}' HOUR TO MINUTE")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    values: list[str],
    bucket: str = "month",
    strict: bool = False,
    tolerance: str | None = None,
    matched: str = "matched_at",
) -> DataFrame:
    """Give each left row the values of the last right row at or before its time.

    ``strict`` asks for a right time before the left time; ``tolerance`` is an
    interval such as ``INTERVAL 7 DAY``. Equal right times are ordered by the
    values. ``bucket`` is the ``date_trunc`` unit that splits a key: rows find
    their match inside the bucket, or else take the last right row of earlier
    buckets, which a small (key, bucket) table carries forward.
    """
    right_side = F.struct(F.col(right_on).alias(matched), *values)
    left_side = F.struct(*left.columns)
    left_type = left.select(left_side.alias("x")).schema[0].dataType
    right_type = right.select(right_side.alias("x")).schema[0].dataType
    left_order, right_order = (0, 1) if strict else (1, 0)
    rows = left.select(
        *by, F.col(left_on).alias("_t"), F.lit(left_order).alias("_side"),
        left_side.alias("_left"), F.lit(None).cast(right_type).alias("_right"),
    ).unionAll(
        right.select(
            *by, F.col(right_on).alias("_t"), F.lit(right_order).alias("_side"),
            F.lit(None).cast(left_type).alias("_left"), right_side.alias("_right"),
        )
    ).withColumn("_bucket", F.date_trunc(bucket, "_t")).repartition(*by, "_bucket")

    inside = Window.partitionBy(*by, "_bucket").orderBy("_t", "_side", "_right").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = rows.withColumn("_in", F.last("_right", ignorenulls=True).over(inside)).where("_left IS NOT NULL")

    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # asks for the same columns as ``found``: Spark then computes and shuffles the rows once for both
    lasts = rows.groupBy(*by, "_bucket").agg(
        F.max("_right").alias("_last"), F.count("_left").alias("_lefts"), F.max("_t").alias("_until"), F.max("_side").alias("_top"))
    carried = (
        lasts.where("_lefts >= 0 AND (_until IS NULL OR _top >= 0)")
        .select(*by, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
        .where("_before IS NOT NULL")
    )
    keys = [*by, "_bucket"]
    before = carried.select(*[F.col(k).alias(f"_at_{k}") for k in keys], "_before")
    # null-safe, as the windows group; a plain equality would filter one use of the rows only
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    joined = found.join(before, same, "left").select(
        "_left.*", "_t", F.coalesce("_in", "_before").alias("_match")
    )
    if tolerance is not None:
        recent = F.col(f"_match.{matched}") >= F.col("_t") - F.expr(tolerance)
        joined = joined.withColumn("_match", F.when(recent, F.col("_match")))
    return joined.select(*left.columns, *[f"_match.{c}" for c in (matched, *values)])


def lag_one_session(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Shift columns one whole session, so a value acts only on the next one."""
    w = Window.partitionBy(*keys).orderBy("date")
    return df.withColumns({c: F.lag(c).over(w) for c in columns})


def by_month(df: DataFrame, start: Column, end: Column, name: str = "month") -> DataFrame:
    """Repeat each row for the calendar months its interval touches."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("INTERVAL 1 MONTH"))
    return df.where(start <= end).withColumn(name, F.explode(months))


def month_of(date: Column) -> Column:
    return F.trunc(date, "MM")


def known_versions(
    versions: DataFrame, cutoffs: DataFrame, keys: list[str], max_age_months: int | None = None,
    period: str = "end_date",
) -> DataFrame:
    """Latest version of each key known strictly before each cutoff.

    A version is in force from its ``available_at`` until the next version of the
    same key; ``cutoffs`` carries ``cutoff``. With ``max_age_months`` only periods
    that ended at most so many months before a cutoff are kept.

    Cutoffs are dates of a calendar, so all of them fit one value: each version picks its
    own from that list, and a version that no cutoff asks for costs one row and no join.
    """
    w = Window.partitionBy(*keys).orderBy("available_at")
    asked = cutoffs.agg(F.collect_list(F.struct(*cutoffs.columns))).scalar()
    since, until = F.col("available_at"), F.col("_next")

    def due(c: Column) -> Column:
        met = (since < c["cutoff"]) & (until.isNull() | (c["cutoff"] <= until))
        if max_age_months is not None:
            met &= month_of(F.col(period)) >= F.add_months(month_of(c["cutoff"]), -max_age_months)
        return met

    spans = versions.withColumn("_next", F.lead("available_at").over(w)).withColumn("_asked", asked)
    out = spans.withColumn("_cutoff", F.explode(F.filter("_asked", due)))
    return out.select(*versions.columns, "_cutoff.*")


def latest_within(
    dated: DataFrame, dates: DataFrame, known: str, aged: str, max_age_days: int,
    keys: list[str], order: list[str], values: list[str],
) -> DataFrame:
    """Per date and key the greatest row by ``order`` among rows known strictly before
    the date whose ``aged`` date lies at most ``max_age_days`` before it."""
    spread = by_month(dated, F.col(known), F.date_add(F.col(aged).cast("date"), max_age_days), "_month")
    seen = spread.join(dates.withColumn("_month", month_of(F.col("date"))), "_month").where(
        (F.col(known) < F.col("date"))
        & (F.col(aged) <= F.col("date"))
        & (F.col(aged) >= F.date_sub("date", max_age_days))
    )
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return seen.groupBy(*dates.columns, *keys).agg(best).select(*dates.columns, *keys, "_v.*")


def valid_on(intervals: DataFrame, dates: DataFrame, start: str, end: str, strict_start: bool = False) -> DataFrame:
    """Intervals in force on each date; an open end is still in force."""
    horizon = dates.agg(F.max("date")).scalar()
    open_end = intervals.withColumn("_horizon", horizon).withColumn(
        "_until", F.least(F.coalesce(end, "_horizon"), "_horizon"))
    spread = by_month(open_end, F.col(start), F.col("_until"), "_month")
    begun = F.col(start) < F.col("date") if strict_start else F.col(start) <= F.col("date")
    return (
        spread.join(dates.withColumn("_month", month_of(F.col("date"))), "_month")
        .where(begun & (F.col(end).isNull() | (F.col(end) >= F.col("date"))))
        .drop("_month", "_until", "_horizon")
    )


def unambiguous(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keep keys with exactly one distinct value; contradictory keys go missing."""
    return (
        df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
        .where("_a = _b").select(*keys, F.col("_a").alias(value))
    )


def snapshot_on(dates: DataFrame, snapshots: DataFrame, max_age_days: int = 62) -> DataFrame:
    """Most recent snapshot date strictly before each date, at most so old."""
    one = [x.withColumn("_k", F.lit(1)) for x in (dates, snapshots.select("snapshot").distinct())]
    found = asof_backward(one[0], one[1], ["_k"], "date", "snapshot", [], bucket="year", strict=True,
                          tolerance=f"INTERVAL {max_age_days} DAY", matched="membership_date")
    return found.drop("_k").where("membership_date IS NOT NULL")


def members_on(dates: DataFrame, members: DataFrame, max_age_days: int = 62) -> DataFrame:
    """Members of the snapshot in force on each date; ``members(snapshot, symbol)``."""
    at = snapshot_on(dates, members, max_age_days)
    return at.join(members.withColumnRenamed("snapshot", "membership_date"), "membership_date")
