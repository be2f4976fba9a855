"""Rules for landed vendor files: normalizing, sibling fills, page checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_from_sibling(
    listed: DataFrame, sibling: DataFrame, code: str, name: str, fields: list[str], listing: str
) -> DataFrame:
    """Missing fields from the other record with the same code, only where the names agree.

    When the listing dates disagree the later one counts, and the row says so.
    """
    other = sibling.select(
        code, F.col(name).alias("_name"), *[F.col(f).alias(f"_{f}") for f in (*fields, listing)])
    same = F.col(name) == F.col("_name")
    date = F.when(same, F.col(f"_{listing}"))
    joined = listed.join(other, code, "left")
    filled = {f: F.coalesce(f, F.when(same, F.col(f"_{f}"))) for f in fields}
    return joined.withColumns({
        **filled,
        "effective_list_date": F.greatest(F.col(listing), date),
        "listing_date_conflict": F.coalesce(F.col(listing) != date, F.lit(False)),
    }).drop("_name", *[f"_{f}" for f in (*fields, listing)])


def page_report(pages: DataFrame, page: str, date: str, low, high, cap: int) -> DataFrame:
    """Per landed page: rows, bounds kept, cap reached, and whether another page repeats it.

    Pages are reduced to order-free hashes, so equal pages meet by a small join of
    hashes and never row by row.
    """
    h = F.xxhash64(*[F.col(c) for c in sorted(pages.columns) if c != page])
    each = pages.withColumn("_h", h).groupBy(page).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("_h").alias("_x"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("_s"),
        (F.min(date) >= low).alias("_a"), (F.max(date) <= high).alias("_b"))
    same = each.groupBy("rows", "_x", "_s").agg(F.count(F.lit(1)).alias("_n"))
    return each.join(same, ["rows", "_x", "_s"]).select(
        page, "rows", (F.col("_a") & F.col("_b")).cast("int").alias("in_bounds"),
        (F.col("rows") >= cap).cast("int").alias("at_cap"), (F.col("_n") > 1).cast("int").alias("repeated"))


def combine_partitions(parts: list[DataFrame], universe: DataFrame, key: str) -> DataFrame:
    """One table from partition files: union, drop exact duplicates, keep the universe."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.dropDuplicates().join(universe.select(key).distinct(), key, "left_semi")


def universe_audit(meta: DataFrame, latest_listing) -> DataFrame:
    """Counts of an asset universe: themed, candidates, retired, without or with contradictory listing."""
    theme = F.col("theme").isNotNull()
    candidate = theme & F.coalesce(F.col("listing") <= latest_listing, F.lit(False))
    return meta.agg(
        F.count(F.lit(1)).alias("codes"), F.count_if(theme).alias("theme_candidates"), F.count_if(candidate).alias("download_candidates"),
        F.count_if(candidate & F.col("retired")).alias("retired_candidates"), F.count_if(F.col("listing").isNull()).alias("missing_listing"),
        F.count_if(F.col("listing_conflict")).alias("listing_conflicts"), F.count_if(~theme).alias("unknown_theme"))
