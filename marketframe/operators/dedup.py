"""Versions of the same fact: keep the last, drop contradictions, reconcile fields.

All of these are aggregates with a map-side part; no key's rows are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order``; equal orders are decided by the other columns."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    return (
        df.groupBy(*keys).agg(F.max(ranked).alias("_r"))
        .select(*[f"_r.{c}" if c in rest else c for c in df.columns])
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    return (
        df.groupBy(*keys).agg(F.min(ranked).alias("_r"))
        .select(*[f"_r.{c}" if c in rest else c for c in df.columns])
    )


def drop_conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Drop exact repeats, then every key that still has more than one version.

    Missing values compare as equal. A key has one version exactly when every value
    column is constant on it: all missing, or none missing and smallest = largest.
    Such a check keeps plain numbers per key and merges before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in values]
    checks, constant = [F.count(F.lit(1)).alias("_n")], F.lit(True)
    for i, c in enumerate(values):
        checks += [F.min(c).alias(f"_a{i}"), F.max(c).alias(f"_b{i}"), F.count(c).alias(f"_c{i}")]
        alike = (F.col(f"_c{i}") == F.col("_n")) & (F.col(f"_a{i}") == F.col(f"_b{i}"))
        constant = constant & ((F.col(f"_c{i}") == 0) | alike)
    if rest:
        checks.append(F.min(F.struct(*rest)).alias("_r"))
    kept = df.groupBy(*keys).agg(*checks).where(constant)
    shown = {**{c: F.col(c) for c in keys}, **{c: F.col(f"_a{i}") for i, c in enumerate(values)},
             **{c: F.col(f"_r.{c}") for c in rest}}
    return kept.select(*[shown[c].alias(c) for c in df.columns])


def reconcile_fields(df: DataFrame, keys: list[str], announced: str, fields: list[str]) -> DataFrame:
    """Per key and field the value of the last announcement that states it.

    A missing field never overrides an earlier fact; contradictory values inside
    the last announcement give a missing field and raise ``reconciliation_error``.
    A field with a single value overall needs no date. Values travel as text.
    """
    def stated(c):
        return F.when(F.col(c).isNotNull(), F.col(announced))

    latest = df.groupBy(*keys).agg(*[F.max(stated(c)).alias(f"_at_{c}") for c in fields])
    in_last = df.join(latest, keys)
    aggregates = []
    for c in fields:
        final = F.when(F.col(announced) == F.col(f"_at_{c}"), F.col(c))
        aggregates += [
            F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}"),
            F.min(final).alias(f"_lo_{c}"), F.max(final).alias(f"_hi_{c}"),
        ]
    g = in_last.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_rows"), *aggregates)
    known = {c: F.col(f"_min_{c}").isNotNull() for c in fields}
    single = {c: F.col(f"_min_{c}") == F.col(f"_max_{c}") for c in fields}
    agreed = {c: F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}")) & F.col(f"_lo_{c}").isNotNull() for c in fields}
    wrong = [known[c] & ~single[c] & ~agreed[c] for c in fields]
    error = wrong[0]
    for w in wrong[1:]:
        error = error | w
    return g.select(
        *keys, "source_rows",
        *[F.when(single[c], F.col(f"_min_{c}")).when(agreed[c], F.col(f"_lo_{c}")).alias(c) for c in fields],
        F.coalesce(error, F.lit(False)).alias("reconciliation_error"),
    )
