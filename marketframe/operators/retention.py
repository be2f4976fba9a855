"""Retention picks: the one choice that depends on the choice before it.

Everything that does not depend on earlier picks is a Spark job: the correlations of
candidate pairs on decision dates. What is left is a small state, the funds held, carried
over the decision dates of a variant; variants run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PICKS = "variant string, date date, place int, symbol string"


def pair_correlations(decisions: DataFrame, returns: DataFrame, window: int, needed: int) -> DataFrame:
    """Correlation of every two candidates of different themes on each decision date.

    ``decisions(date, session_no, symbol, theme)`` are the candidates, ``returns(session_no,
    symbol, ret)`` their history. A candidate's window is spelled out as session numbers, so
    both joins are equi-joins; sessions on which one side has no return drop out. Pairs with
    fewer than ``needed`` common sessions have no row.
    """
    ages = F.explode(F.sequence(F.lit(0), F.lit(window - 1)))
    slots = decisions.select("date", "symbol", "theme", "session_no", ages.alias("age")).select(
        "date", "symbol", "theme", (F.col("session_no") - F.col("age")).alias("session_no"))
    seen = slots.join(returns.select("session_no", "symbol", "ret").where("ret IS NOT NULL"), ["session_no", "symbol"])
    one, other = (seen.select("date", "session_no", *[F.col(c).alias(f"{c}_{s}") for c in ("symbol", "theme", "ret")]) for s in "ab")
    met = one.join(other, ["date", "session_no"]).where("symbol_a < symbol_b AND theme_a <> theme_b")
    together = met.groupBy("date", "symbol_a", "symbol_b").agg(F.count(F.lit(1)).alias("n"), F.corr("ret_a", "ret_b").alias("correlation"))
    return together.where((F.col("n") >= needed) & F.col("correlation").isNotNull() & ~F.isnan("correlation")).select(
        "date", "symbol_a", "symbol_b", "correlation")


def with_relations(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``relations``, a map from the other symbol to the correlation, to each candidate."""
    flipped = pairs.select("date", F.col("symbol_b").alias("symbol"), F.col("symbol_a").alias("other"), "correlation")
    both = pairs.select("date", F.col("symbol_a").alias("symbol"), F.col("symbol_b").alias("other"), "correlation").unionByName(flipped)
    maps = both.groupBy("date", "symbol").agg(F.map_from_entries(F.collect_list(F.struct("other", "correlation"))).alias("relations"))
    return candidates.join(maps, ["date", "symbol"], "left")


def strongest(rows: Iterable, group: str, key) -> list:
    """One row per value of ``group``: the one with the greatest key."""
    best: dict = {}
    for row in rows:
        kept = best.get(getattr(row, group))
        if kept is None or key(row) > key(kept):
            best[getattr(row, group)] = row
    return list(best.values())


def next_picks(day: list, held: list[str], entry_count: int, retain_rank: int, ceiling: float) -> list[str]:
    """The picks of one date, given those before."""
    stays = lambda r: r.symbol in held
    rows = [r for r in day if not (math.isnan(r.score) or math.isnan(r.amount20))]
    per_index = strongest(rows, "index_key", lambda r: (stays(r), r.amount20, -r.position))
    standing = strongest(per_index, "theme", lambda r: (stays(r), r.score, r.amount20, -r.position))
    standing.sort(key=lambda r: (r.score, stays(r), r.amount20, -r.position), reverse=True)
    high = {r.symbol for r in standing[:retain_rank]}
    place = {s: k for k, s in enumerate(held) if s in high}
    queue = sorted(standing, key=lambda r: place.get(r.symbol, len(held)))  # stable: others stay in order of score
    picked: list[str] = []
    for row in queue:
        known = row.relations or {}
        if len(picked) < entry_count and all(known.get(p, math.inf) < ceiling for p in picked):
            picked.append(row.symbol)
    return picked


def retention_picks(candidates: DataFrame, pairs: DataFrame, entry_count: int = 2, retain_rank: int = 5, ceiling: float = 0.85) -> DataFrame:
    """Picks per variant and decision date.

    ``candidates(variant, date, session_no, symbol, position, index_key, theme, score,
    amount20)`` are the eligible funds of each decision date, ``pairs`` their correlations.
    Funds held keep their place while they rank high enough; others enter if their
    correlation with every pick is known and low enough. A variant's group holds its
    candidates on decision dates, no price history.
    """

    def walk(key, group):
        import pandas as pd

        held: list[str] = []
        out = []
        for date, day in group.sort_values(["session_no", "position"]).groupby("date", sort=True):
            held = next_picks(list(day.itertuples(index=False)), held, entry_count, retain_rank, ceiling)
            out += [(key[0], date, k, s) for k, s in enumerate(held, 1)]
        return pd.DataFrame(out, columns=["variant", "date", "place", "symbol"])

    return with_relations(candidates, pairs).groupBy("variant").applyInPandas(walk, PICKS)
