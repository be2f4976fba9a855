"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS the timed
runs per query (3: the first is cold, its code not compiled yet; the median counts, the
cold runs are listed beside it). Each run writes its whole result to Spark's noop sink,
so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "monthly_leaders", "s08_coverage", "q03_key_uniqueness", "p03_rolling_statistics", "p12_p14_risk_features", "j01_calendar_panel",
    "j03_asof_tolerance", "j05_known_versions", "a02_analyst_revision", "a12_trade_statistics", "x05_rank_ic", "x10_controlled_ic",
    "k02_volatility_ceiling", "k03_water_fill", "k08_rotation_allocation", "k19_cash_limited_orders", "l01_account_nav",
    "m01_m05_performance", "b01_sharpe_interval", "g06_quality_factors", "l10_replay_difference", "k18_ridge_scores",
]


def main() -> None:
    from marketframe.plans.catalog import QUERIES
    from marketframe.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=cores, shuffle_partitions=cores)
    QUERIES["monthly_leaders"](spark, folder).write.format("noop").mode("overwrite").save()
    timed: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in HEADLINE:
        spent = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        timed[name], cold[name] = round(statistics.median(spent), 3), round(spent[0], 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timed.values()), 3), "unit": "sec", "queries": timed, "cold": cold,
        "sf": float(scale.group(1)) if scale else None, "cores": cores}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
