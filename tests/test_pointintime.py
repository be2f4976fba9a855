"""Nothing is visible before it was known."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators import asof, dedup, fundamentals as G

D, T = dt.date, dt.datetime


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", ["day", "month"])
def test_asof_equals_pandas_with_a_hot_key(spark, strict, bucket):
    rng = np.random.default_rng(3)
    start = np.datetime64("2024-01-01T00:00:00")
    n = 600
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdef"), n))
    left = pd.DataFrame({"id": range(n), "k": key, "t": start + rng.integers(0, 90 * 24, n).astype("timedelta64[h]")})
    right = pd.DataFrame({"k": rng.permutation(key), "t": start + rng.integers(0, 90 * 24, n).astype("timedelta64[h]"), "v": range(n)}).drop_duplicates(["k", "t"])
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k", allow_exact_matches=not strict, tolerance=pd.Timedelta(days=3)).set_index("id").v
    ldf = spark.createDataFrame(left).withColumn("t", F.col("t").cast("timestamp_ntz"))
    rdf = spark.createDataFrame(right).withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = asof.asof_backward(ldf, rdf, ["k"], "t", "t", ["v"], bucket=bucket, strict=strict, tolerance="INTERVAL 3 DAY")
    rows = {r.id: r.v for r in got.collect()}
    assert len(rows) == n
    assert rows == {i: None if pd.isna(v) else int(v) for i, v in want.items()}


STATEMENT = "ts_code string, end_date date, ann_date date, f_ann_date date, report_type string, comp_type string, update_flag string, " + ", ".join(f"{c} double" for c in G.INCOME)


def statement(ann, kind="1", update="0", revenue=1.0, code="a", end=D(2022, 12, 31)):
    return (code, end, ann, ann, kind, "1", update, revenue, 1.0, 1.0, 1.0, 1.0, 1.0)


def test_comparatives_wait_for_their_publication_and_conflicts_disappear(spark):
    rows = [statement(D(2023, 4, 1)), statement(D(2024, 4, 1), "4", "1", 2.0), statement(D(2022, 12, 31), "4", "1", 3.0),
            statement(D(2023, 4, 1), code="b"), statement(D(2023, 4, 1), revenue=9.0, code="b"), statement(D(2023, 4, 1), code="c"), statement(D(2023, 4, 1), code="c")]
    p = G.prepare_statements(spark.createDataFrame(rows, STATEMENT), "income")
    assert sorted((r.ts_code, r.revenue) for r in p.collect()) == [("a", 1.0), ("a", 2.0), ("c", 1.0)]
    cut = spark.createDataFrame([(T(2023, 4, 1, 18, 30),), (T(2023, 4, 2, 18, 30),), (T(2024, 5, 2, 18, 30),)], "cutoff timestamp_ntz")
    seen = {(r.cutoff, r.ts_code): r.revenue for r in asof.known_versions(p, cut, ["ts_code", "end_date"]).collect()}
    assert (T(2023, 4, 1, 18, 30), "a") not in seen
    assert seen[T(2023, 4, 2, 18, 30), "a"] == 1.0 and seen[T(2024, 5, 2, 18, 30), "a"] == 2.0


def reports(spark, rows):
    full = [("a", org, rep, f"{y}Q4", np_, T(rep.year, rep.month, rep.day, 9) + dt.timedelta(days=late)) for org, rep, y, np_, late in rows]
    return spark.createDataFrame(full, "ts_code string, org_name string, report_date date, quarter string, np double, create_time timestamp_ntz")


def test_revision_of_three_brokers(spark):
    old, new = D(2023, 3, 1), D(2023, 6, 1)
    rows = [(f"b{i}", old, 2023, 1000.0, 0) for i in range(3)] + [(f"b{i}", new, 2023, 1200.0, 0) for i in range(3)]
    days = spark.createDataFrame([(D(2023, 7, 3), D(2023, 7, 3), D(2023, 4, 3))], "date date, at date, before date")
    r = G.analyst_revision(G.paired_estimates(G.prepare_estimates(reports(spark, rows)), days)).collect()[0]
    assert (r.np_revision_63, r.revision_breadth_63, r.paired_brokers) == (pytest.approx(0.2), 1.0, 3)


def test_late_updates_are_dropped_and_a_newer_missing_number_supersedes(spark):
    rows = [("b0", D(2023, 3, 1), 2023, 1000.0, 0), ("b0", D(2023, 4, 1), 2023, None, 0), ("b1", D(2023, 3, 1), 2023, 500.0, 0), ("b1", D(2023, 4, 1), 2023, 700.0, 9)]
    days = spark.createDataFrame([(D(2023, 5, 4), D(2023, 5, 4), "2023Q4")], "date date, at date, fiscal string")
    got = {r.org_name: r.np_cny for r in G.latest_estimates(G.prepare_estimates(reports(spark, rows)), days).collect()}
    assert got == {"b1": 5_000_000.0}


def test_interval_overlap_is_missing(spark):
    iv = spark.createDataFrame([("a", D(2020, 1, 1), None, "x"), ("a", D(2021, 1, 1), None, "y"), ("b", D(2020, 1, 1), D(2020, 12, 31), "x")],
                               "ts_code string, in_date date, out_date date, l1_code string")
    dates = spark.createDataFrame([(D(2020, 6, 1),), (D(2021, 6, 1),)], "date date")
    got = {(r.date, r.ts_code): r.l1_code for r in asof.unambiguous(asof.valid_on(iv, dates, "in_date", "out_date", True), ["date", "ts_code"], "l1_code").collect()}
    assert got == {(D(2020, 6, 1), "a"): "x", (D(2020, 6, 1), "b"): "x"}


def test_membership_is_strictly_before_and_not_stale(spark):
    m = spark.createDataFrame([(D(2020, 1, 31), "a"), (D(2020, 2, 28), "b")], "snapshot date, symbol string")
    dates = spark.createDataFrame([(D(2020, 1, 31),), (D(2020, 2, 3),), (D(2020, 2, 28),), (D(2020, 4, 20),), (D(2020, 6, 1),)], "date date")
    assert sorted((r.date, r.symbol) for r in asof.members_on(dates, m).collect()) == [(D(2020, 2, 3), "a"), (D(2020, 2, 28), "a"), (D(2020, 4, 20), "b")]


def test_conflict_removal_treats_missing_values_as_equal(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, None), ("b", None, 1.0), ("b", 2.0, 1.0)], "k string, x double, y double")
    assert [tuple(r) for r in dedup.drop_conflicts(df, ["k"], ["x", "y"]).collect()] == [("a", 1.0, None)]


def surprises(spark, guide, quick=()):
    end = D(2023, 12, 31)
    g = spark.createDataFrame([("a", ann, ann, end, "0", lo, hi) for ann, lo, hi in guide],
                              "ts_code string, ann_date date, first_ann_date date, end_date date, update_flag string, net_profit_min double, net_profit_max double")
    e = spark.createDataFrame([("a", end, d) for d in quick], "ts_code string, end_date date, ann_date date")
    inc = spark.createDataFrame([("a", end, T(2024, 4, 1, 23, 59), "1", 1_500_000.0)], "ts_code string, end_date date, available_at timestamp_ntz, report_type string, n_income_attr_p double")
    bal = spark.createDataFrame([("a", D(2023, 9, 30), T(2023, 10, 30, 23, 59), 1e7)], "ts_code string, end_date date, available_at timestamp_ntz, total_assets double")
    return {r.source: r for r in G.disclosure_surprises(g, e, inc, bal).collect()}


def test_surprise_inside_and_above_guidance_and_with_a_report_between(spark):
    assert surprises(spark, [(D(2024, 1, 10), 100.0, 200.0)])["initial_parent_actual"].incremental_surprise == 0.0
    assert surprises(spark, [(D(2024, 1, 10), 50.0, 100.0)])["initial_parent_actual"].incremental_surprise == pytest.approx(0.05)
    r = surprises(spark, [(D(2024, 1, 10), 50.0, 100.0)], [D(2024, 2, 20)])["initial_parent_actual"]
    assert r.incremental_surprise is None and r.reason.startswith("intervening")
