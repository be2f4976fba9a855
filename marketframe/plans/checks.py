"""Sources, sinks, data quality, set operations, scalar rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.functions import scalar
from marketframe.operators import panel as P, quality as Q
from marketframe.plans.features import LISTING, fund_shares, listings
from marketframe.plans.registry import frame, part, query, roll
from marketframe.session import work_folder
from marketframe.sources import bars as B, disclosures as D, series, vendor
from marketframe.sources.market import Market

# Damaged copies of the bars: the checks must find every kind of fault.
part("damaged_bars", """
SELECT symbol, date, open, CASE WHEN day(date) = 3 THEN close * 0.5::DOUBLE ELSE high END AS high, CASE WHEN day(date) = 4 THEN -1 ELSE low END AS low, close,
       CASE WHEN day(date) = 5 THEN 0 ELSE volume END AS volume, CASE WHEN day(date) = 5 THEN 0 WHEN day(date) = 6 THEN -5 ELSE amount END AS amount,
       CASE WHEN day(date) = 7 THEN NULL ELSE adj_factor END AS adj_factor FROM brand_bars""")
part("bar_faults", """
SELECT symbol, date, list_filter([
    CASE WHEN adj_factor IS NULL THEN 'non_finite' END,
    CASE WHEN least(open, high, low, close, adj_factor) <= 0 THEN 'nonpositive_price_or_factor' END,
    CASE WHEN least(volume, amount) < 0 THEN 'negative_volume_or_amount' END,
    CASE WHEN high + 1e-8 < greatest(open, close, low) THEN 'high_below_bar' END,
    CASE WHEN low - 1e-8 > least(open, close, high) THEN 'low_above_bar' END], lambda x: x IS NOT NULL) AS faults, adj_factor, volume, amount FROM damaged_bars""")


def damaged_bars(m: Market) -> DataFrame:
    day = F.dayofmonth("date")
    return m.bars("p_brand").select(
        "symbol", "date", "open", F.when(day == 3, F.col("close") * 0.5).otherwise(F.col("high")).alias("high"),
        F.when(day == 4, -1.0).otherwise(F.col("low")).alias("low"), "close",
        F.when(day == 5, 0.0).otherwise(F.col("volume")).alias("volume"),
        F.when(day == 5, 0.0).when(day == 6, -5.0).otherwise(F.col("amount")).alias("amount"),
        F.when(day != 7, F.col("adj_factor")).alias("adj_factor"))


@query("q01_bar_validity", "SELECT symbol, date, array_to_string(faults, ',') AS faults FROM bar_faults WHERE len(faults) > 0", dates="date")
def bar_validity(m):
    return Q.invalid_bars(damaged_bars(m)).select("symbol", "date", F.array_join("faults", ",").alias("faults"))


@query("q02_quarantine",
       """SELECT reason, count(*) AS n, min(date) AS first, max(date) AS last FROM (SELECT date, CASE WHEN adj_factor IS NULL THEN 'source_missing_adjustment_factor'
          WHEN volume = 0 AND amount = 0 THEN 'zero_volume_placeholder' WHEN len(faults) > 0 THEN 'invalid_ohlc' ELSE 'good' END AS reason FROM bar_faults) GROUP BY reason""",
       dates="first last")
def quarantine(m):
    good, bad = Q.split_quarantine(damaged_bars(m))
    both = good.select("date", F.lit("good").alias("reason")).unionByName(bad.select("date", "reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("q02_quarantine_upsert",
       """SELECT symbol, date, reason FROM (SELECT symbol, date, reason, row_number() OVER (PARTITION BY symbol, date ORDER BY new DESC) AS n FROM (
            SELECT symbol, date, 'old record' AS reason, 0 AS new FROM damaged_bars WHERE adj_factor IS NULL OR volume = 0
            UNION ALL SELECT symbol, date, 'source_missing_adjustment_factor', 1 FROM damaged_bars WHERE adj_factor IS NULL)) WHERE n = 1""", dates="date")
def quarantine_upsert(m):
    d = damaged_bars(m)
    old = d.where("adj_factor IS NULL OR volume = 0").select("symbol", "date", F.lit("old record").alias("reason"))
    new = Q.split_quarantine(d)[1].where("adj_factor IS NULL").select("symbol", "date", "reason")
    return Q.merge_quarantine(old, new, ["symbol", "date"])


@query("q03_key_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_uniqueness(m):
    return Q.duplicate_keys(m.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("q04_label_check", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def label_check(m):
    return Q.mislabelled(m.table("events"), {"event_type": ["view", "click", "purchase"]}).select("event_id", "event_type")


@query("q05_calendar_gaps",
       """SELECT p.symbol, count(*) AS missing, min(p.date) AS first_gap, max(p.date) AS last_gap FROM brand_panel p
          JOIN (SELECT symbol, min(date) AS a, max(date) AS b FROM brand_bars GROUP BY symbol) s ON s.symbol = p.symbol AND p.date BETWEEN a AND b WHERE close IS NULL GROUP BY p.symbol""",
       dates="first_gap last_gap")
def calendar_gaps(m):
    return Q.calendar_gaps(m.bars("p_brand"), m.sessions)


@query("q06_before_listing", f"SELECT b.symbol, count(*) AS n FROM brand_bars b JOIN ({LISTING}) l USING (symbol) WHERE b.date < l.listing GROUP BY b.symbol")
def before_listing(m):
    return Q.before_listing(m.bars("p_brand"), listings(m)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("q07_freshness",
       "SELECT symbol, max(date) AS last_date, (max(date) = (SELECT max(date) FROM sessions) AND arg_max(volume, date) > 0)::INT AS fresh FROM brand_bars GROUP BY symbol",
       dates="last_date")
def freshness(m):
    return Q.freshness(m.bars("p_brand"), m.sessions)


@query("q08_snapshot_audit",
       """SELECT count(DISTINCT symbol) AS stocks, count(*) AS rows, min(date) AS first, max(date) AS last, count(*) FILTER (day(date) = 7) AS missing_adjustment_rows,
          count(*) FILTER (NOT (high > low)) AS missing_limit_rows, (SELECT count(DISTINCT snapshot) FROM members) AS membership_snapshots,
          (SELECT avg((update_flag = '0')::INT) FROM statements) AS original_report_fraction, (SELECT min(n) FROM (SELECT count(DISTINCT ts_code) AS n FROM statements GROUP BY end_date)) AS thinnest_quarter
          FROM brand_bars""", floats="original_report_fraction", dates="first last")
def snapshot_audit(m):
    b = m.bars("p_brand")
    return Q.snapshot_audit(b, b.where(F.dayofmonth("date") != 7), b.where("high > low"), D.members(m), D.statements(m))


@query("q09_member_count", "SELECT snapshot, count(DISTINCT symbol) AS members FROM (SELECT * FROM members WHERE NOT (symbol = 'Brand#2' AND month(snapshot) = 5)) GROUP BY snapshot HAVING count(DISTINCT symbol) <> 12",
       dates="snapshot")
def member_count(m):
    hole = (F.col("symbol") == "Brand#2") & (F.month("snapshot") == 5)
    return Q.wrong_membership(D.members(m).where(~hole), 12)


@query("q10_column_profile",
       " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS unique_values, min({c}::VARCHAR) AS smallest, max({c}::VARCHAR) AS largest FROM lineitem"
                          for c in ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")))
def column_profile(m):
    return Q.column_profile(m.table("lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])


@query("q11_lag_profile",
       """SELECT count(*) AS rows, median(lag) AS lag_days_median, max(lag) AS lag_days_max, count(*) FILTER (lag > 7) AS lag_above_7_days, count(*) FILTER (NOT regexp_full_match(quarter, '[0-9]{4}Q[1-4]')) AS invalid_quarter
          FROM (SELECT (epoch(create_time) - epoch(CAST(report_date AS TIMESTAMP))) / 86400 AS lag, quarter FROM analyst_reports)""",
       floats="lag_days_median lag_days_max")
def lag_profile(m):
    return Q.lag_profile(D.analyst_reports(m))


def canonical_sql(columns: dict[str, str], changed: dict[str, str] | None = None) -> str:
    """SQL of a row's text; ``columns`` are name: kind (text, number, time)."""
    shown = {"text": "CAST({} AS VARCHAR)", "number": "CAST(CAST({} AS DECIMAL(38,6)) AS VARCHAR)", "time": "CAST(epoch_us({}) AS VARCHAR)"}
    return " || '|' || ".join(f"coalesce('=' || {shown[k].format((changed or {}).get(c, c))}, '-')" for c, k in sorted(columns.items()))


ORDERS = {"o_orderkey": "text", "o_custkey": "text", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "time", "o_orderpriority": "text"}
LINES = {"l_orderkey": "text", "l_partkey": "text", "l_suppkey": "text", "l_linenumber": "text", "l_quantity": "number", "l_extendedprice": "number",
         "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"}
#: Keys in a range.
KEYS = 1000


def prints_sql(table: str, key: str, columns: dict[str, str], changed: dict[str, str] | None = None, where: str = "true") -> str:
    digest = f"('0x' || substr(md5({canonical_sql(columns, changed)}), 1, 15))::BIGINT"
    return f"""SELECT '{table}' AS "table", floor({key} / {KEYS})::BIGINT AS range, count(*) AS rows, sum({digest}::HUGEINT) AS digest FROM {table} WHERE {where} GROUP BY ALL"""


def prints(m: Market) -> DataFrame:
    return Q.range_fingerprints(m.table("orders"), "orders", "o_orderkey", KEYS).unionByName(
        Q.range_fingerprints(m.table("lineitem"), "lineitem", "l_orderkey", KEYS))


@query("q12_fingerprint", f"""
WITH p AS ({prints_sql("orders", "o_orderkey", ORDERS)} UNION ALL {prints_sql("lineitem", "l_orderkey", LINES)})
SELECT "table", 'range' AS level, range, rows, digest::VARCHAR AS digest FROM p
UNION ALL SELECT "table", 'table', 0, sum(rows)::BIGINT, sum(digest)::VARCHAR FROM p GROUP BY "table" """)
def fingerprint(m):
    """Content fingerprints of the trade tables by key ranges, and as a whole from those."""
    own = prints(m)
    both = own.withColumn("level", F.lit("range")).unionByName(Q.merged_fingerprints(own).withColumn("level", F.lit("table")))
    return both.select("table", "level", "range", "rows", F.col("digest").cast("string").alias("digest"))


@query("q12_changed_tables", f"""
WITH b AS ({prints_sql("orders", "o_orderkey", ORDERS)} UNION ALL {prints_sql("lineitem", "l_orderkey", LINES)}),
a AS ({prints_sql("orders", "o_orderkey", ORDERS, {"o_totalprice": "CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN o_totalprice + 1 ELSE o_totalprice END"})}
      UNION ALL {prints_sql("lineitem", "l_orderkey", LINES, where="l_orderkey < (SELECT max(l_orderkey) FROM lineitem)")})
SELECT "table", range, coalesce(b.rows, 0) AS rows_before, coalesce(a.rows, 0) AS rows_after FROM b FULL JOIN a USING ("table", range)
WHERE b.rows IS DISTINCT FROM a.rows OR b.digest IS DISTINCT FROM a.digest""")
def changed_tables(m):
    """One changed price and the lines of one order taken away are found, with their ranges; the order of rows is nothing."""
    o, lines = m.table("orders"), m.table("lineitem")
    first = F.col("o_orderkey") == o.agg(F.min("o_orderkey")).scalar()
    edited = o.withColumn("o_totalprice", F.when(first, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).repartition(5)
    fewer = lines.where(F.col("l_orderkey") < lines.agg(F.max("l_orderkey")).scalar())
    after = Q.range_fingerprints(edited, "orders", "o_orderkey", KEYS).unionByName(Q.range_fingerprints(fewer, "lineitem", "l_orderkey", KEYS))
    return Q.changed_ranges(prints(m), after)


@query("q13_causality_audit", "SELECT symbol, date, NULL::DOUBLE AS mom63, NULL::DOUBLE AS vol FROM brand_bars WHERE false", floats="mom63 vol", dates="date")
def causality_audit(m):
    """The features of every symbol up to 1998 do not change when later bars are removed."""
    sessions = m.sessions
    return Q.causality_breaks(
        lambda bars: P.rotation_features(P.complete_panel(P.rebase_to_first_factor(bars), sessions), 60, 0),
        m.bars("p_brand"), "1998-06-30", ["symbol", "date", "mom63", "vol"])


@query("q14_table_difference",
       """SELECT max(abs(a.close - b.close)) AS close, max(abs(a.volume - b.volume)) AS volume, count(*) FILTER (b.symbol IS NULL) AS only_left, count(*) FILTER (a.symbol IS NULL) AS only_right
          FROM (SELECT * FROM brand_bars WHERE day(date) <> 9) a FULL JOIN (SELECT symbol, date, close * 1.01::DOUBLE AS close, volume FROM brand_bars WHERE day(date) <> 10) b ON a.symbol = b.symbol AND a.date = b.date""",
       floats="close volume", digits=4)
def table_difference(m):
    b = m.bars("p_brand")
    other = b.where(F.dayofmonth("date") != 10).withColumn("close", F.col("close") * 1.01)
    return Q.table_difference(b.where(F.dayofmonth("date") != 9), other, ["symbol", "date"], ["close", "volume"])


RAW_TARGETS = "SELECT 'raw' AS strategy_id, date, symbol, volume / sum(volume) OVER (PARTITION BY date) * 1.02::DOUBLE - 0.01::DOUBLE AS weight FROM type_bars"


@query("q15_target_invariants",
       f"""SELECT strategy_id, date, array_to_string(list_filter([CASE WHEN lo < -1e-10 THEN 'negative' END, CASE WHEN hi > 0.30 + 1e-8 THEN 'above_cap' END, CASE WHEN total > 1 + 1e-8 THEN 'above_one' END,
             CASE WHEN excess > 1e-8 THEN 'above_group_cap' END], lambda x: x IS NOT NULL), ',') AS violations FROM (
           SELECT strategy_id, date, sum(weight) AS total, min(weight) AS lo, max(weight) AS hi, max(weight - CASE bucket WHEN 'bond' THEN 0.30 WHEN 'gold' THEN 0.25 END) AS excess
           FROM ({RAW_TARGETS}) JOIN (SELECT symbol, bucket FROM type_assets) USING (symbol) GROUP BY strategy_id, date) WHERE lo < -1e-10 OR hi > 0.30 + 1e-8 OR total > 1 + 1e-8 OR excess > 1e-8""",
       dates="date")
def target_invariants(m):
    total = F.sum("volume").over(Window.partitionBy("date"))
    t = m.bars("p_type").select(F.lit("raw").alias("strategy_id"), "date", "symbol", (F.col("volume") / total * 1.02 - 0.01).alias("weight"))
    v = Q.target_violations(t, m.type_assets, 0.30, {"bond": 0.30, "gold": 0.25})
    return v.withColumn("violations", F.array_join("violations", ","))


@query("q16_asset_constraints",
       """SELECT count(*) FILTER (n > 1) AS duplicate_symbols, count(*) FILTER (a < 0 OR b > 0.30) AS weights_out_of_range, (sum(s) > 1 + 1e-9)::INT AS total_above_one FROM (
          SELECT symbol, count(*) AS n, min(weight) AS a, max(weight) AS b, sum(weight) AS s FROM (SELECT symbol, weight FROM type_assets UNION ALL SELECT symbol, 0.31 FROM type_assets WHERE bucket = 'gold') GROUP BY symbol)""")
def asset_constraints(m):
    a = m.type_assets.select("symbol", "weight")
    extra = m.type_assets.where("bucket = 'gold'").select("symbol", F.lit(0.31).alias("weight"))
    return Q.asset_faults(a.unionByName(extra))


@query("q16_conflicting_kinds", "SELECT p_brand AS symbol, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def conflicting_kinds(m):
    return Q.conflicting_kinds(m.table("part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("kind")))


@query("q17_bound_check",
       f"SELECT date, bond_cap FROM (SELECT date, {roll('avg', 'close', 20)} / 12000 AS bond_cap FROM type_panel WHERE symbol = 'SMALL') WHERE bond_cap IS NULL OR bond_cap < 0 OR bond_cap > 0.30",
       floats="bond_cap", dates="date")
def bound_check(m):
    from marketframe.functions.timeseries import rolling_mean

    caps = m.panel("p_type").where("symbol = 'SMALL'").select("date", (rolling_mean(F.col("close"), 20) / 12000).alias("bond_cap"))
    return Q.bad_bounds(caps, "bond_cap", 0.0, 0.30)


# --- sources -------------------------------------------------------------------------


@query("s02_written_bars", "SELECT symbol, date, open, high, low, close, volume, amount, adj_factor FROM brand_bars", floats="open high low close volume amount adj_factor", dates="date", digits=4)
def written_bars(m):
    """Bars written by year after the checks, and read back for the wanted symbols."""
    path = f"{work_folder(m.spark)}/bars-{uuid.uuid4().hex}"
    B.write_bars(m.bars("p_brand").select(*[f.name for f in B.BAR_SCHEMA]), path)
    return B.read_bars(m.spark, path, m.brand_assets).select(*[f.name for f in B.BAR_SCHEMA])


def dear_bars(m: Market, share: float) -> DataFrame:
    """Bars that closed above a share of the highest close of all."""
    bars = m.bars("p_brand")
    return bars.where(F.col("close") > share * bars.agg(F.max("close")).scalar())


@query("s01_absent_symbols", "SELECT DISTINCT p_brand AS symbol FROM part WHERE p_brand NOT IN (SELECT symbol FROM brand_bars WHERE close > 0.9 * (SELECT max(close) FROM brand_bars))")
def absent_symbols(m):
    return B.absent_symbols(dear_bars(m, 0.9), m.brand_assets)


VENDOR_BARS = "SELECT symbol AS ts_code, strftime(date, '%Y%m%d') AS trade_date, open, high, low, CASE WHEN day(date) = 8 THEN 'n/a' ELSE close::VARCHAR END AS close, volume AS vol, amount FROM brand_bars"


def vendor_bars(m: Market) -> DataFrame:
    """Bars as a vendor ships them: other names, text dates, numbers as text."""
    return m.bars("p_brand").select(
        F.col("symbol").alias("ts_code"), F.date_format("date", "yyyyMMdd").alias("trade_date"), "open", "high", "low",
        F.when(F.dayofmonth("date") == 8, "n/a").otherwise(F.col("close").cast("string")).alias("close"),
        F.col("volume").alias("vol"), "amount", "adj_factor")


@query("s03_normalized_bars",
       f"SELECT ts_code AS symbol, strptime(trade_date, '%Y%m%d')::DATE AS date, open, try_cast(close AS DOUBLE) AS close, vol * 100 AS volume, amount * 1000 AS amount FROM ({VENDOR_BARS})",
       floats="open close volume amount", dates="date", digits=4)
def normalized_bars(m):
    return B.normalize(vendor_bars(m)).select("symbol", "date", "open", "close", "volume", "amount")


@query("s04_attached_factor",
       "SELECT symbol AS ts_code, strftime(date, '%Y%m%d') AS trade_date, CASE WHEN symbol = 'Brand#1' THEN 1.0 WHEN day(date) <> 7 THEN adj_factor END AS adj_factor FROM brand_bars",
       floats="adj_factor")
def attached_factor(m):
    raw = vendor_bars(m)
    factors = raw.where("substring(trade_date, 7, 2) <> '07'").select("ts_code", "trade_date", "adj_factor")
    index = m.brand_assets.where("symbol = 'Brand#1'").select(F.col("symbol").alias("ts_code"))
    return B.attach_factor(raw.drop("adj_factor"), factors, index).select("ts_code", "trade_date", "adj_factor")


@query("s05_incremental_refresh",
       """SELECT b.symbol, b.date, CASE WHEN b.date < s.start THEN b.close ELSE b.close + 1 END AS close FROM brand_bars b
          LEFT JOIN (SELECT symbol, max(date) - 40 AS start FROM brand_bars WHERE date <= DATE '2000-12-31' GROUP BY symbol) s USING (symbol)""",
       floats="close", dates="date", digits=4)
def incremental_refresh(m):
    """Old table up to 2000, a corrected download after it: the overlap is taken from the download."""
    b = m.bars("p_brand").select("symbol", "date", "close")
    old = b.where(F.col("date") <= F.lit("2000-12-31").cast("date"))
    return B.merge_refresh(old, b.withColumn("close", F.col("close") + 1))


@query("s06_landed_pages",
       """SELECT page, count(*) AS rows, (min(date) >= DATE '1995-01-01' AND max(date) <= DATE '2001-12-31')::INT AS in_bounds, (count(*) >= 1500)::INT AS at_cap, repeated FROM (
          SELECT symbol AS page, date, (symbol = 'Brand#2')::INT AS repeated FROM brand_bars UNION ALL SELECT 'copy of Brand#2', date, 1 FROM brand_bars WHERE symbol = 'Brand#2') GROUP BY page, repeated""")
def landed_pages(m):
    """Each brand is a landed page; one page was delivered twice."""
    b = m.bars("p_brand").select(F.col("symbol").alias("page"), "date", "close", "volume")
    again = b.where("page = 'Brand#2'").withColumn("page", F.lit("copy of Brand#2"))
    return vendor.page_report(b.unionByName(again), "page", "date", F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"), 1500)


@query("s07_combined_partitions",
       "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT * FROM events) WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY ALL")
def combined_partitions(m):
    e = m.table("events")
    cut = F.col("event_type").isin("view", "click")
    universe = m.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    whole = vendor.combine_partitions([e.where(cut), e.where(~cut), e.where("event_type = 'click'")], universe, "user_id")
    return whole.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s08_coverage", "SELECT symbol, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM brand_bars GROUP BY symbol", dates="first_date last_date")
def coverage(m):
    return B.coverage(m.bars("p_brand"))


@query("s10_curve_columns",
       """SELECT date, max(yield) FILTER (curve = 'gov' AND tenor = '1y') AS gov_1y, max(yield) FILTER (curve = 'gov' AND tenor = '3y') AS gov_3y,
          max(yield) FILTER (curve = 'gov' AND tenor = '10y') AS gov_10y, max(yield) FILTER (curve = 'aaa' AND tenor = '3y') AS aaa_3y FROM curves GROUP BY date""",
       floats="gov_1y gov_3y gov_10y aaa_3y", dates="date")
def curve_columns(m):
    return series.curve_columns(D.curves(m))


@query("s11_half_year_completeness",
       """SELECT half, curve, tenor, count(*) AS rows FROM (SELECT year(date) || 'H' || CASE WHEN month(date) <= 6 THEN 1 ELSE 2 END AS half, curve, tenor, date FROM curves WHERE NOT (year(date) = 1996 AND month(date) < 6)) GROUP BY ALL HAVING count(*) < 40""")
def half_year_completeness(m):
    hole = (F.year("date") == 1996) & (F.month("date") < 6)
    return series.incomplete_halves(D.curves(m).where(~hole), 40)


@query("s12_share_manifest",
       f"SELECT symbol, count(*) AS rows, min(date) AS first, max(date) AS last, count(DISTINCT date) AS dates, max(s) AS largest FROM (SELECT symbol, date, 100 + sum(volume) OVER {frame()} / 10 AS s FROM type_bars) GROUP BY symbol",
       floats="largest", dates="first last")
def share_manifest(m):
    return series.share_manifest(fund_shares(m).where("total_share IS NOT NULL"))


@query("s13_benchmark_coverage", "SELECT date FROM sessions WHERE date NOT IN (SELECT date FROM type_bars WHERE symbol = 'LARGE')", dates="date")
def benchmark_coverage(m):
    """An index series loaded up to 1999 and its appended tail against all sessions."""
    index = m.bars("p_type").where("symbol = 'LARGE'").select("date", "close")
    history = index.where(F.col("date") <= F.lit("1999-12-31").cast("date"))
    return series.uncovered_sessions(m.sessions, series.append_tail(history, index))


@query("s14_source_preference",
       """SELECT symbol, count(*) AS rows, (count(*) >= 127)::INT AS usable FROM (
            SELECT symbol, date FROM brand_bars WHERE close > 0.4 * (SELECT max(close) FROM brand_bars) UNION ALL SELECT symbol, date FROM type_bars
            UNION ALL SELECT symbol, date FROM brand_bars WHERE symbol NOT IN (SELECT symbol FROM brand_bars WHERE close > 0.4 * (SELECT max(close) FROM brand_bars))) WHERE symbol NOT IN (SELECT symbol FROM type_assets) GROUP BY symbol""")
def source_preference(m):
    b = m.bars("p_brand").select("symbol", "date")
    research = dear_bars(m, 0.4).select("symbol", "date").unionByName(m.bars("p_type").select("symbol", "date"))
    return B.usable_universe(B.prefer(research, b), m.type_assets)


@query("s09_json_records", "SELECT symbol, json_object('rows', count(*), 'traded', count(*) FILTER (volume > 100))::VARCHAR AS record FROM brand_bars GROUP BY symbol")
def json_records(m):
    from marketframe.sources.sinks import as_json

    g = m.bars("p_brand").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("volume") > 100).alias("traded"))
    return as_json(g, ["symbol"])


# --- set operations --------------------------------------------------------------------


@query("u01_union_all", "SELECT source, count(*) AS n FROM (SELECT 'brand' AS source, date FROM brand_bars UNION ALL SELECT 'type', date FROM type_bars) GROUP BY source")
def union_all(m):
    a = m.bars("p_brand").select(F.lit("brand").alias("source"), "date")
    return a.unionByName(m.bars("p_type").select(F.lit("type").alias("source"), "date")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("u02_union_distinct", "SELECT symbol FROM members UNION SELECT symbol FROM brand_bars WHERE close > 0.7 * (SELECT max(close) FROM brand_bars)")
def union_distinct(m):
    return D.members(m).select("symbol").unionByName(dear_bars(m, 0.7).select("symbol")).distinct()


@query("u03_common_dates", "SELECT date FROM type_bars GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM type_bars)", dates="date")
def common_dates(m):
    """Dates that every symbol has: an n-way intersection as one aggregate."""
    b = m.bars("p_type")
    n = b.agg(F.count_distinct("symbol")).scalar()
    return b.groupBy("date").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == n).select("date")


@query("u03_intersect", "SELECT date FROM brand_bars WHERE symbol = 'Brand#1' INTERSECT SELECT date FROM brand_bars WHERE symbol = 'Brand#2'", dates="date")
def intersect(m):
    b = m.bars("p_brand")
    return b.where("symbol = 'Brand#1'").select("date").intersect(b.where("symbol = 'Brand#2'").select("date"))


@query("u04_except", "SELECT date FROM sessions EXCEPT SELECT date FROM brand_bars WHERE symbol = 'Brand#6'", dates="date")
def except_dates(m):
    return m.sessions.select("date").exceptAll(m.bars("p_brand").where("symbol = 'Brand#6'").select("date"))


# --- scalar rules ------------------------------------------------------------------------

# An ordered rule list over the colours and nouns of part names.
NAME_RULES = [("metal", "ring|steel|gold"), ("warm", "red|orange"), ("cold", "blue|green"), ("goods", "widget|gadget|box")]
NAME_EXCLUDED = "(?i)tiny|small"


@query("f01_strings",
       """SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[0-9]{2}')::INT AS two_digits, starts_with(p_brand, 'Brand#1')::INT AS pre, ends_with(p_brand, '5')::INT AS suf,
          contains(lower(p_name), 'ring')::INT AS has, substr(p_type, 1, 3) AS short, p_brand || '/' || p_type AS joined, split_part(p_name, ' ', 1) AS first_word FROM part""")
def strings(m):
    b, n = F.col("p_brand"), F.col("p_name")
    return m.table("part").select(
        "p_partkey", b.rlike("^Brand#[0-9]{2}$").cast("int").alias("two_digits"), b.startswith("Brand#1").cast("int").alias("pre"),
        b.endswith("5").cast("int").alias("suf"), F.lower(n).contains("ring").cast("int").alias("has"), F.substring("p_type", 1, 3).alias("short"),
        F.concat_ws("/", b, "p_type").alias("joined"), F.split(n, " ")[0].alias("first_word"))


@query("f02_ordered_classes",
       "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)tiny|small') THEN NULL " + " ".join(f"WHEN regexp_matches(p_name, '(?i){r}') THEN '{n}'" for n, r in NAME_RULES) + " END AS theme FROM part")
def ordered_classes(m):
    return m.table("part").select("p_partkey", scalar.classify(F.col("p_name"), NAME_RULES, NAME_EXCLUDED).alias("theme"))


@query("f03_dates",
       """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS text, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS quarter_end,
          CAST(o_orderdate - INTERVAL 1 YEAR AS DATE) AS year_before, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS age, date_trunc('week', o_orderdate)::DATE AS week FROM orders""",
       dates="quarter_end year_before week")
def dates(m):
    d = F.col("o_orderdate").cast("date")
    return m.table("orders").select(
        "o_orderkey", F.date_format(d, "yyyyMMdd").alias("text"), F.year(d).alias("y"), F.quarter(d).alias("q"),
        D.quarter_end(d).alias("quarter_end"), F.add_months(d, -12).alias("year_before"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).alias("age"), F.date_trunc("week", d).cast("date").alias("week"))


@query("f04_math",
       """SELECT symbol, date, ln(close) AS l, sqrt(volume) AS s, tanh(close / 10000) AS t, sign(close - open) AS g, abs(close - open) AS a, floor(close) AS f, ceil(close) AS c,
          greatest(0, least(1, close / 5000)) AS clipped, round_even(volume / 8, 0) AS half_even, pow(volume, 1.5) AS p FROM brand_bars""",
       floats="l s t g a f c clipped half_even p", dates="date", digits=4)
def math(m):
    from marketframe.functions.timeseries import clip

    c, o, v = F.col("close"), F.col("open"), F.col("volume")
    return m.bars("p_brand").select(
        "symbol", "date", F.ln(c).alias("l"), F.sqrt(v).alias("s"), F.tanh(c / 10000).alias("t"), F.signum(c - o).alias("g"), F.abs(c - o).alias("a"),
        F.floor(c).alias("f"), F.ceil(c).alias("c"), clip(c / 5000, 0.0, 1.0).alias("clipped"), F.bround(v / 8, 0).alias("half_even"), F.pow(v, F.lit(1.5)).alias("p"))


@query("f05_f06_nulls_arrays",
       """SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS joined,
          (max(o_orderpriority = '1-URGENT'))::INT AS urgent, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0) AS done, nullif(min(o_orderstatus), 'O') AS st FROM orders GROUP BY o_custkey""",
       floats="done", digits=2)
def nulls_arrays(m):
    g = m.table("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("o_orderpriority")).alias("set"),
        F.coalesce(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), F.lit(0.0)).alias("done"),
        F.nullif(F.min("o_orderstatus"), F.lit("O")).alias("st"))
    return g.select("o_custkey", "n", F.size("set").cast("bigint").alias("kinds"), F.array_join("set", "|").alias("joined"),
                    F.array_contains("set", "1-URGENT").cast("int").alias("urgent"), "done", "st")


@query("f07_hashes", "SELECT p_partkey, sha256(p_brand || '|' || p_type) AS digest FROM part")
def hashes(m):
    return m.table("part").select("p_partkey", F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256).alias("digest"))


@query("f08_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{\"event\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS text FROM events")
def json(m):
    e = m.table("events")
    return e.select("event_id", F.from_json("props", "k INT")["k"].alias("k"),
                    F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("type"))).alias("text"))


@query("f09_fees",
       """SELECT l_orderkey, l_linenumber, l_partkey, greatest(5.0, l_extendedprice * 1.5 / 10000) AS commission,
          CASE WHEN l_returnflag = 'A' THEN l_extendedprice * CASE WHEN d >= DATE '2023-08-28' THEN 0.0005 ELSE 0.001 END ELSE 0 END AS stamp,
          CASE WHEN d >= DATE '2022-04-29' THEN l_extendedprice * 0.00001 WHEN d >= DATE '2015-08-01' THEN l_extendedprice * 0.00002
               WHEN l_linestatus = 'F' THEN l_quantity * 0.0003 ELSE l_extendedprice * 0.0000255 END AS transfer
          FROM (SELECT *, CAST(l_shipdate AS DATE) + 365 * 23 AS d FROM lineitem)""",
       floats="commission stamp transfer")
def fees(m):
    """Commission with a floor, dated stamp tax, dated transfer fee; ship dates moved by 23 years."""
    n, side = F.col("l_extendedprice"), F.when(F.col("l_returnflag") == "A", "SELL").otherwise("BUY")
    d = F.date_add(F.col("l_shipdate").cast("date"), 365 * 23)
    market = F.when(F.col("l_linestatus") == "F", "600000.SH").otherwise("000001.SZ")
    return m.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", scalar.fee(n, 1.5, 5.0).alias("commission"), scalar.stamp_tax(n, side, d).alias("stamp"),
        scalar.transfer_fee(n, F.col("l_quantity"), market, d).alias("transfer"))


@query("f10_drift_band",
       """SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN t <= 1e-12 AND c <= 1e-12 THEN false WHEN t <= 1e-12 OR c <= 1e-12 THEN true
          ELSE abs(t - c) >= least(0.02, greatest(0.005, t * 0.1)) END)::INT AS needed, (c > 1e-12 AND t < c * 0.5)::INT AS risk_exit
          FROM (SELECT *, l_discount AS t, l_tax AS c FROM lineitem)""")
def drift_band(m):
    t, c = F.col("l_discount"), F.col("l_tax")
    return m.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalar.rebalance_needed(t, c, 0.02, 0.1).cast("int").alias("needed"),
                                      scalar.risk_exit_due(t, c, 0.5).cast("int").alias("risk_exit"))


@query("f11_tradable_at_open",
       """SELECT symbol, date, coalesce(open < up - 1e-8, false)::INT AS can_buy, coalesce(open > down + 1e-8, false)::INT AS can_sell, (high = low)::INT AS locked FROM (
          SELECT *, lag(close) OVER w * 1.1::DOUBLE AS up, lag(close) OVER w * 0.9::DOUBLE AS down FROM brand_bars WINDOW w AS (PARTITION BY symbol ORDER BY date))""", dates="date")
def tradable_at_open(m):
    w = Window.partitionBy("symbol").orderBy("date")
    before = F.lag("close").over(w)
    b = m.bars("p_brand").withColumns({"up": before * 1.1, "down": before * 0.9})
    o, u, d = F.col("open"), F.col("up"), F.col("down")
    return b.select("symbol", "date", scalar.tradable_at_open(o, u, d, F.lit("BUY")).cast("int").alias("can_buy"),
                    scalar.tradable_at_open(o, u, d, F.lit("SELL")).cast("int").alias("can_sell"), scalar.locked_bar(F.col("high"), F.col("low")).cast("int").alias("locked"))


@query("f12_lots", "SELECT symbol, date, floor(volume / 10) * 10 AS lots, least(floor(volume / 10) * 10, floor(volume * 0.3 / 10) * 10) AS capped FROM brand_bars",
       floats="lots capped", dates="date")
def lots(m):
    v = F.col("volume")
    return m.bars("p_brand").select("symbol", "date", scalar.round_to_lot(v, 10).alias("lots"),
                                    F.least(scalar.round_to_lot(v, 10), scalar.volume_cap(v, 0.3, 10)).alias("capped"))
