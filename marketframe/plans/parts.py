"""SQL text of the derived market tables, for the twins that check the queries."""

from marketframe.plans.registry import part

part("sessions", """
SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) AS session_no
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)""")

part("calendar", """
SELECT strftime(d.day, '%Y%m%d') AS cal_date, CASE WHEN s.date IS NULL THEN 0 ELSE 1 END AS is_open
FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM sessions), (SELECT max(date) FROM sessions), INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN sessions s ON s.date = d.day""")

part("trades", """
SELECT *, CAST(o_orderdate AS DATE) AS date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""")

for _name, _by in (("brand", "p_brand"), ("type", "p_type")):
    part(f"{_name}_bars", f"""
SELECT symbol, date, (low + high) / 2 AS open, high, low, amount / volume AS close, volume, amount,
       1 + 0.05 * floor((date_diff('day', DATE '1995-01-01', date) + 30 * length(symbol)) / 365.0) AS adj_factor
FROM (SELECT {_by} AS symbol, date, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
             CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume
      FROM trades GROUP BY ALL)""")
    part(f"{_name}_panel", f"""
SELECT g.symbol, g.date, g.session_no, b.open, b.high, b.low, b.close, b.volume, b.amount, b.adj_factor
FROM (SELECT symbol, date, session_no FROM (SELECT DISTINCT symbol FROM {_name}_bars), sessions) g
LEFT JOIN {_name}_bars b ON b.symbol = g.symbol AND b.date = g.date""")
    part(f"{_name}_adjusted", f"""
SELECT p.symbol, p.date, p.session_no, p.open * p.adj_factor / f.f0 AS open, p.high * p.adj_factor / f.f0 AS high,
       p.low * p.adj_factor / f.f0 AS low, p.close * p.adj_factor / f.f0 AS close, p.volume, p.amount, p.adj_factor
FROM {_name}_panel p JOIN (SELECT symbol, arg_min(adj_factor, date) AS f0 FROM {_name}_bars GROUP BY symbol) f USING (symbol)""")
    part(f"{_name}_marked", f"""
SELECT *, marked / lag(marked) OVER w - 1 AS ret, abs(marked - lag(marked) OVER w) AS move
FROM (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS marked
      FROM {_name}_adjusted)
WINDOW w AS (PARTITION BY symbol ORDER BY date)""")

part("type_assets", """
SELECT a.symbol, position, bucket, weight
FROM (VALUES (1,'ECONOMY','cn_equity',0.20),(2,'LARGE','us_equity',0.15),(3,'MEDIUM','hk_equity',0.05),
             (4,'PROMO','gold',0.20),(5,'SMALL','bond',0.30),(6,'STANDARD','commodity',0.10)) a(position, symbol, bucket, weight)
WHERE a.symbol IN (SELECT p_type FROM part)""")

part("brand_assets", """
SELECT symbol, position, CASE WHEN position <= 5 THEN 'cn_equity' WHEN position <= 10 THEN 'us_equity'
       WHEN position <= 12 THEN 'hk_equity' WHEN position <= 15 THEN 'gold' WHEN position <= 20 THEN 'bond'
       ELSE 'commodity' END AS bucket, CAST(0.03 AS DOUBLE) AS weight
FROM (SELECT DISTINCT p_brand AS symbol, CAST(substr(p_brand, 7) AS INT) AS position FROM part)""")

part("nav", """
SELECT symbol AS strategy_id, date,
       1000000 * exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity
FROM (SELECT symbol, date,
             coalesce(greatest(-0.03, least(0.03, CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY date) IS NOT NULL THEN ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) / 50 ELSE 0 END)), 0) AS r
      FROM type_bars)""")

part("quarterly", """
SELECT p_brand AS ts_code, last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS end_date, l_returnflag AS flag,
       sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS rev,
       sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS prof,
       sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS cash,
       sum(CAST(l_quantity AS DECIMAL(18,2))) AS units
FROM trades GROUP BY ALL""")

part("statements_once", """
SELECT *, CAST(ann_date + CASE WHEN flag = 'N' THEN 2 ELSE 0 END AS DATE) AS f_ann_date,
       revenue * 0.7::DOUBLE AS oper_cost, (operate_profit - n_cashflow_act * 0.5::DOUBLE) * 100 AS n_income,
       (operate_profit - n_cashflow_act * 0.5::DOUBLE) * 100 * 0.9::DOUBLE AS n_income_attr_p,
       (operate_profit - n_cashflow_act * 0.5::DOUBLE) * 100 / 1000000 AS basic_eps,
       (operate_profit - n_cashflow_act * 0.5::DOUBLE) * 100 AS net_profit
FROM (SELECT ts_code, end_date, flag, no,
        CAST(sum(rev) OVER y AS DOUBLE) AS revenue, CAST(sum(prof) OVER y AS DOUBLE) AS operate_profit,
        CAST(sum(cash) OVER y AS DOUBLE) AS n_cashflow_act, CAST(sum(units) OVER y AS DOUBLE) AS c_pay_acq_const_fiolta,
        CAST(sum(rev) OVER e AS DOUBLE) AS total_assets, CAST(rev AS DOUBLE) * 0.3::DOUBLE AS accounts_receiv,
        CAST(units AS DOUBLE) * 100 AS inventories, CAST(units AS DOUBLE) AS goodwill,
        CAST(end_date + CASE flag WHEN 'R' THEN 20 + no WHEN 'N' THEN 60 + no ELSE 380 END AS DATE) AS ann_date,
        CASE flag WHEN 'R' THEN '1' WHEN 'N' THEN '5' ELSE '4' END AS report_type,
        CASE flag WHEN 'A' THEN '1' ELSE '0' END AS update_flag,
        CASE WHEN no = 25 THEN '2' ELSE '1' END AS comp_type
      FROM (SELECT *, CAST(substr(ts_code, 7) AS INT) AS no FROM quarterly)
      WINDOW y AS (PARTITION BY ts_code, flag, year(end_date) ORDER BY end_date ROWS UNBOUNDED PRECEDING),
             e AS (PARTITION BY ts_code, flag ORDER BY end_date ROWS UNBOUNDED PRECEDING))""")

part("statements", """
SELECT * FROM statements_once
UNION ALL SELECT * FROM statements_once WHERE no = 23 AND flag = 'R'
UNION ALL SELECT * REPLACE (basic_eps + 1 AS basic_eps, net_profit + 1 AS net_profit, goodwill + 1 AS goodwill)
          FROM statements_once WHERE no = 24 AND flag = 'N'""")

for _kind, _values in (
    ("income", "revenue, oper_cost, operate_profit, n_income, n_income_attr_p, basic_eps"),
    ("cashflow", "net_profit, n_cashflow_act, c_pay_acq_const_fiolta"),
    ("balance", "total_assets, accounts_receiv, inventories, goodwill"),
):
    part(_kind, f"""
SELECT ts_code, end_date, available_at, comp_type, report_type, {_values}
FROM (SELECT *, count(*) OVER (PARTITION BY ts_code, end_date, available_at) AS n
      FROM (SELECT DISTINCT ts_code, end_date, CAST(greatest(ann_date, f_ann_date) AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS available_at,
                   comp_type, report_type, {_values}
            FROM statements
            WHERE (report_type IN ('1', '5') AND update_flag = '0')
               OR (report_type = '4' AND year(greatest(ann_date, f_ann_date)) > year(end_date))))
WHERE n = 1 AND available_at > end_date""")

part("cutoffs", """
SELECT min(date) AS date, min(session_no) AS session_no, CAST(min(date) AS TIMESTAMP) + INTERVAL '18:30' HOUR TO MINUTE AS cutoff
FROM sessions GROUP BY date_trunc('month', date)""".replace("INTERVAL '18:30' HOUR TO MINUTE", "INTERVAL 1110 MINUTE"))

part("analyst_reports", """
SELECT p_brand AS ts_code, 'broker' || s_nationkey AS org_name, date AS report_date,
       CASE WHEN l_quantity >= 49 THEN 'annual' ELSE year(date) || 'Q4' END AS quarter,
       CASE WHEN l_quantity > 1 THEN l_quantity * 100 END AS np,
       CAST(date AS TIMESTAMP) + INTERVAL 10 HOUR + to_days(l_linenumber + CASE WHEN l_returnflag = 'A' THEN 3 ELSE 0 END) AS create_time
FROM trades JOIN supplier ON l_suppkey = s_suppkey""")

part("analysts", """
SELECT ts_code, org_name, quarter, report_date AS reported_at, available_at, np_cny
FROM (SELECT *, count(*) OVER (PARTITION BY ts_code, org_name, quarter, report_date, available_at) AS n
      FROM (SELECT DISTINCT ts_code, org_name, quarter, report_date, np * 10000 AS np_cny,
              greatest(create_time, CAST(report_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND) AS available_at
            FROM analyst_reports
            WHERE regexp_full_match(quarter, '[0-9]{4}Q[1-4]') AND epoch(create_time) - epoch(CAST(report_date AS TIMESTAMP)) BETWEEN 0 AND 7 * 86400))
WHERE n = 1""")

part("members", """
SELECT snapshot, symbol FROM (
  SELECT month, symbol, row_number() OVER (PARTITION BY month ORDER BY amount DESC, symbol) AS n
  FROM (SELECT date_trunc('month', date) AS month, symbol, sum(CAST(amount AS DECIMAL(18,2))) AS amount FROM brand_bars GROUP BY ALL)) t
JOIN (SELECT date_trunc('month', date) AS month, max(date) AS snapshot FROM sessions GROUP BY 1) USING (month)
WHERE n <= 12""")

part("industries", """
SELECT ts_code, make_date(y, 1, 1) AS in_date,
       CASE WHEN y < 2001 THEN CAST(make_date(y, 12, 31) + CASE WHEN CAST(substr(ts_code, 7) AS INT) <= 5 THEN 45 ELSE 0 END AS DATE) END AS out_date, l1_code
FROM (SELECT p_brand AS ts_code, year(date) AS y, p_type AS l1_code,
             row_number() OVER (PARTITION BY p_brand, year(date) ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18,2))) DESC, p_type DESC) AS n
      FROM trades GROUP BY ALL) WHERE n = 1""".replace(
    "GROUP BY ALL) WHERE n = 1", "GROUP BY p_brand, year(date), p_type) WHERE n = 1"))

part("names", """
SELECT symbol AS ts_code, CASE WHEN n <= 2 THEN '*st ' || symbol ELSE symbol END AS name, make_date(y, 1, 1) AS start_date,
       CASE WHEN y < 2001 THEN make_date(y, 12, 31) END AS end_date
FROM (SELECT symbol, year(date) AS y, row_number() OVER (PARTITION BY year(date) ORDER BY sum(CAST(amount AS DECIMAL(18,2))), symbol) AS n
      FROM brand_bars GROUP BY symbol, year(date))""")

part("valuations", """
SELECT symbol, date, close / 500 - 1 AS pe_ttm, close / 2000 AS pb, amount / 1000 AS total_mv FROM brand_bars""")

part("rates", """
SELECT date, 100 * a / n AS m3, 100 * b / n AS overnight, c / n / 10 AS y1, k / n AS credit
FROM (SELECT date, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS a,
        CAST(sum(CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS b, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS c,
        CAST(sum(l_linenumber) AS DOUBLE) AS k FROM trades GROUP BY date)
WHERE dayofweek(date) NOT IN (0, 6)""")

part("index_valuations", """
SELECT symbol AS code, date, close / 500 - 1 AS pe_ttm, close / 2000 AS pb FROM type_bars
WHERE symbol IN ('ECONOMY', 'LARGE', 'MEDIUM') AND dayofweek(date) NOT IN (0, 6)""")

part("curves", """
SELECT 'gov' AS curve, date, '1y' AS tenor, m3 AS yield FROM rates
UNION ALL SELECT 'gov', date, '3y', overnight + 1 FROM rates
UNION ALL SELECT 'gov', date, '10y', y1 FROM rates
UNION ALL SELECT 'aaa', date, '3y', overnight + credit / 5 FROM rates""")

part("fund_values", """
SELECT symbol, CAST(date + ((dayofweek(date) + 1) % 3 + 1)::INT AS DATE) AS ann_date, date AS nav_date, (open + close * 3) / 4 AS unit_nav
FROM type_bars WHERE symbol IN ('LARGE', 'MEDIUM', 'PROMO')""")
