"""Disclosure and reference tables derived from the order flow.

Quarterly statements come in versions (one per return flag) with their own
announcement dates; analyst estimates, guidance, memberships, industries, names,
valuations, dividends, curves and fund values follow the same idea.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.sources.market import Market, exact


def brand_number(symbol: Column) -> Column:
    return F.substring(symbol, 7, 9).cast("int")


def quarter_end(date: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))


def statements(m: Market) -> DataFrame:
    """Raw versions of income, cash flow and balance figures per brand and quarter."""

    def build():
        ext, disc, tax = exact(F.col("l_extendedprice")), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
        quarter = m.trades.groupBy(
            F.col("p_brand").alias("ts_code"), quarter_end(F.col("date")).alias("end_date"), F.col("l_returnflag").alias("flag")
        ).agg(F.sum(ext).alias("rev"), F.sum(ext * disc).alias("prof"), F.sum(ext * tax).alias("cash"),
              F.sum(exact(F.col("l_quantity"))).alias("units"))
        year = Window.partitionBy("ts_code", "flag", F.year("end_date")).orderBy("end_date").rowsBetween(Window.unboundedPreceding, 0)
        ever = Window.partitionBy("ts_code", "flag").orderBy("end_date").rowsBetween(Window.unboundedPreceding, 0)
        d = quarter.select(
            "ts_code", "end_date", "flag",
            F.sum("rev").over(year).cast("double").alias("revenue"),
            F.sum("prof").over(year).cast("double").alias("operate_profit"),
            F.sum("cash").over(year).cast("double").alias("n_cashflow_act"),
            F.sum("units").over(year).cast("double").alias("c_pay_acq_const_fiolta"),
            F.sum("rev").over(ever).cast("double").alias("total_assets"),
            (F.col("rev").cast("double") * 0.3).alias("accounts_receiv"),
            (F.col("units").cast("double") * 100).alias("inventories"),
            F.col("units").cast("double").alias("goodwill"),
        )
        no = brand_number(F.col("ts_code"))
        lag = F.when(F.col("flag") == "R", 20 + no).when(F.col("flag") == "N", 60 + no).otherwise(F.lit(380))
        income = (F.col("operate_profit") - F.col("n_cashflow_act") * 0.5) * 100
        d = d.select(
            "*",
            F.date_add("end_date", lag).alias("ann_date"),
            F.when(F.col("flag") == "R", "1").when(F.col("flag") == "N", "5").otherwise("4").alias("report_type"),
            F.when(F.col("flag") == "A", "1").otherwise("0").alias("update_flag"),
            F.when(no == 25, "2").otherwise("1").alias("comp_type"),
            (F.col("revenue") * 0.7).alias("oper_cost"),
            income.alias("n_income"),
            (income * 0.9).alias("n_income_attr_p"),
            (income / 1000000).alias("basic_eps"),
            income.alias("net_profit"),
        ).withColumn("f_ann_date", F.date_add("ann_date", F.when(F.col("flag") == "N", 2).otherwise(0)))
        # one brand repeats its originals exactly, another contradicts itself
        copies = F.when((no == 23) & (F.col("flag") == "R"), 2).when((no == 24) & (F.col("flag") == "N"), 2).otherwise(1)
        again = d.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        clash = (F.col("copy") == 2) & (no == 24)
        return again.withColumns({
            c: F.when(clash, F.col(c) + 1).otherwise(F.col(c))
            for c in ("basic_eps", "net_profit", "goodwill")
        }).drop("copy")

    return m._once("statements", build)


def analyst_reports(m: Market) -> DataFrame:
    """Profit estimates: each trade is a broker's report on the brand's fiscal year."""

    def build():
        q = F.col("l_quantity")
        return m.trades.join(m.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.col("p_brand").alias("ts_code"),
            F.concat(F.lit("broker"), F.col("s_nationkey").cast("string")).alias("org_name"),
            F.col("date").alias("report_date"),
            F.when(q >= 49, "annual").otherwise(F.concat(F.year("date").cast("string"), F.lit("Q4"))).alias("quarter"),
            F.when(q > 1, q * 100).alias("np"),
            (F.col("date").cast("timestamp_ntz")
             + F.make_dt_interval(F.col("l_linenumber") + F.when(F.col("l_returnflag") == "A", 3).otherwise(0), F.lit(10))).alias("create_time"),
        )

    return m._once("analysts", build)


def members(m: Market, size: int = 12) -> DataFrame:
    """Month-end snapshots of the brands with the largest traded amount: (snapshot, symbol)."""

    def build():
        month = m.bars("p_brand").groupBy(F.trunc("date", "MM").alias("month"), "symbol").agg(
            F.sum(exact(F.col("amount"))).alias("amount"))
        last = m.sessions.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("snapshot"))
        top = Window.partitionBy("month").orderBy(F.desc("amount"), "symbol")
        return (month.withColumn("n", F.row_number().over(top)).where(F.col("n") <= size)
                .join(last, "month").select("snapshot", "symbol"))

    return m._once(("members", size), build)


def industries(m: Market) -> DataFrame:
    """Dominant part type per brand and year; five brands overlap into the next year."""

    def build():
        y = m.trades.groupBy(F.col("p_brand").alias("ts_code"), F.year("date").alias("y"), F.col("p_type").alias("l1_code")).agg(
            F.sum(exact(F.col("l_extendedprice"))).alias("a"))
        best = y.groupBy("ts_code", "y").agg(F.max(F.struct("a", "l1_code")).alias("s"))
        start = F.make_date("y", F.lit(1), F.lit(1))
        end = F.make_date("y", F.lit(12), F.lit(31))
        late = F.when(brand_number(F.col("ts_code")) <= 5, 45).otherwise(0)
        return best.select(
            "ts_code", start.alias("in_date"),
            F.when(F.col("y") < 2001, F.date_add(end, late)).alias("out_date"), F.col("s.l1_code").alias("l1_code"))

    return m._once("industries", build)


def names(m: Market) -> DataFrame:
    """Name intervals: the brand with the smallest yearly amount carries a warning prefix."""

    def build():
        y = m.bars("p_brand").groupBy("symbol", F.year("date").alias("y")).agg(F.sum(exact(F.col("amount"))).alias("a"))
        weakest = F.row_number().over(Window.partitionBy("y").orderBy("a", "symbol")) <= 2
        return y.withColumn("weak", weakest).select(
            F.col("symbol").alias("ts_code"),
            F.when(F.col("weak"), F.concat(F.lit("*st "), "symbol")).otherwise(F.col("symbol")).alias("name"),
            F.make_date("y", F.lit(1), F.lit(1)).alias("start_date"),
            F.when(F.col("y") < 2001, F.make_date("y", F.lit(12), F.lit(31))).alias("end_date"))

    return m._once("names", build)


def valuations(m: Market) -> DataFrame:
    """pe_ttm (sometimes negative), pb and total market value of each bar."""
    return m.bars("p_brand").select(
        "symbol", "date", (F.col("close") / 500 - 1).alias("pe_ttm"), (F.col("close") / 2000).alias("pb"),
        (F.col("amount") / 1000).alias("total_mv"))


def rates(m: Market) -> DataFrame:
    """Weekday interbank rates: three months, overnight, one year."""

    def build():
        d = m.trades.groupBy("date").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("a"),
            F.sum(F.col("l_tax").cast("decimal(4,2)")).cast("double").alias("b"),
            F.sum(exact(F.col("l_quantity"))).cast("double").alias("c"),
            F.sum(F.col("l_linenumber")).cast("double").alias("k"))
        return d.where(~F.dayofweek("date").isin(1, 7)).select(
            "date", (100 * F.col("a") / F.col("n")).alias("m3"), (100 * F.col("b") / F.col("n")).alias("overnight"),
            (F.col("c") / F.col("n") / 10).alias("y1"), (F.col("k") / F.col("n")).alias("credit"))

    return m._once("rates", build)


def index_valuations(m: Market) -> DataFrame:
    """Weekday PE and PB of three index series: (code, date, pe_ttm, pb)."""
    return m.bars("p_type").where(F.col("symbol").isin("ECONOMY", "LARGE", "MEDIUM") & ~F.dayofweek("date").isin(1, 7)).select(
        F.col("symbol").alias("code"), "date", (F.col("close") / 500 - 1).alias("pe_ttm"), (F.col("close") / 2000).alias("pb"))


def curves(m: Market) -> DataFrame:
    """Yield curves in long form: (curve, date, tenor, yield)."""
    r = rates(m)
    points = [
        ("gov", "1y", F.col("m3")), ("gov", "3y", F.col("overnight") + 1), ("gov", "10y", F.col("y1")),
        ("aaa", "3y", F.col("overnight") + F.col("credit") / 5),
    ]
    wide = r.select("date", F.array(*[
        F.struct(F.lit(c).alias("curve"), F.lit(t).alias("tenor"), y.alias("yield")) for c, t, y in points
    ]).alias("points"))
    return wide.select("date", F.explode("points").alias("p")).select("p.curve", "date", "p.tenor", "p.yield")


def fund_values(m: Market) -> DataFrame:
    """Unit values of three funds, announced one to three days after their date."""
    return m.bars("p_type").where(F.col("symbol").isin("LARGE", "MEDIUM", "PROMO")).select(
        "symbol", F.date_add("date", F.dayofweek("date") % 3 + 1).alias("ann_date"), F.col("date").alias("nav_date"),
        ((F.col("open") + F.col("close") * 3) / 4).alias("unit_nav"))
