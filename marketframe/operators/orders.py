"""Order plans for many accounts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.scalar import rebalance_needed, risk_exit_due, round_to_lot, volume_cap


def account_positions(accounts: DataFrame, holdings: DataFrame, targets: DataFrame, prices: DataFrame) -> DataFrame:
    """Accounts × assets with quantity, close, target and current weight.

    ``targets`` names the assets of an account's universe; an asset that is not held
    has quantity zero. NAV is cash plus holdings at the close; of an account worth
    nothing no weight is a number (0 / 0). Tables with a row per account are never
    broadcast, however small their files are; prices may be.
    """
    held = holdings.join(prices.select("symbol", "close"), "symbol")
    worth = held.groupBy("account").agg(F.sum(F.col("quantity") * F.col("close")).alias("_held"))
    nav = accounts.join(worth.hint("merge"), "account", "left").withColumn("nav", F.col("cash") + F.coalesce("_held", F.lit(0.0))).drop("_held")
    rows = targets.join(nav.hint("merge"), "account").join(prices, "symbol").join(holdings.hint("merge"), ["account", "symbol"], "left")
    q = F.coalesce("quantity", F.lit(0.0))
    value, nav = F.col("quantity") * F.col("close"), F.col("nav")
    current = F.when(nav == 0, value * F.lit(float("inf"))).otherwise(value / nav)
    return rows.withColumn("quantity", q).withColumn("current", current)


def order_requests(positions: DataFrame, lot: int, participation: float, band: float, relative: float | None = None,
                   risk_ratio: float | None = None, on_schedule: Column | None = None) -> DataFrame:
    """Desired lots where the drift asks for them, bounded by today's volume."""
    t, c = F.col("weight"), F.col("current")
    emergency = risk_exit_due(t, c, risk_ratio)
    due = emergency | ((on_schedule if on_schedule is not None else F.lit(True)) & rebalance_needed(t, c, band, relative))
    desired = round_to_lot(F.col("nav") * t / F.col("close"), lot)
    d = positions.where(F.col("nav") > 0).withColumns({"emergency": emergency, "desired": desired}).where(due)
    delta = F.col("desired") - F.col("quantity")
    cap = volume_cap(F.col("volume"), participation, lot)
    leaving = (delta < 0) & (F.col("desired") == 0)
    size = F.when(leaving, F.least("quantity", cap)).otherwise(round_to_lot(F.least(F.abs(delta), cap), lot))
    signed = F.when(delta > 0, size).otherwise(-size)
    return d.select("account", "symbol", "position", "cash", "close", signed.cast("double").alias("delta"),
                    (F.col("emergency") | leaving).alias("cost_exempt")).where("delta <> 0")


def plan_cash_orders(requests: DataFrame, lot: int, commission_bps: float, minimum_commission: float, slippage_bps: float,
                     minimum_trade: float = 0.0, multiplier: float = 1.0) -> DataFrame:
    """Sells first, then buys as far as the cash goes, in asset order.

    An account's orders (at most one per asset) are folded in sequence. The largest
    affordable lot count follows in one step from the two branches of the fee: price
    plus proportional fee, and price plus minimum fee.
    """
    rate = commission_bps / 10000 * multiplier
    floor = minimum_commission * multiplier
    slip = slippage_bps / 10000 * multiplier
    order = F.struct((F.col("delta") > 0).alias("buy"), "position", "symbol", "delta", "close", "cost_exempt")
    books = requests.groupBy("account").agg(F.first("cash").alias("cash"), F.array_sort(F.collect_list(order)).alias("orders"))
    empty = F.array().cast("array<struct<symbol:string,delta:double,cash_after:double>>")
    state = F.struct(F.col("cash").cast("double").alias("cash"), empty.alias("done"))

    def step(s: Column, o: Column) -> Column:
        price = o["close"] * (1 + F.when(o["buy"], slip).otherwise(-slip))
        cash = s["cash"]
        lots = F.least(F.floor(cash / (price * (1 + rate)) / lot), F.floor((cash + 1e-8 - floor) / price / lot),
                       F.floor((cash + 1e-8) / (price * (1 + rate)) / lot))
        amount = F.when(o["buy"], F.least(F.abs(o["delta"]), lots * lot)).otherwise(F.abs(o["delta"]))
        small = ~o["cost_exempt"] & (amount * o["close"] < minimum_trade)
        signed = F.when(o["buy"], amount).otherwise(-amount).cast("double")
        fee = F.greatest(F.lit(floor), amount * price * rate)
        left = cash - signed * price - fee
        done = F.struct(F.struct(o["symbol"].alias("symbol"), signed.alias("delta"), left.alias("cash_after")).alias("x"))["x"]
        kept = F.struct(left.alias("cash"), F.concat(s["done"], F.array(done)).alias("done"))
        return F.when((amount <= 0) | small, s).otherwise(kept)

    plan = books.select("account", F.aggregate("orders", state, step).alias("p"))
    return plan.select("account", F.explode("p.done").alias("o")).select("account", "o.*")


def account_faults(accounts: DataFrame, holdings: DataFrame, assets: DataFrame, as_of: Column) -> DataFrame:
    """Accounts with unsupported holdings, bad numbers or a stale date."""
    foreign = holdings.join(assets.select("symbol"), "symbol", "left_anti").select("account", F.lit("unsupported_position").alias("fault"))
    bad = F.col("quantity").isNull() | F.isnan("quantity") | (F.col("quantity") < 0)
    numbers = holdings.where(bad).select("account", F.lit("invalid_quantity").alias("fault"))
    cash = accounts.where(F.col("cash").isNull() | F.isnan("cash") | (F.col("cash") < 0)).select("account", F.lit("invalid_cash").alias("fault"))
    stale = accounts.where(F.col("as_of").isNull() | (F.col("as_of") != as_of)).select("account", F.lit("stale_date").alias("fault"))
    return foreign.unionByName(numbers).unionByName(cash).unionByName(stale).distinct()
