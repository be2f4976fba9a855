"""Bounded, downside-only multipliers and overlay flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.functions.timeseries import (
    by_symbol,
    YEAR_SESSIONS,
    change,
    clip,
    divide,
    flag,
    forward_fill_limited,
    holds,
    rolling_max,
    rolling_mean,
    rolling_std,
    rolling_sum,
)

# Strength of a multiplier, its floor, and the jump that voids a flow.
STRENGTH, FLOOR, SHARE_JUMP = 0.25, 0.75, 0.30


def share_flow_20(panel: DataFrame) -> DataFrame:
    """20-session change of log shares, known one session later, void after a jump.

    ``panel`` carries ``total_share`` on the sessions it was observed; an update gap
    of up to three sessions is bridged.
    """
    share = forward_fill_limited(F.when(F.col("total_share") > 0, F.col("total_share")), 3)
    logs = panel.withColumn("ls", F.ln(share))
    step = logs.withColumns({
        "raw20": F.col("ls") - F.lag("ls", 20).over(by_symbol()),
        "jump": flag(F.abs(F.col("ls") - F.lag("ls").over(by_symbol())) > SHARE_JUMP),
    })
    recent = step.withColumn("jump21", rolling_max(F.col("jump"), 21, 1))
    lagged = F.lag("raw20").over(by_symbol())
    void = holds(F.lag("jump21").over(by_symbol()) > 0)
    return recent.withColumn("flow20", F.when(~void, lagged)).drop("ls", "raw20", "jump", "jump21")


def factor_multipliers(panel: DataFrame) -> DataFrame:
    """Multipliers between 0.75 and 1 from trend, drawdown, traded value and flow.

    ``panel`` is a marked panel with ``total_share``; a missing input is neutral.
    """
    c, r, a = F.col("close"), F.col("ret"), F.col("amount")
    base = share_flow_20(panel).withColumns({
        "step": F.abs(c - F.lag(c).over(by_symbol())),
        "signed": F.signum(r) * a,
    })
    stats = base.withColumns({
        "vol63": rolling_std(r, 63) * YEAR_SESSIONS**0.5,
        "mom63": change(c, 63),
        "eff63": clip(divide(F.abs(c - F.lag(c, 63).over(by_symbol())), rolling_sum(F.col("step"), 63)), 0.0, 1.0),
        "dd126": divide(c, rolling_max(c, 126)) - 1,
        "balance20": divide(rolling_sum(F.col("signed"), 20), rolling_sum(a, 20)),
    })
    falling = clip(divide(-F.col("mom63"), F.col("vol63") * (63 / 252) ** 0.5), 0.0)
    trend = 1 - STRENGTH * F.tanh(falling * F.col("eff63"))
    downside = 1 - STRENGTH * clip((-F.col("dd126") - 0.05) / 0.15, 0.0, 1.0)
    volume = 1 - STRENGTH * clip(-F.col("balance20"), 0.0, 1.0)
    flow = 1 - STRENGTH * clip(-F.col("flow20") / 0.10, 0.0, 1.0)

    def neutral(x):
        return clip(F.coalesce(x, F.lit(1.0)), FLOOR, 1.0)

    one = F.lit(1.0)
    return stats.withColumns({
        "base": one,
        "trend_quality": neutral(trend),
        "downside_guard": neutral(downside),
        "volume_confirmation": neutral(volume),
        "share_flow": neutral(flow),
        "trend_and_flow": neutral((F.coalesce(trend, one) + F.coalesce(flow, one)) / 2),
    })
