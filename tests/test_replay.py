"""The event-flow replay beside a day-by-day walk over the same books."""

import datetime as dt
import random

import pytest

from marketframe.operators import accounting as L
from marketframe.operators.panel import complete_panel, number_sessions

DAY0 = dt.date(2021, 3, 1)
ACCOUNTS, STOCKS, FUND = ("one", "two"), ("s1", "s2"), "fund"


def day(n):
    return DAY0 + dt.timedelta(days=n)


def books(seed):
    """Sessions with gaps, quotes with gaps, fills, one dividend a stock, a reinvestment and a delisting."""
    rng = random.Random(seed)
    sessions = [day(n) for n in range(40) if n % 7 < 5]
    quotes = {(s, d): round(rng.uniform(5, 20), 2) for s in (*STOCKS, FUND) for d in sessions if d == sessions[0] or rng.random() < 0.8}
    fills = [(rng.choice(ACCOUNTS), s, d, rng.choice(["BUY", "BUY", "SELL"]), float(rng.randint(1, 9) * 100)) for s in (*STOCKS, FUND) for d in sessions if rng.random() < 0.3]
    ex = {"s1": day(14), "s2": day(20)}
    dividends = [("s1", ex["s1"], day(13), day(26), day(22), 0.31, 0.2), ("s2", ex["s2"], day(19), None, None, 0.5, None)]
    quotes.pop(("s1", next(d for d in sessions if d >= ex["s1"])), None)  # suspended on its ex date
    ratios = [(FUND, day(9), 1.05), (FUND, day(29), 1.1)]
    return sessions, quotes, fills, dividends, ratios, {"s2": day(31)}


def walked(sessions, quotes, fills, dividends, ratios, terminals, cash0, rate):
    """One account and session after the other, with dictionaries."""
    def session(d):
        return next((s for s in sessions if d is not None and s >= d), None)

    out = {}
    for account in ACCOUNTS:
        cash, claim, units, bonus, mark, due = cash0, 0.0, {}, {}, {}, []
        own = [f for f in fills if f[0] == account]
        for symbol, ex, record, pay, listing, per_share, shares in dividends:
            held = sum(q if side == "BUY" else -q for _, s, d, side, q in own if s == symbol and d <= record)
            if held > 0:
                due.append((symbol, session(ex), session(pay), session(listing), round(held * per_share * 0.8 + 1e-9, 2), float(int(held * (shares or 0) + 1e-8))))
        for i, today in enumerate(sessions):
            cash *= (1 + rate) ** ((today - sessions[max(0, i - 1)]).days / 365.25)
            for symbol, d, ratio in ratios:
                if session(d) == today:
                    units[symbol] = units.get(symbol, 0.0) * ratio
            for symbol, ex, pay, listing, net, new in due:
                if ex == today:
                    claim, bonus[symbol] = claim + net, bonus.get(symbol, 0.0) + new
                if pay == today:
                    claim, cash = claim - net, cash + net
                if listing == today:
                    bonus[symbol], units[symbol] = bonus.get(symbol, 0.0) - new, units.get(symbol, 0.0) + new
            for _, symbol, d, side, q in own:
                if d == today:
                    sign = 1 if side == "BUY" else -1
                    units[symbol] = units.get(symbol, 0.0) + sign * q
                    cash -= sign * q * 10 + 5
            for symbol, last in terminals.items():
                if session(last) == today:
                    units[symbol] = min(0.0, units.get(symbol, 0.0))
            for symbol in (*STOCKS, FUND):
                terms = [(per_share, shares or 0) for s, ex, *_, per_share, shares in dividends if s == symbol and session(ex) == today]
                if (symbol, today) in quotes:
                    mark[symbol] = quotes[symbol, today]
                elif terms and mark.get(symbol, 0) > 0:
                    mark[symbol] = max(0.0, (mark[symbol] - terms[0][0]) / (1 + terms[0][1]))
            holdings = sum(q * mark.get(s, 0.0) for kept in (units, bonus) for s, q in kept.items())
            out[account, today] = (cash, claim, holdings)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_is_the_walk(spark, seed):
    sessions, quotes, fills, dividends, ratios, terminals = books(seed)
    calendar = number_sessions(spark.createDataFrame([(d,) for d in sessions], "date date"))
    panel = complete_panel(spark.createDataFrame([(s, d, c) for (s, d), c in quotes.items()], "symbol string, date date, close double"), calendar)
    table = spark.createDataFrame([(*f, f[4] * 10, 5.0) for f in fills], "account string, symbol string, date date, side string, quantity double, notional double, commission double")
    actions = spark.createDataFrame(dividends, "symbol string, ex_date date, record_date date, pay_date date, div_listdate date, cash_div_tax double, stk_div double")
    flows = L.daily_flows(table)
    entitled = L.dividend_entitlements(flows, actions)
    flow = L.event_flow(flows, entitled, spark.createDataFrame(ratios, "symbol string, date date, ratio double"), calendar)
    ends = spark.createDataFrame(list(terminals.items()), "symbol string, terminal_date date")
    marked = L.event_marks(panel, actions, calendar)
    replayed = L.replay_nav(flow, marked, ends, calendar, 1e5, 0.03)
    want = walked(sessions, quotes, fills, dividends, ratios, terminals, 1e5, 0.03)
    got = {(r.account, r.date): (r.cash, r.claim, r.holdings) for r in replayed.collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-6), key
    # each event moves the value
    assert any(claim > 0 for _, claim, _ in want.values())
    bare = {(r.account, r.date): r.holdings for r in L.replay_nav(flow.withColumn("bonus", flow.bonus * 0), marked, ends.limit(0), calendar, 1e5, 0.03).collect()}
    assert any(abs(bare[k] - got[k][2]) > 1 for k in got)


def test_difference_names_the_damaged_account(spark):
    rows = [(a, day(n), 100.0 + n) for a in ACCOUNTS for n in range(5)]
    replayed = spark.createDataFrame(rows, "account string, date date, equity double")
    recorded = spark.createDataFrame([(a, d, e + (0.5 if (a, d) == ("two", day(3)) else 0.001)) for a, d, e in rows], replayed.schema)
    got = {r.account: (r.sessions, r.verified) for r in L.replay_difference(replayed, recorded).collect()}
    assert got == {"one": (5, 1), "two": (5, 0)}
    short = recorded.where("account = 'one' AND date > '2021-03-01'")
    assert L.replay_difference(replayed.where("account = 'one'"), short).first().verified == 0
