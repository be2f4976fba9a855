"""Where queries register themselves, and the SQL twin with the parts it uses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.sources.market import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    """Name a common table expression that oracle texts may use."""
    PARTS[name] = sql.strip()


def with_parts(body: str) -> str:
    """Put the named parts a text uses, and the parts those use, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(PARTS[name])

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in PARTS.items() if name in needed)
    return f"WITH {ctes}\n{body.strip()}"


def query(
    name: str, sql: str | None = None, floats: str = "", dates: str = "", digits: int = 6
) -> Callable:
    """Register a function of :class:`Market` under ``name``.

    ``floats`` are rounded and ``dates`` written as text in the query and in its
    SQL twin alike, so that both engines print the same values. Prices are cents
    over whole quantities, so exact ties occur and the engines break them in
    different ways: both sides add the same nudge, far below the last digit shown.
    """
    nudge = 3.7e-4 * 10.0**-digits
    float_names, date_names = floats.split(), dates.split()

    def present(df: DataFrame) -> DataFrame:
        shown = {c: F.round(F.col(c).cast("double") + F.lit(nudge), digits) for c in float_names}
        shown.update({c: F.col(c).cast("string") for c in date_names})
        return df.withColumns(shown) if shown else df

    def register(fn: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: present(fn(Market(spark, sf_dir)))
        if sql is not None:
            shown = [f"round(CAST({c} AS DOUBLE) + {nudge!r}, {digits}) AS {c}" for c in float_names]
            shown += [f"CAST({c} AS VARCHAR) AS {c}" for c in date_names]
            star = f"* REPLACE ({', '.join(shown)})" if shown else "*"
            ORACLES[name] = with_parts(f"SELECT {star} FROM (\n{sql.strip()}\n)")
        return fn

    return register


def frame(window: int | None = None, keys: str = "symbol", by: str = "date") -> str:
    """SQL window over a key's rows in date order; the last ``window`` rows or all so far."""
    rows = "UNBOUNDED" if window is None else str(window - 1)
    return f"(PARTITION BY {keys} ORDER BY {by} ROWS BETWEEN {rows} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, window: int, needed: int | None = None, keys: str = "symbol") -> str:
    """SQL of a rolling statistic with a minimum number of values."""
    w = frame(window, keys)
    return f"CASE WHEN count({x}) OVER {w} >= {needed or window} THEN {fn}({x}) OVER {w} END"


def lag(x: str, k: int, keys: str = "symbol") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {keys} ORDER BY date)"
