"""User factors: Spark SQL expressions over a symbol's own rows that cannot look ahead.

Spark analyses the text against an empty table of the same columns; the guard reads the
windows of the analysed plan, so aliases, defaults and negative lags are already resolved.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from contextlib import redirect_stdout

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Functions whose value depends on the whole partition, whatever their frame says.
WHOLE_PARTITION = ("percent_rank", "cume_dist", "ntile")
#: What a factor may not bring into the plan: other rows or tables, and more or fewer rows.
FOREIGN = ("scalar-subquery", "exists#", "lateral-subquery", "list#", "Aggregate [", "Generate ", "Join ", "PythonUDF")


def analysed(table: DataFrame, text: str, key: str, order: str) -> str:
    """The analysed plan of the expression over an empty table of the same columns."""
    empty = table.sparkSession.createDataFrame([], table.schema)
    shown = io.StringIO()
    with redirect_stdout(shown):
        empty.select(key, order, F.expr(text).alias("_factor")).explain(extended=True)
    return shown.getvalue().split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0]


def windows(plan: str) -> Iterator[str]:
    """What stands between the brackets of each window definition."""
    for found in re.finditer(r"windowspecdefinition\(", plan):
        depth, at = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(plan[at], 0)
            at += 1
        yield plan[found.end() : at - 1]


def refuse_look_ahead(table: DataFrame, text: str, key: str = "symbol", order: str = "date") -> None:
    """Raise ValueError unless every window goes by the key, in the order, and ends at the current row or before."""
    plan = analysed(table, text, key, order)
    if " more fields" in plan:
        raise ValueError("too many columns to judge the expression; select those it needs first")
    for name in FOREIGN:
        if name in plan:
            raise ValueError(f"a factor uses the rows of its own symbol only: {name.strip(' #[')} is not allowed")
    for name in WHOLE_PARTITION:
        if re.search(rf"\b{name}\(", plan):
            raise ValueError(f"{name} depends on later rows")
    shape = re.compile(rf"{re.escape(key)}, {re.escape(order)} ASC NULLS (?:FIRST|LAST), specifiedwindowframe\((RowFrame|RangeFrame), .+, (.+?)\)")
    for window in windows(plan):
        found = shape.fullmatch(re.sub(r"#\d+L?", "", window))
        if not found:
            raise ValueError(f"a window of a factor goes by {key} alone, in ascending order of {order}")
        kind, end = found.groups()
        if end != "currentrow$()" and not (kind == "RowFrame" and re.fullmatch(r"-\d+|0", end)):
            raise ValueError("a window of a factor ends at the current row or before it; forward references are not allowed")


def user_factors(table: DataFrame, texts: dict[str, str], key: str = "symbol", order: str = "date") -> DataFrame:
    """``key``, ``order``, ``factor`` and ``value`` of each named expression, after the guard."""
    for text in texts.values():
        refuse_look_ahead(table, text, key, order)
    wide = table.select(key, order, *[F.expr(t).cast("double").alias(f"_{i}") for i, t in enumerate(texts.values())])
    named = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"_{i}").alias("value")) for i, n in enumerate(texts)])
    return wide.select(key, order, F.explode(named).alias("_f")).select(key, order, "_f.*")
