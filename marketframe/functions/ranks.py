"""Cross-section ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percent_rank_average(x: Column, *keys: str, ascending: bool = True) -> Column:
    """Percentile rank with average ties; missing values take no part.

    ``percent_rank()`` is a different quantity (it starts at zero and gives ties
    the lowest rank), hence the composition. Missing values sort last, so the
    rank of the others is not disturbed by them.
    """
    order = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    below = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    known = F.count(x).over(Window.partitionBy(*keys))
    return F.when(x.isNotNull(), (below + (ties - 1) / 2) / known)
