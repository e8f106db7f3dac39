"""Running sums over groups of any size, without one task holding a group.

The rows of a group are dealt into blocks by a column that orders them, each block is summed, the
block sums are accumulated (a few thousand rows), and only within a block does a window run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_running_sum(df: DataFrame, keys: list[str], block: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before a row in its group.

    ``block`` must not fall along ``order``; ``keys`` may be empty (all rows are one group).
    """
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"__{k}") for k in (*keys, block)], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    same = F.lit(True)
    for k in (*keys, block):
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = df.join(starts, same).withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return found.drop("__start", *[f"__{k}" for k in (*keys, block)])
