"""Ordered scans (row rank, running max) that stay parallel inside one huge group.

A plain ``Window.partitionBy(group).orderBy(x)`` sends each group to one task;
a group holding a third of all rows would be a third of the job on one core.
Here the order column is cut into blocks: one aggregate per ``(group, block)``,
a window over that small block table for what comes before each block, and a
window per ``(group, block)`` for the rest -- every step is split by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _block(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def running_max_before(df: DataFrame, by: Sequence[str], order: str, value: str,
                       block: int, out: str = "prev_max") -> DataFrame:
    """Max of ``value`` over the earlier rows (by ``order``) of the same ``by`` group."""
    by = list(by)
    staged = df.withColumn("__blk", _block(order, block))
    per_block = staged.groupBy(*by, "__blk").agg(F.max(value).alias("__bmax"))
    wb = Window.partitionBy(*by).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select(*by, "__blk", F.max("__bmax").over(wb).alias("__before"))
    wi = Window.partitionBy(*by, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = staged.withColumn("__inside", F.max(value).over(wi))
    return (inside.join(before, on=[*by, "__blk"], how="left")
            .withColumn(out, F.greatest("__inside", "__before"))
            .drop("__blk", "__inside", "__before"))


def row_rank(df: DataFrame, by: Sequence[str], order: str, block: int,
             descending: bool = False, out: str = "rank", top: int | None = None) -> DataFrame:
    """0-based position of each row within its ``by`` group ordered by ``order``.

    ``order`` values are assumed unique within a group (timestamps of a series,
    offsets of a partition).  With ``top``, a group whose largest ``order`` is
    another one is an error.
    """
    by = list(by)
    staged = df.withColumn("__blk", _block(order, block))
    counts = staged.groupBy(*by, "__blk").agg(F.count(F.lit(1)).alias("__n"), F.max(order).alias("__hi"))
    blk_order = F.col("__blk").desc() if descending else F.col("__blk").asc()
    wb = Window.partitionBy(*by).orderBy(blk_order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("__n").over(wb), F.lit(0))
    if top is not None:   # checked on the block table, where the rows meet it anyway
        ahead = F.when(F.max("__hi").over(Window.partitionBy(*by)) == F.lit(top), ahead).otherwise(
            F.raise_error(F.lit(f"the series has no point at {top}")).cast("long"))
    before = counts.select(*by, "__blk", ahead.alias("__before"))
    row_order = F.col(order).desc() if descending else F.col(order).asc()
    wi = Window.partitionBy(*by, "__blk").orderBy(row_order)
    inside = staged.withColumn("__rn", F.row_number().over(wi))
    return (inside.join(before, on=[*by, "__blk"], how="left")
            .withColumn(out, (F.col("__before") + F.col("__rn") - 1).cast("long"))
            .drop("__blk", "__rn", "__before"))
