"""File line order for text-like sources.

Spark does not number lines.  Within one file split the rows of a partition
keep their order, so ``(file path, split start, monotonically_increasing_id)``
orders lines as they are in the files (files by path).  ``line_numbers`` turns
that into a 0-based global index with a per-split count and a prefix sum over
the (small) table of splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER_COLS = ("__file", "__split", "__mono")


def with_line_order(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__mono"),
    )


def order_key():
    return F.struct(*[F.col(c) for c in ORDER_COLS])


def drop_first_line_per_file(df: DataFrame) -> DataFrame:
    """``df`` from :func:`with_line_order`; removes each file's header line."""
    firsts = df.groupBy("__file").agg(F.min(F.struct("__split", "__mono")).alias("__k")).select(
        "__file", F.col("__k.__split").alias("__split"), F.col("__k.__mono").alias("__mono"))
    return df.join(firsts, on=list(ORDER_COLS), how="left_anti")


def line_numbers(df: DataFrame, out: str = "line") -> DataFrame:
    """``df`` from :func:`with_line_order`; adds a 0-based line index over all files."""
    counts = df.groupBy("__file", "__split").agg(F.count(F.lit(1)).alias("__n"))
    # one row per file split: a global window over it is small
    w = Window.orderBy("__file", "__split").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__file", "__split",
                           F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    wi = Window.partitionBy("__file", "__split").orderBy("__mono")
    inside = df.withColumn("__rn", F.row_number().over(wi))
    return (inside.join(before, on=["__file", "__split"], how="left")
            .withColumn(out, (F.col("__before") + F.col("__rn") - 1).cast("long"))
            .drop("__rn", "__before"))
