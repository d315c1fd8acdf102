"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes of their text until a group holds one
document or all its texts have ended.  One level reads one *digit*, a run of
bytes: the digit widths grow geometrically, so a text of n bytes takes O(log n)
levels and only documents that still share everything read so far go on.
Groups are told apart by their bytes; no digest takes part in equality.

Each level is one aggregation on ``(group, digit)`` (partial sums before the
shuffle, so a huge group of copies arrives as one row per task) and one
equi-join that hands the new group number back to the rows (a hot group is a
skewed probe side, which adaptive execution splits).  Each level's outcome is a
written table: what is decided stays there, what is open is the next input.

Defined results: null text counts as the empty text; equality is after
lower-casing A-Z only; of equal texts the row with the largest id stays (a null
id is smaller than any; among repeated rows of one id, exactly one stays: where
whole rows are asked for, the one whose text and then columns sort last); an
empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adflow.llm.base import Scratch, ascii_lower

FIRST_DIGIT = 256       # bytes read by the first level
GROWTH = 4              # each level's digit is so many times wider than the last one's
WIDEST_DIGIT = 1 << 18  # bytes; from there on the width stays


def radix_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  first_digit: int = FIRST_DIGIT, growth: int = GROWTH,
                  widest_digit: int = WIDEST_DIGIT) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "radix")
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")
    rows = docs.select(F.lit(0).cast("long").alias("gid"), F.lit(0).cast("long").alias("uid"),
                       F.col(id_col).cast("long").alias("id"), text.alias("rest"))
    width, level, decided = first_digit, 0, []
    while True:
        digit = F.substring("rest", 1, width)
        left = F.expr(f"substring(rest, {width + 1})")
        ended = F.length("rest") <= width
        groups = (rows.select("gid", digit.alias("digit"), ended.alias("ended"), "id", "uid")
                  .groupBy("gid", "digit", "ended")
                  .agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("id", "uid")).alias("keep"))
                  .where("size > 1")
                  .withColumn("next_gid", F.monotonically_increasing_id()))
        groups = scratch.write(groups, f"groups-{level}")
        digest = F.sha2("rest", 256) if level == 0 else F.col("sha")
        rows = rows.select("gid", digit.alias("digit"), ended.alias("ended"), "id", "uid",
                           digest.alias("sha"), left.alias("rest"))
        # the same plan at every size: a small table of groups would otherwise be broadcast
        split = rows.join(groups.hint("merge"), ["gid", "digit", "ended"], "left")
        # The first level numbers the rows while its table is written, so its groups stay open once more.
        done = F.col("size").isNull() | (F.col("ended") if level else F.lit(False))
        uid = F.monotonically_increasing_id() if level == 0 else F.col("uid")
        split = split.select(
            F.coalesce("next_gid", F.lit(-1)).alias("gid"), uid.alias("uid"), "id", "sha",
            F.when(~done, F.col("rest")).alias("rest"),
            F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).alias("size"),
            F.coalesce(F.col("keep.uid") == F.col("uid"), F.lit(True)).alias("kept"),
            done.alias("done"))
        split = scratch.write(split, f"level-{level}", ["done"])
        decided.append(split.where("done"))
        rows = split.where("not done").select("gid", "uid", "id", "sha", "rest")
        if rows.isEmpty():
            break
        width, level = min(width * growth, widest_digit), level + 1
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select("id", "keep_id", F.col("size").cast("long").alias("group_size"), "kept",
                      F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    classes = radix_classes(docs, id_col, text_col).where("kept").select("id", "text_sha256").distinct()
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("rid"), sha.alias("rsha"))
    kept = rows.join(classes, F.col("rid").eqNullSafe(F.col("id"))
                     & (F.col("rsha") == F.col("text_sha256")), "left_semi")
    ordered = [text_col, *[f.name for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]]
    one = Window.partitionBy("rid", "rsha").orderBy(*[F.col("row").getField(c).desc() for c in ordered])  # repeated rows of one id
    return kept.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")


def exact_dedup_report(docs: DataFrame) -> DataFrame:
    """The columns of query ``op10_exact_dedup``."""
    return radix_classes(docs).withColumnRenamed("id", "doc_id")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
