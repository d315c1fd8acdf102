"""Chat formatting after a cumulative-snapshot collapse.

Logs often hold a conversation several times, each snapshot some turns longer
than the last.  Every turn gets a rolling hash of all turns up to it (two
64-bit hashes of position, role and text, combined by exclusive or along the
conversation).  A conversation whose last hash is a turn hash inside a longer
one prefixes that one, and an anti-join drops it; of equal conversations the one
with the smallest id stays.  Only hashes are compared: texts move once, and are
gathered per conversation only for the ones that are rendered.  A first turn or
a whole conversation that is logged very often collapses in the partial
aggregation before each shuffle.

Defined results: null roles and texts count as empty; rows without a
conversation id belong to no conversation and are left out; a row repeated with
all its columns counts once; turns are ordered by (turn, role, text), nulls
first; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adflow.llm.base import Scratch

TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def numbered_turns(convs: DataFrame) -> DataFrame:
    """``conv_id, pos (from 1), role, text``: distinct turns in order."""
    rows = convs.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").dropDuplicates(["conv_id", "turn", "role", "text"])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "role", "text")


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that prefix no other one."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    hashed = turns.select("conv_id", "pos", F.xxhash64(F.lit(1), "pos", "role", "text").alias("a"),
                          F.xxhash64(F.lit(2), "text", "role", "pos").alias("b"))
    hashed = hashed.select("conv_id", "pos", F.bit_xor("a").over(order).alias("a"),
                           F.bit_xor("b").over(order).alias("b"), F.lead("pos").over(order).isNull().alias("last"))
    hashed = Scratch(turns.sparkSession, "chat").write(hashed, "prefixes")
    whole = hashed.where("last").groupBy("a", "b", "pos").agg(F.min("conv_id").alias("conv_id"))
    inside = hashed.where("not last").select("a", "b", "pos").distinct()
    return whole.join(inside, ["a", "b", "pos"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def format_chats(convs: DataFrame, turn: str = TURN) -> DataFrame:
    """``conv_id, n_turns, text``: each maximal conversation, rendered turn by turn by template ``turn``."""
    turns = numbered_turns(convs)
    head, rest = turn.split("{role}")
    middle, tail = rest.split("{text}")
    line = lambda t: F.concat(F.lit(head), t["role"], F.lit(middle), t["text"], F.lit(tail))
    return (turns.join(maximal(turns), "conv_id").groupBy("conv_id", "n_turns")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
            .select("conv_id", F.col("n_turns").cast("long").alias("n_turns"),
                    F.array_join(F.transform("turns", line), "").alias("text")))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id),
whole AS (SELECT l, min(conv_id) AS conv_id FROM c GROUP BY l),
inside AS (SELECT DISTINCT l[1:k] AS l FROM c, unnest(range(1, len(l))) AS p(k))
SELECT conv_id, len(l)::BIGINT AS n_turns,
       array_to_string(list_transform(l, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS text
FROM whole WHERE l NOT IN (SELECT l FROM inside)
"""
