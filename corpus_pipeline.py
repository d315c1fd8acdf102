"""The corpus pipeline: documents in, token ids out.

``STAGES`` are ``(name, function)`` pairs; each function takes
``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adflow.llm import bpe, langid
from adflow.llm.base import Scratch, scratch_removed
from adflow.llm.exact_dedup import exact_dedup
from adflow.llm.mixing import mix_sources
from adflow.llm.near_dedup import near_dedup
from adflow.llm.queries import BPE_FILE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no text, or no letter in it) go; the others stay as they are.

    Null ids, languages and sources are kept; rows with a null ``lang`` are not
    learned from; repeated rows are all kept; if no row can be learned from, all
    go; an empty table gives an empty table; columns of any name are kept.
    """
    model = langid.learn(docs, ~langid.held_out())
    row = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    named = langid.identify(row, model, lang_col="lang_found", score_col="lang_score")
    return named.where(F.col("lang_found") != langid.UNDETERMINED).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest id stays.

    A null text counts as empty; a null id is smaller than any; of repeated rows
    of one id the one whose row sorts last stays; an empty table gives an empty
    table; columns of any name are kept.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id stays (null ids last).

    Null and empty texts are near their copies only; one of repeated rows stays;
    an empty table gives an empty table; columns of any name are kept.
    """
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal shares: each document is repeated or left out by its Poisson draw.

    A null source is a source; a source without any character is drawn at rate 1;
    rows with a null id draw by their text, and repeated rows alike; an empty
    table gives an empty table; a column ``copy`` or ``shuffle_key`` is kept as it was.
    """
    row = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    return mix_sources(row).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, ids``: the token ids of each document that the mix holds, a row a copy.

    A null or empty text has no ids; an empty table gives an empty table; other columns go.
    """
    return bpe.encode(docs.select("doc_id", "source", "text"), BPE_FILE).select("doc_id", "source", "ids")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("bpe", tokens)]

#: Three stages are models or sketches, which SQL cannot express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's own scratch tables go when its outcome is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        with scratch_removed(spark):
            docs = scratch.write(stage(spark, docs, sf_dir), f"{n}-{name}")
    return docs
