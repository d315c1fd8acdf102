"""The registered queries ``opN_<name>`` and their DuckDB oracles, where SQL can express them."""

from __future__ import annotations

import os

import public_tokenizers
from adflow.llm import ann, bpe, chat, chat_repair, decontaminate, exact_dedup, langid, mixing, near_dedup, passages, quality, token_align, url_filter
from adflow.plans.registry import QueryFn


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tokenizer files lie at the same place on every machine; set ADFLOW_BPE_FILE, ADFLOW_PIECE_FILE for others.
BPE_FILE = os.environ.get("ADFLOW_BPE_FILE") or public_tokenizers.path("byte_bpe_50k.json")
PIECE_FILE = os.environ.get("ADFLOW_PIECE_FILE") or public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe(spark, sf_dir):
    return bpe.roundtrip_report(_table(spark, sf_dir, "documents"), BPE_FILE)


def op2_language_id(spark, sf_dir):
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark, sf_dir):
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op4_quality(spark, sf_dir):
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_ann(spark, sf_dir):
    return ann.ann_report(_table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.rules_table(spark, url_filter.RULES))


def op7_near_dedup(spark, sf_dir):
    return near_dedup.near_report(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return passages.passages_report(_table(spark, sf_dir, "documents"))


def op9_mix_sources(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup_report(_table(spark, sf_dir, "documents"))


def op11_chat_repair(spark, sf_dir):
    return chat_repair.repair_report(_table(spark, sf_dir, "conversations"))


def op12_token_align(spark, sf_dir):
    return token_align.alignment_report(_table(spark, sf_dir, "documents"), BPE_FILE, PIECE_FILE)


def op13_decontamination(spark, sf_dir):
    return decontaminate.decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, QueryFn] = {
    "op1_bpe": op1_bpe,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_quality": op4_quality,
    "op5_ann": op5_ann,
    "op6_url_filter": op6_url_filter,
    "op7_near_dedup": op7_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_chat_repair": op11_chat_repair,
    "op12_token_align": op12_token_align,
    "op13_decontamination": op13_decontamination,
}

ORACLE: dict[str, str] = {
    "op3_chat_format": chat.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_chat_repair": chat_repair.ORACLE,
    "op13_decontamination": decontaminate.ORACLE,
}
