"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import chat, collocations, decontaminate, language_id, language_model, lexical, near_dup, oracles, packing, quality_classifier, quality_rules, token_files, toxicity, warc
from corvane.llm._common import table
from corvane.llm.tokens import tokenizer_path


def op1_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.chat_digest(turns, tokenizer_path("byte_bpe_50k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_hyperdimensional_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op9_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_ftrl, op2_chat_windows, op3_token_files, op4_toxicity_subwords, op5_hyperdimensional_lang, op6_residual_packing, op7_line_frequency, op8_warc_segments, op9_fm_decontamination, op10_near_duplicates, op11_attention_lm, op12_block_max_search, op13_trie_collocations)}


def oracle_sql() -> dict[str, str]:
    """The other queries are models, tokenizers or heuristics; tests hold them against plain versions."""
    return {"op7_line_frequency": oracles.OP7, "op8_warc_segments": oracles.OP8, "op9_fm_decontamination": oracles.OP9, "op10_near_duplicates": oracles.OP10, "op12_block_max_search": oracles.OP12, "op13_trie_collocations": oracles.OP13}
