"""The corpus pipeline: language, quality rules, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, language_id, near_dup, packing, quality_rules
from corvane.llm._common import delete, materialize, scratch_path, scratch_scope, table
from corvane.llm.tokens import tokenizer_path

#: A document whose letters fit no learned language's profile better than this has no language.
MIN_LANG_SCORE = 0.05


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a change of texts."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or near no learned language, go.

    A null or empty text has no letter. Where no document has a language to learn from, all with a letter stay. Rows are judged one
    by one, so repeated rows go or stay alike; an empty table stays empty; other columns pass, whatever their names."""
    return language_id.keep_languages(docs, MIN_LANG_SCORE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that fail the base rules or are depleted.

    Null and empty texts fail (too few words). A line over the limit stays in the lowest doc_id that has it; rows with a null
    doc_id never keep it. Rows that share a doc_id and a text are judged alike; an empty table stays empty; other columns pass,
    whatever their names, but ``n_chars`` follows the text."""
    return _measured(quality_rules.clean(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays, that with the smallest doc_id.

    Null and empty texts are linked with nothing and stay. Rows that share a doc_id, or have none, stay if their texts differ; of
    rows alike in doc_id and text one stays. An empty table stays empty; other columns pass, whatever their names."""
    return near_dup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document of which no word is left goes.

    So null, empty and blank texts go. Rows are judged one by one; an empty table stays empty, and an empty benchmark cuts nothing;
    other columns pass, whatever their names, but ``n_chars`` follows the text."""
    cut = decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _measured(cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its place in a sequence of at most 4,096 tokens, and its token ids.

    A null or empty text is the end id alone; rows that share a doc_id, or have none, are packed each for itself; an empty table
    gives no rows; other columns are not read."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The first stage is a trained model and the last a heuristic: no SQL gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root, before = table(spark, sf_dir, "documents"), scratch_path(spark, "pipeline"), None
    for name, stage in STAGES:
        with scratch_scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, f"{root}/{name}")
        if before:
            delete(spark, before)
        before = f"{root}/{name}"
    return docs
