"""The driver's tables as a corpus of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_LABEL = "base"
ENRICH_LABEL = "base+enrich"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), "doc_id")
    status = F.when(F.col("doc_id") % 8 == 0, None).when(F.col("doc_id") % 8 == 1, "not_found").otherwise("ok")
    return d.select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.col("source").alias("owner"),
        name.alias("name"),
        F.concat("source", F.lit("/"), name).alias("full_name"),
        F.left("text", F.lit(120)).alias("description"),
        F.col("text").alias("readme"),
        F.col("lang").alias("primary_language"),
        F.split(F.concat("lang", F.lit(","), "source"), ",").alias("topics"),
        F.col("n_chars").alias("stars"),
        (F.col("doc_id") % 10 == 0).alias("is_archived"),
        (F.col("doc_id") % 17 == 0).alias("is_fork"),
        F.expr("cast(DATE '2024-01-01' - cast(doc_id % 900 AS int) AS timestamp)").alias("pushed_at"),
        status.alias("readme_status"),
    )


def repository_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector under the base label; those of the first five labels also under the enriched one."""
    e = table(spark, sf_dir, "embeddings")
    base = e.select(F.concat(F.lit("d"), "vec_id").alias("repo_id"), F.lit(BASE_LABEL).alias("model_name"), "embedding")
    more = e.where("label < 5").select(F.concat(F.lit("d"), "vec_id").alias("repo_id"), F.lit(ENRICH_LABEL).alias("model_name"), "embedding")
    return base.unionByName(more)


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's user turns as queries and first turn as description, for the record of its number."""
    c = table(spark, sf_dir, "conversations")
    queries = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"])
    first = F.min_by("text", "turn")
    folded = c.groupBy("conv_id").agg(queries.alias("queries"), first.alias("description"))
    return folded.select(F.concat(F.lit("d"), "conv_id").alias("repo_id"), F.lit("llm").alias("source"), "queries", "description")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a part as dependents of the record of its number."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("dependent_count"))
    return counts.select(F.concat(F.lit("d"), "l_partkey").alias("repo_id"), "dependent_count")


#: The same as SQL that DuckDB runs, for the oracles.
REPOSITORIES_SQL = """
SELECT concat('d', doc_id) AS id, source AS owner, concat('doc-', doc_id) AS name, concat(source, '/doc-', doc_id) AS full_name,
       left(text, 120) AS description, text AS readme, lang AS primary_language, string_split(concat(lang, ',', source), ',') AS topics,
       n_chars AS stars, doc_id % 10 = 0 AS is_archived, doc_id % 17 = 0 AS is_fork,
       CAST(DATE '2024-01-01' - CAST(doc_id % 900 AS INT) AS TIMESTAMP) AS pushed_at,
       CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 8 = 1 THEN 'not_found' ELSE 'ok' END AS readme_status
FROM documents"""
EMBEDDINGS_SQL = """
SELECT concat('d', vec_id) AS repo_id, 'base' AS model_name, embedding FROM embeddings
UNION ALL SELECT concat('d', vec_id), 'base+enrich', embedding FROM embeddings WHERE label < 5"""
ENRICHMENT_SQL = """
SELECT concat('d', conv_id) AS repo_id, 'llm' AS source,
       coalesce(list(text ORDER BY turn, text) FILTER (WHERE role = 'user'), []) AS queries,
       arg_min(text, turn) AS description
FROM conversations GROUP BY conv_id"""
SIGNALS_SQL = "SELECT concat('d', l_partkey) AS repo_id, count(*) AS dependent_count FROM lineitem GROUP BY l_partkey"
WITH = f"WITH repositories AS ({REPOSITORIES_SQL}), repository_embeddings AS ({EMBEDDINGS_SQL}), enrichment AS ({ENRICHMENT_SQL}), signals AS ({SIGNALS_SQL}) "
