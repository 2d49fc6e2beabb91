"""Table schemas, their creation, a guarded reset, and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "repositories": (
        "id string, full_name string, name string, owner string, description string, url string, homepage_url string, primary_language string, "
        "topics array<string>, stars int, forks int, is_archived boolean, is_fork boolean, created_at timestamp, pushed_at timestamp, readme string, "
        "crawled_at timestamp, readme_fetched_at timestamp, readme_status string"
    ),
    "repository_embeddings": "repo_id string, model_name string, embedding array<float>, source_hash string, embedded_at timestamp",
    "refresh_watermarks": "id int, total_repos int, readme_success int, embeddings int, recorded_at timestamp",
    "crawl_state": "id int, last_metadata_crawl_at timestamp, updated_at timestamp",
    "repository_guides": "repo_id string, guide string, model_name string, source_readme_fetched_at timestamp, generated_at timestamp",
    "repository_enrichment": (
        "repo_id string, source string, description string, queries array<string>, aliases array<string>, categories array<string>, "
        "model string, prompt_version string, generated_at timestamp"
    ),
    "repository_signals": "repo_id string, dependent_count int, dependent_package string, scorecard_score float, scorecard_date date, fetched_at timestamp",
    "repository_enrichment_terms": "repo_id string, terms array<string>",
}
KEYS = {
    "repositories": ["id"], "repository_embeddings": ["repo_id", "model_name"], "refresh_watermarks": ["id"], "crawl_state": ["id"],
    "repository_guides": ["repo_id"], "repository_enrichment": ["repo_id", "source"], "repository_signals": ["repo_id"],
    "repository_enrichment_terms": ["repo_id"],
}
#: Embeddings are kept apart by label, so that a label's filter prunes files.
PARTITIONS = {"repository_embeddings": ["model_name"]}
README_STATES = ("ok", "not_found", "empty", "error")
ENRICHMENT_SOURCES = ("awesome-mined", "llm")


def create(spark: SparkSession, root: str) -> None:
    """Empty tables under ``root`` for those that aren't there."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*PARTITIONS.get(name, [])).parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def append(rows: DataFrame, root: str, name: str) -> None:
    """Rows of any source into a table: columns by name in the table's types, null where the source has none."""
    kind = StructType.fromDDL(SCHEMAS[name])
    known = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
    known.write.mode("append").partitionBy(*PARTITIONS.get(name, [])).parquet(f"{root}/{name}")


def reset(spark: SparkSession, root: str, confirm: str) -> None:
    """Replace all tables by empty ones; ``confirm`` must repeat ``root``."""
    if confirm != root:
        raise ValueError("a reset must be confirmed with the root's own path")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("overwrite").partitionBy(*PARTITIONS.get(name, [])).parquet(f"{root}/{name}")


def violations(df: DataFrame, name: str) -> DataFrame:
    """rule, n of the rows that break a key or a value rule."""
    key = KEYS[name]
    doubled = df.groupBy(*key).count().where("count > 1").agg(F.lit("key").alias("rule"), F.count(F.lit(1)).alias("n"))
    rules = doubled
    if name == "repositories":
        bad = df.where(F.col("readme_status").isNotNull() & ~F.col("readme_status").isin(*README_STATES))
        rules = rules.unionByName(bad.agg(F.lit("readme_status").alias("rule"), F.count(F.lit(1)).alias("n")))
    if name == "repository_enrichment":
        rules = rules.unionByName(df.where(~F.col("source").isin(*ENRICHMENT_SOURCES)).agg(F.lit("source").alias("rule"), F.count(F.lit(1)).alias("n")))
    if name in ("refresh_watermarks", "crawl_state"):
        rules = rules.unionByName(df.where("id <> 1").agg(F.lit("single row").alias("rule"), F.count(F.lit(1)).alias("n")))
    return rules.where("n > 0")
