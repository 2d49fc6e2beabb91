"""Records and their side tables dealt alike, so that joins between them move nothing.

Each table is written in the same number of buckets of the record's id, sorted by it; a table with labels (a vector's model) has a
folder for each label. A join of two such tables on the id reads bucket by bucket, and a condition on the label reads its folders alone.
The number of buckets is fixed when tables are made: joins stay without exchange only between tables that have it in common."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.scratch import scratch_path

BUCKETS = 64


@dataclass(frozen=True)
class Colocated:
    """Names of the stored tables; ``repo_id`` is the id in each."""

    spark: SparkSession
    names: dict[str, str]

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])


def store(spark: SparkSession, tables: dict[str, tuple[DataFrame, str | None]], path: str | None = None, buckets: int = BUCKETS) -> Colocated:
    """Write ``tables`` (name: rows with repo_id, and the label's column or None) under ``path`` and register them for the session."""
    path, names = path or scratch_path(spark, "colocated"), {}
    for name, (rows, label) in tables.items():
        names[name] = f"{name}_{uuid.uuid4().hex}"
        # one file of each bucket and label
        dealt = rows.repartition(buckets, "repo_id").write.format("parquet").option("path", f"{path}/{name}").mode("overwrite").bucketBy(buckets, "repo_id").sortBy("repo_id")
        (dealt.partitionBy(label) if label else dealt).saveAsTable(names[name])
    return Colocated(spark, names)


def drop(stored: Colocated) -> None:
    """Forget the tables; their files stay where they were written."""
    for name in stored.names.values():
        stored.spark.sql(f"DROP TABLE IF EXISTS {name}")


def vectors_of(stored: Colocated, label: str, records: DataFrame | None = None) -> DataFrame:
    """The vectors of a label that belong to the records (all stored ones, without them)."""
    records = stored.table("records") if records is None else records
    return stored.table("vectors").where(F.col("model_name") == label).join(records, "repo_id")


def without_vector(stored: Colocated, label: str) -> DataFrame:
    """Records that have no vector of the label."""
    done = stored.table("vectors").where(F.col("model_name") == label).select("repo_id")
    return stored.table("records").join(done, "repo_id", "left_anti")


def with_signals(stored: Colocated) -> DataFrame:
    """Records with their number of dependents; 0 where none is known."""
    rows = stored.table("records").join(stored.table("signals"), "repo_id", "left")
    return rows.withColumn("dependent_count", F.coalesce("dependent_count", F.lit(0).cast("bigint")))


def unexplained(stored: Colocated) -> DataFrame:
    """Records with neither enrichment nor signals."""
    rows = stored.table("records").join(stored.table("enrichment").select("repo_id"), "repo_id", "left_anti")
    return rows.join(stored.table("signals").select("repo_id"), "repo_id", "left_anti")
