"""Queries over keyed tables (updates written as they come and folded when read), a stream that feeds one, tables dealt alike, and the graph
index of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import lanes, vector_graph
from corvane.operators.keyed_table import KeyedTable, Policy
from corvane.plans.catalog import REQUESTS, query, requests
from corvane.scratch import file_system, scratch_path
from corvane.sources import colocated
from corvane.sources.adapters import BASE_LABEL, ENRICH_LABEL, enrichment, repositories, repository_embeddings, signals, table
from corvane.streaming import incremental, stateful

LINES = """t AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1),
 r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')"""


@query("snk01_update_log", f"""WITH {LINES}
 SELECT o_orderkey, o_custkey, CASE WHEN r.k IS NOT NULL THEN 'R' ELSE o_orderstatus END AS o_orderstatus, round(coalesce(t.price, o_totalprice), 2) AS o_totalprice
  FROM orders LEFT JOIN t ON t.k = o_orderkey LEFT JOIN r ON r.k = o_orderkey
 UNION ALL SELECT -s_suppkey, s_suppkey, NULL, NULL FROM supplier WHERE -s_suppkey NOT IN (SELECT o_orderkey FROM orders)""", corpus=False)
def _(spark, sf_dir):
    """Orders; then their lines' totals, a status for those with returns (of known orders alone), and suppliers as new rows (a known key
    would stay as it is)."""
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    orders, lines = table(spark, sf_dir, "orders").select(*names), table(spark, sf_dir, "lineitem")
    kept = KeyedTable(spark, scratch_path(spark, "orders"), orders.schema, ["o_orderkey"])
    kept.append(orders)
    kept.compact()
    kept.append(lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice")), Policy(()))
    returned = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("R").alias("o_orderstatus")).distinct()
    kept.append(returned, Policy((), known_only=True))
    kept.append(table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("o_orderkey"), F.col("s_suppkey").alias("o_custkey")), Policy((), keep_known=True))
    return kept.read().withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("snk14_keep_first_log", " SELECT doc_id, coalesce(quality, n_chars) AS grade FROM documents LEFT JOIN labels USING (doc_id)", corpus=False)
def _(spark, sf_dir):
    """Documents' labels are there first; lengths are appended for all documents and stay only where there was no label."""
    grades = KeyedTable(spark, scratch_path(spark, "grades"), "doc_id bigint, grade bigint", ["doc_id"])
    grades.append(table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("bigint").alias("grade")))
    grades.append(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("bigint").alias("grade")), Policy((), keep_known=True))
    return grades.read()


@query("inc03_stream_latest", " SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events GROUP BY user_id", corpus=False)
def _(spark, sf_dir):
    """The events table as a stream that is drained once, run again (nothing is new), and read as the last event of each user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    path = f"{sf_dir}/events.parquet"
    files, at = file_system(spark, path)
    folder, pattern = (sf_dir, "events.parquet") if files.getFileStatus(at).isFile() else (path, "*.parquet")
    snapshots = incremental.Snapshots(spark, scratch_path(spark, "latest"), events.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    checkpoint = scratch_path(spark, "stream")
    for _ in range(2):
        incremental.ingest(spark, folder, events.schema, snapshots, ["user_id"], ["ts", "event_id"], checkpoint, pattern=pattern)
    return snapshots.current().select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


_STORED: dict[tuple[str, str], colocated.Colocated] = {}


def stored_tables(spark, sf_dir) -> colocated.Colocated:
    """Records, vectors, enrichment and signals dealt alike; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        records = repositories(spark, sf_dir).select(F.col("id").alias("repo_id"), "stars", "primary_language", "is_archived", "readme_status")
        side = {"vectors": (repository_embeddings(spark, sf_dir), "model_name"), "enrichment": (enrichment(spark, sf_dir), None), "signals": (signals(spark, sf_dir), None)}
        _STORED[key] = colocated.store(spark, {"records": (records, None), **side})
    return _STORED[key]


@query("joi05_colocated_vectors", " SELECT repo_id, primary_language, len(embedding) AS n FROM repository_embeddings JOIN repositories ON id = repo_id WHERE model_name = 'base+enrich' AND NOT is_archived")
def _(spark, sf_dir):
    stored = stored_tables(spark, sf_dir)
    found = colocated.vectors_of(stored, ENRICH_LABEL, stored.table("records").where("not is_archived"))
    return found.select("repo_id", "primary_language", F.size("embedding").cast("bigint").alias("n"))


@query("joi06_colocated_signals", " SELECT id AS repo_id, stars, coalesce(dependent_count, 0) AS dependent_count FROM repositories LEFT JOIN signals ON repo_id = id")
def _(spark, sf_dir):
    return colocated.with_signals(stored_tables(spark, sf_dir)).select("repo_id", "stars", "dependent_count")


@query("fil03_colocated_pending", " SELECT id AS repo_id, stars FROM repositories WHERE NOT is_archived AND readme_status IS NOT NULL AND id NOT IN (SELECT repo_id FROM repository_embeddings WHERE model_name = 'base+enrich')")
def _(spark, sf_dir):
    rest = colocated.without_vector(stored_tables(spark, sf_dir), ENRICH_LABEL)
    return rest.where("not is_archived and readme_status is not null").select("repo_id", "stars")


@query("fil05_colocated_unexplained", " SELECT id AS repo_id, stars FROM repositories WHERE id NOT IN (SELECT repo_id FROM enrichment) AND id NOT IN (SELECT repo_id FROM signals)")
def _(spark, sf_dir):
    return colocated.unexplained(stored_tables(spark, sf_dir)).select("repo_id", "stars")


@query("vec04_graph_recall", f", {REQUESTS} SELECT count(*) * 10 AS wanted, true AS enough FROM requests WHERE vector IS NOT NULL")
def _(spark, sf_dir):
    """Of the ten nearest of each request the graph finds nine tenths at least."""
    rows, asked = repository_embeddings(spark, sf_dir).where(F.col("model_name") == BASE_LABEL), requests(spark, sf_dir)
    index = vector_graph.build_graph(rows, scratch_path(spark, "graph"))
    exact = lanes.dense(rows, asked, k=10).select("query_id", "repo_id")
    near = vector_graph.dense_by_graph(index, asked, k=10).select("query_id", "repo_id", F.lit(1).alias("found"))
    both = exact.join(near, ["query_id", "repo_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("inc03_state_latest", " SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n_rows FROM events GROUP BY user_id", corpus=False)
def _(spark, sf_dir):
    """The last event of each user and how many it had, from a stream's state over several batches and a restart."""
    events = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_id")
    folder, state, checkpoint = (scratch_path(spark, name) for name in ("events", "state", "checkpoint"))
    events.repartitionByRange(3, "event_id").write.parquet(folder)
    for _ in range(2):  # the second run finds nothing new, and the table as it is
        _, kept = stateful.latest_by_state(spark, folder, events.schema, state, ["user_id"], ["ts", "event_id"], checkpoint, max_files=1)
    return kept.read().select("user_id", "event_id", F.left("ts", F.lit(19)).alias("ts"), "n_rows")
