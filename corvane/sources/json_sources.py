"""JSON shapes: search nodes, query sets, run files, judgments, batch results, package listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.scratch import materialize

NODE = (
    "id string, nameWithOwner string, name string, owner struct<login:string>, description string, url string, homepageUrl string, "
    "primaryLanguage struct<name:string>, repositoryTopics struct<nodes:array<struct<topic:struct<name:string>>>>, "
    "stargazerCount int, forkCount int, isArchived boolean, isFork boolean, createdAt string, pushedAt string"
)
PAYLOAD = "description string, queries array<string>, aliases array<string>, categories array<string>"


def flatten_nodes(nodes: DataFrame) -> DataFrame:
    """Rows of search nodes given as JSON text in ``node``; rows without one (the ends of fragments) go."""
    n = nodes.where("node is not null").select(F.from_json("node", NODE).alias("n"))
    topics = F.coalesce(F.transform("n.repositoryTopics.nodes", lambda x: x["topic"]["name"]), F.array().cast("array<string>"))
    return n.select(
        "n.id", F.col("n.nameWithOwner").alias("full_name"), "n.name", F.col("n.owner.login").alias("owner"), "n.description", "n.url",
        F.nullif("n.homepageUrl", F.lit("")).alias("homepage_url"), F.col("n.primaryLanguage.name").alias("primary_language"), topics.alias("topics"),
        F.col("n.stargazerCount").alias("stars"), F.col("n.forkCount").alias("forks"), F.col("n.isArchived").alias("is_archived"), F.col("n.isFork").alias("is_fork"),
        F.to_timestamp("n.createdAt").alias("created_at"), F.to_timestamp("n.pushedAt").alias("pushed_at"),
    )


def batch_results(lines: DataFrame, id_map: DataFrame) -> DataFrame:
    """repo_id, payload of result lines {key, text}; unknown keys go, unparseable payloads are null."""
    outer = lines.select(F.from_json("value", "key string, text string").alias("r")).where("r.key is not null")
    rows = outer.select(F.col("r.key").alias("key"), F.from_json("r.text", PAYLOAD).alias("payload"))
    return rows.join(id_map, "key").select("repo_id", "payload")


def batch_requests(rows: DataFrame, order: str, size: int) -> tuple[DataFrame, DataFrame]:
    """((chunk, value) JSON lines, (chunk, key, repo_id) map) of requests (repo_id, prompt) in chunks of ``size``.

    Rows are put in order once and written: numbers are partition offsets, then the place within the partition."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ordered")
    parts = ordered.groupBy(F.shiftright("_m", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row a partition
    offsets, total = [], 0
    for r in parts:
        offsets.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(offsets or [(0, 0)], "part bigint, base bigint")
    numbered = ordered.withColumn("part", F.shiftright("_m", 33)).join(base, "part")  # a local table, of known size
    place = F.col("base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.withColumn("_place", place).withColumn("chunk", F.floor(place / size))
    numbered = numbered.withColumn("key", F.concat(F.lit("r"), (F.col("_place") - F.col("chunk") * size).cast("string")))
    return numbered.select("chunk", F.to_json(F.struct("key", "prompt")).alias("value")), numbered.select("chunk", "key", "repo_id")


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """query, doc, rank of a run file {results: {query: [docs]}}."""
    raw = spark.read.schema("system string, results map<string,array<string>>").json(path, multiLine=True)
    lists = raw.select("system", F.explode("results").alias("query", "docs"))
    return lists.select("system", "query", F.posexplode("docs").alias("rank", "doc")).withColumn("rank", F.col("rank") + 1)


def write_run(run: DataFrame, path: str, system: str) -> None:
    """One JSON line a query: system, query and its documents in order of rank."""
    docs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"])
    run.groupBy("query").agg(docs.alias("docs")).select(F.lit(system).alias("system"), "query", "docs").write.json(path)


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """query, doc, grade of {judgments: {query: {doc: {grade}}}}."""
    raw = spark.read.schema("judgments map<string,map<string,struct<grade:int,model:string,judged_at:string>>>").json(path, multiLine=True)
    return raw.select(F.explode("judgments").alias("query", "docs")).select("query", F.explode("docs").alias("doc", "j")).select("query", "doc", "j.grade")


def query_set(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """id, query, stratum of {queries: [...]}, one document a file or (``multi_line`` off) a line."""
    raw = spark.read.schema("queries array<struct<id:string,query:string,stratum:string,notes:string,expected:array<string>,relevant:array<string>>>").json(path, multiLine=multi_line)
    return raw.select(F.explode("queries").alias("q")).select("q.*")


def export_passages(repos: DataFrame, names: DataFrame, readme_chars: int = 1500) -> DataFrame:
    """JSON documents of the records in ``names`` (full_name)."""
    readme = F.left(F.coalesce("readme", F.lit("")), F.lit(readme_chars)).alias("readme")
    return repos.join(names, "full_name", "left_semi").select(F.to_json(F.struct("full_name", "description", "primary_language", "topics", readme)).alias("value"))


def scorecards(rows: DataFrame) -> DataFrame:
    """repo_id, scorecard_score, scorecard_date; rows with neither go."""
    out = rows.select("repo_id", F.col("score").cast("float").alias("scorecard_score"), F.to_date(F.left("date", F.lit(10))).alias("scorecard_date"))
    return out.where("scorecard_score is not null or scorecard_date is not null")


def tree_cut(paths: DataFrame, column: str = "path", limit: int = 500) -> DataFrame:
    """A tree's listing, its shallow paths first, cut to ``limit``."""
    depth = F.length(column) - F.length(F.replace(F.col(column), F.lit("/"), F.lit("")))
    return paths.orderBy(depth, column).limit(limit)
