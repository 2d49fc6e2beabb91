"""Queries of source clients, stored folds, list mining, English analysis, ranking parts and work queues, each of its own operator."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from corvane.functions import analyze, ranking, text, vectors
from corvane.operators import document, evaluation, filters, health, lanes, mining, search, upsert
from corvane.plans import offline
from corvane.plans.catalog import (
    ALIVE, DOT, NOW, REQUESTS, SEARCH, WITH, WORDS_SQL, _alive, _base_vectors, _fts_sql, _hits, _search, _search_sql, _terms, lexical_index, plain_index, query, r6, requests,
)
from corvane.plans.catalog_tables import SHARDS_SQL
from corvane.scratch import scratch_path
from corvane.schema import SCHEMAS, append, create, read, violations
from corvane.sources import json_sources, paged, shards
from corvane.sources.adapters import BASE_LABEL, ENRICH_LABEL, enrichment, repositories, repository_embeddings, signals, table
from corvane.streaming import incremental

# --- source clients -------------------------------------------------------------------------------------

WIDE_SHARDS = 1000  # from here on


def _searched(spark):
    spark.dataSource.register(paged.PagedSource)
    fragments = [r["fragment"] for r in shards.fragments(shards.shard_table(spark, WIDE_SHARDS)).collect()]  # a fixed number
    read_pages = spark.read.format("corvane_paged").option("fragments", "|".join(fragments)).option("backoff_seconds", "0")
    return read_pages.option("fetch", "corvane.plans.offline.search_page").load()


@query("src01_paged_search", f"WITH {SHARDS_SQL} SELECT concat('s', lo, '-', page, '-', k) AS id, CAST(lo AS INT) AS stars FROM shards, range(3) p(page), range(2) n(k) WHERE lo >= {WIDE_SHARDS} AND lo < 5000", corpus=False)
def _(spark, sf_dir):
    return json_sources.flatten_nodes(_searched(spark)).select("id", "stars")


@query("src04_drain_outcomes", f"WITH {SHARDS_SQL} SELECT lo < 5000 AS whole, count(*) AS fragments, CAST(sum(CASE WHEN lo < 5000 THEN 6 ELSE 0 END) AS BIGINT) AS nodes FROM shards WHERE lo >= {WIDE_SHARDS} GROUP BY 1", corpus=False)
def _(spark, sf_dir):
    ends = paged.outcomes(_searched(spark))
    return ends.groupBy((F.col("outcome") == "done").alias("whole")).agg(F.count(F.lit(1)).alias("fragments"), F.sum("n").alias("nodes"))


README_SQL = """, n AS (SELECT id, full_name, CAST(substr(id, 2) AS BIGINT) AS n FROM repositories)
 SELECT id, CASE n % 11 WHEN 0 THEN 'not_found' WHEN 1 THEN 'empty' WHEN 3 THEN 'error' WHEN 2 THEN CASE WHEN n % 2 = 1 THEN 'ok' ELSE 'error' END ELSE 'ok' END AS readme_status,
 CASE WHEN n % 11 IN (0, 1, 3) OR (n % 11 = 2 AND n % 2 = 0) THEN NULL WHEN n % 11 = 2 THEN sha256(left(repeat('large ', 1366), 8192)) ELSE sha256(concat('# ', full_name)) END AS digest FROM n"""


@query("src05_readmes", README_SQL)
def _(spark, sf_dir):
    found = paged.fetch_readmes(repositories(spark, sf_dir), offline.readme, offline.raw_readme, backoff=0.0)
    return found.select("id", "readme_status", F.sha2("readme", 256).alias("digest"))


@query("src07_limits", " SELECT event_id, greatest(0.0, user_id - 75.0, CASE WHEN user_id <= 50 THEN event_id % 60 - 5.0 ELSE 0.0 END) AS wait FROM events", corpus=False)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wait = paged.wait_seconds(F.col("user_id"), F.col("event_id") % 60, F.col("user_id") - 70, F.lit(5))
    return e.select("event_id", wait.cast("double").alias("wait"))


@query("src09_project_batch", " SELECT id, CASE WHEN owner <> 'src3' THEN length(concat('github.com/', full_name)) END AS stars_count FROM repositories")
def _(spark, sf_dir):
    r = repositories(spark, sf_dir).select("id", "full_name")
    found = paged.lookup_projects(r, offline.projects).select("project_id", F.get_json_object("project", "$.starsCount").cast("bigint").alias("stars_count"))
    keyed = r.withColumn("project_id", F.lower(F.concat(F.lit("GitHub.com/"), "full_name")))
    return keyed.join(found, "project_id", "left").select("id", "stars_count")


@query("src10_dependents", " SELECT DISTINCT p_type AS system, p_name AS name, p_name NOT LIKE '%bolt' AS known, CASE WHEN p_name NOT LIKE '%bolt' THEN length(concat('systems/', p_type, '/packages/', replace(p_name, ' ', '%20'), '/versions/1%2F0:dependents')) END AS n FROM part", corpus=False)
def _(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_type").alias("system"), F.col("p_name").alias("name"), F.lit("1/0").alias("version")).distinct()
    found = paged.lookup_each(asked, "dependents", ["system", "name", "version"], offline.dependents)
    return found.select("system", "name", F.col("body").isNotNull().alias("known"), F.get_json_object("body", "$.dependentCount").cast("bigint").alias("n"))


@query("src11_embed", " SELECT id, CASE WHEN length(trim(description)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM repositories")
def _(spark, sf_dir):
    rows = paged.embed(repositories(spark, sf_dir).select("id", "description"), "description", lambda: paged.hashing_encoder(32), 32)
    return rows.select("id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 5).alias("norm"))


@query("src12_encoder", " SELECT p_name, count(*) AS n, 1 AS forms, 16 AS dim FROM part GROUP BY p_name", corpus=False)
def _(spark, sf_dir):
    rows = paged.embed(table(spark, sf_dir, "part").select("p_name"), "p_name", lambda: paged.hashing_encoder(16), 16)
    # a text has one vector, whatever batch it comes in
    shown = rows.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("embedding").cast("int").alias("forms"), F.max(F.size("embedding")).alias("dim"))
    return shown


@query("src13_batch_results", " SELECT concat('d', o.o_orderkey) AS repo_id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS description FROM orders o JOIN customer ON c_custkey = o_orderkey", corpus=False)
def _(spark, sf_dir):
    # the lines of orders without a customer of their number have unknown keys
    o = table(spark, sf_dir, "orders")
    payload = F.when(F.col("o_orderstatus") == "O", "not json").otherwise(F.to_json(F.struct(F.col("o_orderpriority").alias("description"))))
    lines = o.select(F.to_json(F.struct(F.concat(F.lit("r"), "o_orderkey").alias("key"), payload.alias("text"))).alias("value"))
    ids = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("key"), F.concat(F.lit("d"), "c_custkey").alias("repo_id"))
    return json_sources.batch_results(lines, ids).select("repo_id", "payload.description")


@query("src15_tree_and_file", " SELECT url, length(CASE WHEN length(html) > 2000 THEN concat(left(html, 2000), chr(10), '[truncated]') ELSE html END) AS n FROM (SELECT *, length(url) - length(replace(url, '/', '')) AS depth FROM pages) ORDER BY depth, url LIMIT 500", corpus=False)
def _(spark, sf_dir):
    listed = json_sources.tree_cut(table(spark, sf_dir, "pages"), "url")
    return listed.select("url", F.length(document.shown_file(F.col("html"), 2000)).cast("bigint").alias("n"))


@query("top04_shallow_first", " SELECT full_name FROM repositories ORDER BY length(full_name) - length(replace(full_name, '/', '')), full_name LIMIT 120")
def _(spark, sf_dir):
    return json_sources.tree_cut(repositories(spark, sf_dir).select("full_name"), "full_name", 120)


@query("src16_json_files", " SELECT CAST(item_id AS VARCHAR) AS id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'task' ELSE 'category' END AS stratum FROM benchmark", corpus=False)
def _(spark, sf_dir):
    path = scratch_path(spark, "query_set")
    one = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "task").otherwise("category").alias("stratum"))
    table(spark, sf_dir, "benchmark").select(F.to_json(F.struct(F.array(one).alias("queries"))).alias("value")).write.text(path)
    return json_sources.query_set(spark, path, multi_line=False).select("id", "query", "stratum")


# --- writes ---------------------------------------------------------------------------------------------


@query("snk05_upsert_generated", """, g AS (SELECT repo_id, 'llm' AS source, concat('new ', dependent_count) AS description FROM signals)
 SELECT coalesce(e.repo_id, g.repo_id) AS repo_id, coalesce(e.source, g.source) AS source, coalesce(g.description, e.description) AS description, e.queries[1] AS first_query
 FROM enrichment e FULL JOIN g ON g.repo_id = e.repo_id AND g.source = e.source""")
def _(spark, sf_dir):
    made = signals(spark, sf_dir).select("repo_id", F.lit("llm").alias("source"), F.concat(F.lit("new "), "dependent_count").alias("description"))
    merged = upsert.upsert(enrichment(spark, sf_dir), made, ["repo_id", "source"], ["description"])
    return merged.select("repo_id", "source", "description", F.get("queries", F.lit(0)).alias("first_query"))


@query("snk07_guide_cache", " SELECT concat('d', coalesce(doc_id, page_id)) AS repo_id, sha256(coalesce(html, text)) AS guide FROM documents FULL JOIN pages ON page_id = doc_id", corpus=False)
def _(spark, sf_dir):
    cached = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("repo_id"), F.col("text").alias("guide"))
    made = table(spark, sf_dir, "pages").select(F.concat(F.lit("d"), "page_id").alias("repo_id"), F.col("html").alias("guide"))
    return upsert.upsert(cached, made, ["repo_id"], ["guide"]).select("repo_id", F.sha2("guide", 256).alias("guide"))


def folded(text_sql: str) -> str:
    """SQL of the distinct words of a text, sorted."""
    return f"array_to_string(list_sort(list_distinct({WORDS_SQL.format(text_sql)})), ' ')"


@query("snk11_rebuild_terms", f" SELECT repo_id, {folded("concat_ws(' ', array_to_string(queries, ' '), description)")} AS terms FROM enrichment")
def _(spark, sf_dir):
    path = scratch_path(spark, "terms")
    older = enrichment(spark, sf_dir).withColumn("description", F.lit("what stood there before"))
    lanes.rebuild_terms(older, path, text.words)  # is replaced
    return lanes.rebuild_terms(enrichment(spark, sf_dir), path, text.words).select("repo_id", F.array_join("terms", " ").alias("terms"))


@query("snk15_batch_requests", " SELECT CAST((rn - 1) // 150 AS BIGINT) AS chunk, concat('r', (rn - 1) % 150) AS key, repo_id FROM (SELECT concat('d', doc_id) AS repo_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)", corpus=False)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("repo_id"), F.col("text").alias("prompt"))
    return json_sources.batch_requests(rows, "doc_id", 150)[1].select("chunk", "key", "repo_id")


FILLED = {"repositories": "repositories", "repository_embeddings": "repository_embeddings", "repository_enrichment": "enrichment", "repository_signals": "signals"}


@query("snk17_schema", f" SELECT name, columns, coalesce(n, 0) AS n_rows, 0 AS violations FROM (VALUES {', '.join(f"('{n}', {len(s.split(', '))})" for n, s in SCHEMAS.items())}) t(name, columns) LEFT JOIN ({' UNION ALL '.join(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in FILLED.items())}) USING (name)")
def _(spark, sf_dir):
    """All tables made, those that the given tables fill filled, and each read back with its rows and what breaks its rules."""
    root = scratch_path(spark, "tables")
    create(spark, root)
    for name, rows in (("repositories", repositories), ("repository_embeddings", repository_embeddings), ("repository_enrichment", enrichment), ("repository_signals", signals)):
        append(rows(spark, sf_dir), root, name)
    out = None
    for name in SCHEMAS:
        stored = read(spark, root, name)
        bad = violations(stored, name).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("violations"))
        one = stored.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), F.lit(len(stored.columns)).alias("columns"), "n_rows", bad.scalar().alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


# --- filters, joins, aggregates, windows and sets -------------------------------------------------------


@query("fil12_scorecard", " SELECT o_orderkey AS repo_id, CASE WHEN c_acctbal > 0 THEN CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) END AS score, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders LEFT JOIN customer ON c_custkey = o_orderkey WHERE c_acctbal > 0 OR o_orderstatus <> 'O'", corpus=False)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"), "c_acctbal")
    o = table(spark, sf_dir, "orders").join(c, "o_orderkey", "left")
    date = F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = o.select(F.col("o_orderkey").alias("repo_id"), F.when(F.col("c_acctbal") > 0, F.col("o_totalprice")).alias("score"), date.alias("date"))
    return json_sources.scorecards(rows).select("repo_id", F.col("scorecard_score").cast("double").alias("score"), F.date_format("scorecard_date", "yyyy-MM-dd").alias("day"))


ODD_NAMES = "CASE WHEN is_fork THEN concat(full_name, '''; --') WHEN is_archived THEN name ELSE full_name END"


@query("fil13_guarded_names", f" SELECT id, {ODD_NAMES} AS full_name FROM repositories WHERE regexp_full_match({ODD_NAMES}, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+')")
def _(spark, sf_dir):
    named = F.when(F.col("is_fork"), F.concat("full_name", F.lit("'; --"))).when(F.col("is_archived"), F.col("name")).otherwise(F.col("full_name"))
    return filters.well_named(repositories(spark, sf_dir).select("id", named.alias("full_name")))


@query("joi02_left_flags", " SELECT id, coalesce(len(queries) > 1, false) AS flag FROM repositories LEFT JOIN enrichment ON repo_id = id")
def _(spark, sf_dir):
    flags = enrichment(spark, sf_dir).select(F.col("repo_id").alias("id"), (F.size("queries") > 1).alias("flag"))
    return lanes.with_flags(repositories(spark, sf_dir).select("id"), flags, "id", "flag")


@query("joi03_enrichment_only", _fts_sql("", "SELECT query_id, repo_id, r.stars FROM members JOIN repositories r ON r.id = repo_id WHERE NOT member AND in_terms = n_all"))
def _(spark, sf_dir):
    r = repositories(spark, sf_dir)
    found = lanes.enrichment_only(lanes.coverage(r, requests(spark, sf_dir), _terms(spark, sf_dir), index=lexical_index(spark, sf_dir)))
    return found.join(r.select(F.col("id").alias("repo_id"), "stars"), "repo_id").select("query_id", "repo_id", "stars")


@query("joi04_candidate_terms", f" SELECT repo_id, {folded("concat_ws(' ', array_to_string(queries, ' '), description)")} AS terms FROM enrichment WHERE repo_id IN (SELECT id FROM repositories ORDER BY stars DESC, id LIMIT 300)")
def _(spark, sf_dir):
    candidates = repositories(spark, sf_dir).select(F.col("id").alias("repo_id"), "stars").orderBy(F.desc("stars"), "repo_id").limit(300)
    return lanes.candidate_terms(_terms(spark, sf_dir), candidates).select("repo_id", F.array_join("terms", " ").alias("terms"))


@query("joi07_display_similarity", f" SELECT id, round(coalesce({DOT.format(a='e.embedding', b='q.embedding')}, 0.0), 6) AS similarity FROM (SELECT id FROM repositories ORDER BY stars DESC, id LIMIT 50) LEFT JOIN (SELECT * FROM repository_embeddings WHERE model_name = 'base') e ON repo_id = id LEFT JOIN (SELECT * FROM embeddings WHERE vec_id = 0) q ON true")
def _(spark, sf_dir):
    page = repositories(spark, sf_dir).select("id", "stars").orderBy(F.desc("stars"), "id").limit(50).select(F.col("id").alias("repo_id"), F.lit(0).cast("bigint").alias("vec_id"))
    asked = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    rows = page.join(_base_vectors(spark, sf_dir).select("repo_id", "embedding"), "repo_id", "left").join(asked, "vec_id", "left")
    return rows.select(F.col("repo_id").alias("id"), r6(F.coalesce(vectors.dot(F.col("embedding"), F.col("vector")), F.lit(0.0))).alias("similarity"))


@query("joi08_left_is_null", " SELECT e.repo_id, e.model_name FROM repository_embeddings e LEFT JOIN enrichment x ON x.repo_id = e.repo_id WHERE x.repo_id IS NULL ORDER BY e.repo_id, e.model_name LIMIT 400")
def _(spark, sf_dir):
    vectors_of = repository_embeddings(spark, sf_dir).select("repo_id", "model_name")
    return filters.pending(vectors_of, enrichment(spark, sf_dir).select("repo_id"), ["repo_id"], F.lit(True), [F.asc("repo_id"), F.asc("model_name")], 400)


@query("agg07_concat_terms", rf" SELECT conv_id, array_to_string(flatten(list({WORDS_SQL.format('text')} ORDER BY turn)), ' ') AS lexemes FROM conversations GROUP BY conv_id", corpus=False)
def _(spark, sf_dir):
    every = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), every.alias("lexemes"))
    return lanes.concat_terms(rows, ["conv_id"]).select("conv_id", F.array_join("lexemes", " ").alias("lexemes"))


@query("win03_score_rank", " SELECT owner AS query_id, id, row_number() OVER (PARTITION BY owner ORDER BY stars % 7 DESC, stars DESC, id) AS rnk FROM repositories QUALIFY rnk <= 3")
def _(spark, sf_dir):
    rows = repositories(spark, sf_dir).select(F.col("owner").alias("query_id"), "id", "stars")
    return lanes.best_of(rows, [F.desc(F.col("stars") % 7), F.desc("stars"), F.asc("id")], 3).select("query_id", "id", F.col("rnk").cast("bigint").alias("rnk"))


BOUNDED = """, bounded AS (SELECT * FROM members WHERE member QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY own DESC, stars DESC, repo_id) <= 10
 UNION ALL SELECT * FROM members WHERE NOT member AND in_terms = n_all)
 SELECT query_id, repo_id, CAST(own + least(1, extra) AS BIGINT) AS coverage FROM bounded QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY own + least(1, extra) DESC, stars DESC, repo_id) <= 5"""


@query("top02_bounded_pre_limit", _fts_sql(ALIVE, BOUNDED))
def _(spark, sf_dir):
    lane = lanes.fulltext(_alive(spark, sf_dir), requests(spark, sf_dir), k=5, terms=_terms(spark, sf_dir), bounded=True, index=lexical_index(spark, sf_dir))
    return lane.select("query_id", "repo_id", "coverage")


@query("top03_final_order", " SELECT query_id, repo_id, rank FROM (SELECT owner AS query_id, id AS repo_id, row_number() OVER (PARTITION BY owner ORDER BY is_fork DESC, round(stars / 1000.0, 9) DESC, stars DESC, id) AS rank FROM repositories) WHERE rank <= 10")
def _(spark, sf_dir):
    hits = repositories(spark, sf_dir).select(F.col("owner").alias("query_id"), F.col("id").alias("repo_id"), F.col("is_fork").alias("exact_name"), (F.col("stars") / 1000.0).alias("hybrid_score"), "stars")
    return search.first_page(hits, 10).select("query_id", "repo_id", F.col("rank").cast("bigint").alias("rank"))


@query("top07_sample_report", " SELECT id, n FROM (SELECT id, len(queries) AS n FROM repositories JOIN enrichment ON repo_id = id) ORDER BY n DESC, id LIMIT 12")
def _(spark, sf_dir):
    e = enrichment(spark, sf_dir).select(F.col("repo_id").alias("id"), F.size("queries").cast("bigint").alias("n"))
    return health.sample_report(repositories(spark, sf_dir).select("id").join(e, "id"), "n", "id", 12)


@query("set03_seeded_sample", " SELECT doc_id, quality, toxic FROM labels ORDER BY md5(concat('7|', doc_id)), doc_id LIMIT 300", corpus=False)
def _(spark, sf_dir):
    return evaluation.sample_rows(table(spark, sf_dir, "labels"), ["doc_id"], 300, seed=7)


SPLITMIX = "(xor(x, x >> {0}) * {1}::UHUGEINT) % 18446744073709551616::UHUGEINT"
FISHER = f"""WITH d AS (SELECT doc_id, quality - toxic AS delta FROM labels WHERE quality - toxic IS NOT NULL),
 k AS (SELECT delta, ('0x' || left(md5(concat('0|', doc_id, '|', nth)), 16))::UBIGINT::UHUGEINT AS key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY delta) AS nth FROM d) WHERE delta <> 0),
 a AS (SELECT delta, w, (key + (w + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM k, range(1563) r(w)),
 b AS (SELECT delta, w, {SPLITMIX.format(30, '13787848793156543929')} AS x FROM a), c AS (SELECT delta, w, {SPLITMIX.format(27, '10723151780598845931')} AS x FROM b),
 m AS (SELECT delta, w, xor(x, x >> 31)::UBIGINT AS x FROM c),
 s AS (SELECT w * 64 + bit AS trial, sum(CASE WHEN (x >> bit::UBIGINT) & 1 = 1 THEN delta ELSE -delta END) AS total FROM m, range(64) t(bit) GROUP BY 1),
 o AS (SELECT count(*) AS n, abs(sum(delta) / count(*)) AS observed FROM d)
 SELECT (100000 - count(*) FILTER (abs(total / n) < observed - 1e-12) + 1) / 100001.0::DOUBLE AS p FROM s, o WHERE trial < 100000"""


@query("evl06_fisher", FISHER, corpus=False)
def _(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query"), (F.col("quality") - F.col("toxic")).cast("double").alias("delta"))
    return evaluation.fisher_p_distributed(l, permutations=100_000)


# --- full text ------------------------------------------------------------------------------------------

PARTS_SQL = "parts AS (SELECT concat('p', p_partkey) AS id, CAST(p_size AS BIGINT) AS stars, p_name, string_split(p_name, ' ') AS w FROM part)"


def _parts(spark, sf_dir):
    said = F.concat(F.lit("The "), "p_name", F.lit("s are running"))
    none = F.lit(None).cast("string")
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("x/y").alias("full_name"), F.array().cast("array<string>").alias("topics"), none.alias("primary_language"),
        said.alias("description"), none.alias("readme"), F.col("p_size").cast("bigint").alias("stars"), "p_name",
    )


@query("fts01_english_analyzer", f"WITH {PARTS_SQL} SELECT id, concat(replace(p_name, 'large', 'larg'), ' run') AS lexemes FROM parts", corpus=False)
def _(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", F.array_join(analyze.english_words(F.col("description")), " ").alias("lexemes"))


@query("fts06_websearch", f"""WITH {PARTS_SQL}, c AS (SELECT id, stars, w[1] AS a, w[2] AS b, (w[1] IN ('hot', 'old'))::INT + (w[2] IN ('gizmo', 'anvil'))::INT AS coverage FROM parts)
 SELECT id AS repo_id, coverage, stars, row_number() OVER (ORDER BY coverage DESC, stars DESC, id) AS rnk FROM c WHERE coverage >= 2 OR (b = 'gizmo' AND a <> 'hot') OR (a = 'old' AND b = 'anvil') QUALIFY rnk <= 200""", corpus=False)
def _(spark, sf_dir):
    found = lanes.fulltext_websearch(_parts(spark, sf_dir), 'the gizmos -hot OR "old anvils"')
    return found.select("repo_id", "coverage", "stars", F.col("rnk").cast("bigint").alias("rnk"))


LIGHT = "concat_ws(' ', translate(full_name, '/_', '  '), array_to_string(topics, ' '), primary_language, description)"
FULL = "concat_ws(' ', translate(full_name, '/_', '  '), array_to_string(topics, ' '), primary_language, description, left(readme, 2500))"


@query("fts02_full_document", f" SELECT id, len(list_distinct({WORDS_SQL.format(FULL)})) AS n FROM repositories")
def _(spark, sf_dir):
    return repositories(spark, sf_dir).select("id", F.size(text.words(lanes.full_text())).cast("bigint").alias("n"))


@query("fts03_light_document", f" SELECT id, len(list_distinct({WORDS_SQL.format(LIGHT)})) AS n FROM repositories")
def _(spark, sf_dir):
    return repositories(spark, sf_dir).select("id", F.size(text.words(lanes.light_text())).cast("bigint").alias("n"))


@query("fts04_enrichment_document", f" SELECT repo_id, {folded("concat_ws(' ', array_to_string(queries[1:2], ' '), concat('kind ', source), array_to_string(queries, ' '), description)")} AS terms FROM enrichment")
def _(spark, sf_dir):
    e = enrichment(spark, sf_dir).withColumns({"aliases": F.slice("queries", 1, 2), "categories": F.array(F.concat(F.lit("kind "), "source"))})
    return lanes.fold_terms(e, analyze=text.words).select("repo_id", F.array_join("terms", " ").alias("terms"))


@query("fts09_slots", rf", {REQUESTS} SELECT query_id, w AS lexeme, ord AS slot FROM (SELECT query_id, unnest(l) AS w, generate_subscripts(l, 1) AS ord FROM (SELECT query_id, list_sort(list_distinct({WORDS_SQL.format('query')})) AS l FROM requests)) WHERE ord <= 8")
def _(spark, sf_dir):
    return lanes.query_slots(requests(spark, sf_dir), text.words).where("slot").select("query_id", "lexeme", (F.col("place") + 1).cast("bigint").alias("slot"))


@query("vec04_indexed_recall", f", {REQUESTS} SELECT count(*) * 10 AS wanted, true AS enough FROM requests WHERE vector IS NOT NULL")
def _(spark, sf_dir):
    base = _base_vectors(spark, sf_dir)
    index = lanes.build_vector_index(base, scratch_path(spark, "vectors"))
    asked = requests(spark, sf_dir)
    exact = lanes.dense(base, asked, k=10).select("query_id", "repo_id")
    near = lanes.dense_indexed(index, asked, k=10).select("query_id", "repo_id", F.lit(1).alias("found"))
    both = exact.join(near, ["query_id", "repo_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("enough"))


# --- curated lists --------------------------------------------------------------------------------------

#: A list for each brand: a heading and an entry for each part, in a fence for the largest.
ENTRIES_SQL = """src AS (SELECT concat('lists/', replace(p_brand, '#', '-')) AS list_name, p_partkey, p_name, p_type, p_size, concat('own', length(p_name), '/', replace(p_name, ' ', '-'), '-x') AS full_name FROM part),
 entries AS (SELECT list_name, CAST(row_number() OVER (PARTITION BY list_name ORDER BY p_partkey) - 1 AS INT) AS place, full_name, p_name AS alias, concat('A ', p_name, ' of the type ', lower(p_type), '.') AS description, concat(p_type, ' things') AS category FROM src WHERE p_size <= 45)"""


def _lists(spark, sf_dir):
    link = F.concat(F.lit("- ["), "p_name", F.lit("](https://github.com/own"), F.length("p_name"), F.lit("/"), F.translate("p_name", " ", "-"), F.lit("-x) - A **"), "p_name", F.lit("** of the type "), F.lower("p_type"), F.lit(". ([Demo](https://d)) `MIT`"))
    entry = F.concat(F.lit("## "), "p_type", F.lit(" things\n"), link)
    entry = F.when(F.col("p_size") > 45, F.concat(F.lit("```\n"), entry, F.lit("\n```"))).otherwise(entry)
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("lists/"), F.translate("p_brand", "#", "-")).alias("list_name"), "p_partkey", entry.alias("entry"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "entry"))), lambda x: x["entry"])
    return rows.groupBy("list_name").agg(F.concat(F.lit("# Awesome things\n"), F.array_join(parts, "\n")).alias("content"))


def _entries(spark, sf_dir):
    return mining.parse_lists(_lists(spark, sf_dir))


@query("min01_parse_lists", f"WITH {ENTRIES_SQL} SELECT list_name, place, full_name, description, concat('things > ', category) AS trail FROM entries", corpus=False)
def _(spark, sf_dir):
    return _entries(spark, sf_dir).select("list_name", "place", "full_name", "description", F.array_join("categories", " > ").alias("trail"))


@query("min02_links", " SELECT p_partkey, CASE WHEN p_size <= 20 THEN concat('o/', replace(p_name, ' ', '.')) WHEN p_size <= 30 THEN concat('o/', replace(p_name, ' ', '_')) END AS full_name FROM part", corpus=False)
def _(spark, sf_dir):
    # a record's link with .git and an anchor, with www and a slash, a link below a record, and one to a page that is none
    p = table(spark, sf_dir, "part")
    at = F.when(F.col("p_size") <= 20, F.concat(F.lit("https://github.com/o/"), F.translate("p_name", " ", "."), F.lit(".git#read")))
    at = at.when(F.col("p_size") <= 30, F.concat(F.lit("http://www.github.com/o/"), F.translate("p_name", " ", "_"), F.lit("/")))
    at = at.when(F.col("p_size") <= 40, F.lit("https://github.com/o/r/tree/main")).otherwise(F.lit("https://github.com/topics/x"))
    lists = p.select(F.col("p_partkey").cast("string").alias("list_name"), F.concat(F.lit("* [x]("), at, F.lit(")")).alias("content"))
    found = mining.parse_lists(lists).select(F.col("list_name").cast("bigint").alias("p_partkey"), "full_name")
    return p.select("p_partkey").join(found, "p_partkey", "left")


@query("min04_heading_labels", " SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL WHEN p_size > 30 THEN NULL ELSE concat(p_type, ' ', p_name) END AS label FROM part", corpus=False)
def _(spark, sf_dir):
    heading = F.when(F.col("p_size") > 40, F.lit("How to Contribute")).when(F.col("p_size") > 30, F.concat("p_name", F.lit("?")))
    heading = heading.otherwise(F.concat(F.lit(":: Awesome *"), "p_type", F.lit("* `"), "p_name", F.lit("` {#some-id}")))
    return table(spark, sf_dir, "part").select("p_partkey", mining.heading_label(heading).alias("label"))


# the longest texts repeat a name of two words and are cut at the last space of their first 400 characters
@query("min05_descriptions", " SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL WHEN p_size > 20 THEN concat(p_name, ' of ', p_type, ', see now.') ELSE concat(trim(left(repeat(concat(p_name, ' '), 60), 400 - (400 % (length(p_name) + 1)))), CASE WHEN 400 % (length(p_name) + 1) > strpos(p_name, ' ') - 1 THEN concat(' ', split_part(p_name, ' ', 1)) ELSE '' END, '…') END AS said FROM part", corpus=False)
def _(spark, sf_dir):
    tail = F.when(F.col("p_size") > 40, F.lit(" - tiny"))
    tail = tail.when(F.col("p_size") > 20, F.concat(F.lit(" - **"), "p_name", F.lit("** of `"), "p_type", F.lit("`, see https://x.y/z now. ([Demo](https://d)) `MIT`")))
    tail = tail.otherwise(F.concat(F.lit(" — (note) "), F.repeat(F.concat("p_name", F.lit(" ")), 60), F.lit("[tag] [other]")))
    # parts lie in few row groups, however many they are; the texts are made after they are dealt to all cores
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return rows.select("p_partkey", mining.said_of(tail).alias("said"))


@query("min06_anchors", " SELECT p_partkey, CASE WHEN p_size <= 40 THEN p_name END AS name, CASE WHEN p_size > 40 THEN concat('www.', replace(p_name, ' ', '-')) WHEN p_size > 20 THEN concat('the ', lower(p_type), ' one') END AS said FROM part", corpus=False)
def _(spark, sf_dir):
    anchor = F.when(F.col("p_size") > 40, F.concat(F.lit("www."), F.translate("p_name", " ", "-")))
    anchor = anchor.when(F.col("p_size") > 20, F.concat("p_name", F.lit(" - the "), F.lower("p_type"), F.lit(" one"))).otherwise(F.concat(F.lit("**"), "p_name", F.lit("**")))
    return table(spark, sf_dir, "part").select("p_partkey", mining.anchor_name(anchor).alias("name"), mining.anchor_said(anchor).alias("said"))


@query("min07_targets", f"WITH {ENTRIES_SQL} SELECT lower(full_name) AS target, count(DISTINCT list_name) AS n_lists, arg_min(full_name, concat(list_name, lpad(CAST(place AS VARCHAR), 9, '0'))) AS display FROM entries GROUP BY 1", corpus=False)
def _(spark, sf_dir):
    return mining.vote(_entries(spark, sf_dir))[0].select("target", "n_lists", "display")


VOTES_SQL = """v AS (SELECT lower(full_name) AS target, 'description' AS kind, description AS value, list_name FROM entries UNION ALL SELECT lower(full_name), 'alias', alias, list_name FROM entries
 UNION ALL SELECT lower(full_name), 'category', category, list_name FROM entries UNION ALL SELECT lower(full_name), 'category', 'things', list_name FROM entries),
 votes AS (SELECT target, kind, value, count(DISTINCT list_name) AS votes, min(list_name) AS first_list FROM v GROUP BY target, kind, value)"""


@query("agg08_votes", f"WITH {ENTRIES_SQL}, {VOTES_SQL} SELECT * FROM votes", corpus=False)
def _(spark, sf_dir):
    return mining.vote(_entries(spark, sf_dir))[1].select("target", "kind", "value", "votes", "first_list")


@query("min08_select_payload", f"""WITH {ENTRIES_SQL}, {VOTES_SQL}, t AS (SELECT lower(full_name) AS target, count(DISTINCT list_name) AS n_lists FROM entries GROUP BY 1)
 SELECT concat('r', target) AS repo_id, 'awesome-mined' AS source,
  string_agg(value, chr(10) ORDER BY votes DESC, length(value) DESC, first_list, value) FILTER (WHERE kind = 'description') AS description,
  coalesce(string_agg(value, '|') FILTER (WHERE kind = 'alias' AND (n_lists < 4 OR votes >= 2)), '') AS aliases,
  string_agg(value, '|' ORDER BY votes DESC, first_list, value) FILTER (WHERE kind = 'category') AS categories
 FROM votes JOIN t USING (target) GROUP BY target""", corpus=False)
def _(spark, sf_dir):
    targets, votes = mining.vote(_entries(spark, sf_dir))
    none = F.lit(None).cast("string").alias("description")
    corpus = targets.select(F.concat(F.lit("r"), "target").alias("id"), F.col("target").alias("full_name"), F.element_at(F.split("target", "/"), -1).alias("name"), none)
    payload = mining.select_payload(targets, votes, corpus)
    return payload.select("repo_id", "source", "description", F.array_join("aliases", "|").alias("aliases"), F.array_join("categories", "|").alias("categories"))


# --- ranking --------------------------------------------------------------------------------------------


@query("rnk01_rrf", " SELECT l_orderkey, l_linenumber, round(1.0 / (20 + l_quantity) + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1.0 / (20 + l_linenumber) END + CASE WHEN l_linestatus = 'O' THEN 0.5 / (20 + l_suppkey) ELSE 0 END, 9) AS rrf FROM lineitem", corpus=False)
def _(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    dense, name = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")), F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))
    return l.select("l_orderkey", "l_linenumber", F.round(ranking.rrf(F.col("l_quantity"), dense, name), 9).alias("rrf"))


@query("rnk02_minmax", " SELECT o_orderkey, round(CASE WHEN mx > mn THEN (o_totalprice - mn) / (mx - mn) ELSE 1.0 END, 6) AS rel FROM (SELECT *, min(o_totalprice) OVER w AS mn, max(o_totalprice) OVER w AS mx FROM orders WINDOW w AS (PARTITION BY o_custkey))", corpus=False)
def _(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    rel = ranking.minmax(F.col("o_totalprice"), F.min("o_totalprice").over(w), F.max("o_totalprice").over(w))
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(rel).alias("rel"))


@query("rnk03_pivot", " SELECT c_mktsegment, round(least(20000.0, greatest(100.0, exp(avg(ln(greatest(c_acctbal, 1)))))), 6) AS pivot_value FROM customer GROUP BY c_mktsegment", corpus=False)
def _(spark, sf_dir):
    mean = F.avg(F.log(F.greatest(F.col("c_acctbal"), F.lit(1)).cast("double")))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(r6(ranking.star_pivot(mean)).alias("pivot_value"))


#: Two candidates for each request: the record of its number and the next one.
PAIRS = "fused AS (SELECT query_id, concat('d', query_id + k) AS repo_id, 1.0::DOUBLE / (20 + query_id + k) AS rrf FROM requests, range(2) n(k))"
WIDE = SEARCH[SEARCH.index(" wide AS (") : SEARCH.index(" page AS (")].rstrip().rstrip(",")


def _blended_sql(select: str) -> str:
    ranked = WIDE.replace("<<norm_exact>>", "OR (NOT contains(q, ' ') AND translate(q, '-._', '') <> '' AND (translate(lower(full_name), '-._', '') = translate(q, '-._', '') OR translate(lower(name), '-._', '') = translate(q, '-._', '')))")
    return f", {REQUESTS}, {PAIRS}, {ranked.replace('<<crit>>', '0.4::DOUBLE * (coalesce(dependent_count, 0) / (coalesce(dependent_count, 0) + 1000.0::DOUBLE))')} {select}"


def _blended(spark, sf_dir):
    asked = requests(spark, sf_dir)
    fused = asked.select("query_id", F.explode(F.array(F.col("query_id"), F.col("query_id") + 1)).alias("n")).select("query_id", F.concat(F.lit("d"), "n").alias("repo_id"), (F.lit(1.0) / (F.lit(20) + F.col("n"))).alias("rrf"))
    return search.blend(fused, repositories(spark, sf_dir), asked, NOW, ranking.ScoringWeights(criticality=0.4), signals(spark, sf_dir), True)


@query("rnk08_exact_name", _blended_sql("SELECT query_id, repo_id, exact_name FROM ranked"))
def _(spark, sf_dir):
    return _blended(spark, sf_dir).select("query_id", "repo_id", "exact_name")


@query("rnk09_contributions", _blended_sql("SELECT query_id, repo_id, round(demotion * rel, 6) AS similarity_contribution, round(demotion * st, 6) AS stars_contribution, round(demotion * rc, 6) AS recency_contribution, round(demotion * cr, 6) AS criticality_contribution, round(demotion * (rel + st + rc + cr), 6) AS hybrid_score FROM ranked"))
def _(spark, sf_dir):
    names = ["similarity_contribution", "stars_contribution", "recency_contribution", "criticality_contribution", "hybrid_score"]
    return _blended(spark, sf_dir).select("query_id", "repo_id", *[r6(F.col(c)).alias(c) for c in names])


@query("rnk10_phase_off", _search_sql(limit=3))
def _(spark, sf_dir):
    # with empty side tables the enriched search has the rows of the plain one
    terms = _terms(spark, sf_dir).where("false")
    none = signals(spark, sf_dir).where("false")
    found = search.search(repositories(spark, sf_dir), _base_vectors(spark, sf_dir), requests(spark, sf_dir), NOW, limit=3, enrich=True, terms=terms, signals=none, index=plain_index(spark, sf_dir))
    return _hits(found)


@query("evl10_batch_run", f"SELECT query_id AS query, string_agg(repo_id, ',' ORDER BY rank) AS docs FROM ({WITH}{_search_sql(limit=5)}) GROUP BY query_id", corpus=False)
def _(spark, sf_dir):
    run = search.run_of(_search(spark, sf_dir, limit=5))
    docs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"])
    return run.groupBy("query").agg(F.array_join(docs, ",").alias("docs"))


# --- increments -----------------------------------------------------------------------------------------


@query("inc02_watermark_slices", " SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1", corpus=False)
def _(spark, sf_dir):
    path = scratch_path(spark, "watermark")
    for started, aborted, cut_short in ((datetime(2024, 1, 3), 0, False), (datetime(2024, 1, 10, 5), 0, False), (datetime(2024, 1, 20), 1, False), (datetime(2024, 1, 25), 0, True)):
        incremental.advance_watermark(spark, path, started, aborted, cut_short)  # runs that left something out don't move it
    rows = filters.since(table(spark, sf_dir, "events"), "ts", incremental.read_watermark(spark, path))
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


QUEUE_SQL = """WITH b AS (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 8 AS batch FROM benchmark), f AS (SELECT batch, bool_or(item_id % 17 = 5) AS bad, bool_or(item_id % 37 = 30) AS out FROM b GROUP BY batch),
 stop AS (SELECT min(batch) AS first FROM f WHERE out) SELECT CAST(item_id AS VARCHAR) AS item, CASE WHEN first IS NOT NULL AND batch >= first THEN 'requeued' WHEN bad THEN 'failed' ELSE 'done' END AS state FROM b JOIN f USING (batch), stop"""


def _served(values: list[str]) -> list[str]:
    if any(int(v) % 37 == 30 for v in values):
        raise offline.ServiceError("out")
    if any(int(v) % 17 == 5 for v in values):
        raise ValueError("a bad item")
    return [v.upper() for v in values]


@query("inc05_requeued_batches", QUEUE_SQL, corpus=False)
def _(spark, sf_dir):
    # one worker's queue, of a table of a few hundred rows
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").cast("string").alias("value")).repartition(1).sortWithinPartitions("item_id")
    done = incremental.drain(items, "item_id", "value", _served, offline.ServiceError, batch=8)
    return done.select(F.col("key").alias("item"), "state")


__all__ = ["BASE_LABEL", "ENRICH_LABEL"]
