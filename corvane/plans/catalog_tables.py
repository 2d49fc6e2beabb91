"""Work lists, writes, counts, windows, texts, packages, metrics, health and increments over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import ranking, text
from corvane.operators import document, evaluation, filters, health, lanes, mining, packages, search, upsert
from corvane.plans.catalog import NOW, WORDS_SQL, query, r6
from corvane.sources import json_sources, shards
from corvane.sources.adapters import BASE_LABEL, ENRICH_LABEL, enrichment, repositories, repository_embeddings, signals, table

E6 = "round({0}, 6)"


def long(c: str):
    return F.col(c).cast("bigint").alias(c)


# --- filters and work lists -----------------------------------------------------------------------------


@query("fil01_filters", " SELECT id, stars FROM repositories WHERE primary_language = 'de' AND list_has_any(topics, ['src3', 'src5', 'src8', 'src9']) AND stars >= 300 AND NOT is_archived")
def _(spark, sf_dir):
    return filters.apply_filters(repositories(spark, sf_dir), filters.SearchFilters("de", ("src3", "src5", "src8", "src9"), 300)).select("id", "stars")


@query("fil02_pending_topk", " SELECT id, stars FROM repositories WHERE readme_status IS NULL AND NOT is_archived ORDER BY stars DESC, id LIMIT 50")
def _(spark, sf_dir):
    order = [F.desc("stars"), F.asc("id")]
    return filters.pending(repositories(spark, sf_dir), None, None, F.expr("readme_status is null and not is_archived"), order, 50).select("id", "stars")


@query("fil03_pending_left_anti", " SELECT id, stars FROM repositories r WHERE NOT is_archived AND readme_status IS NOT NULL AND NOT EXISTS (SELECT 1 FROM repository_embeddings e WHERE e.repo_id = r.id AND model_name = 'base+enrich') ORDER BY stars DESC, id LIMIT 100")
def _(spark, sf_dir):
    done = repository_embeddings(spark, sf_dir).where(F.col("model_name") == ENRICH_LABEL).select(F.col("repo_id").alias("id"))
    return filters.pending(repositories(spark, sf_dir), done, ["id"], F.expr("not is_archived and readme_status is not null"), [F.desc("stars"), F.asc("id")], 100).select("id", "stars")


@query("fil04_pending_enriched", " SELECT id, stars FROM repositories r WHERE NOT is_archived AND id IN (SELECT repo_id FROM enrichment) AND NOT EXISTS (SELECT 1 FROM repository_embeddings e WHERE e.repo_id = r.id AND model_name = 'base+enrich') ORDER BY stars DESC, id LIMIT 40")
def _(spark, sf_dir):
    repos = repositories(spark, sf_dir).join(enrichment(spark, sf_dir).select(F.col("repo_id").alias("id")), "id", "left_semi")
    done = repository_embeddings(spark, sf_dir).where(F.col("model_name") == ENRICH_LABEL).select(F.col("repo_id").alias("id"))
    return filters.pending(repos, done, ["id"], ~F.col("is_archived"), [F.desc("stars"), F.asc("id")], 40).select("id", "stars")


@query("fil05_not_exists", " SELECT id, stars FROM repositories WHERE id NOT IN (SELECT repo_id FROM enrichment WHERE source = 'llm') AND id NOT IN (SELECT repo_id FROM signals WHERE dependent_count > 25) ORDER BY stars DESC, id LIMIT 60")
def _(spark, sf_dir):
    done = enrichment(spark, sf_dir).where("source = 'llm'").select(F.col("repo_id").alias("id"))
    in_flight = signals(spark, sf_dir).where("dependent_count > 25").select(F.col("repo_id").alias("id"))
    rest = repositories(spark, sf_dir).join(in_flight, "id", "left_anti")
    return filters.pending(rest, done, ["id"], F.lit(True), [F.desc("stars"), F.asc("id")], 60).select("id", "stars")


@query("fil06_fresh_interval", " SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate > TIMESTAMP '1998-08-01' - INTERVAL 200 DAY)")
def _(spark, sf_dir):
    fresh = table(spark, sf_dir, "orders").where("o_orderdate > timestamp_ntz '1998-08-01 00:00:00' - make_interval(0, 0, 0, 200)").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(fresh, "c_custkey", "left_anti").select("c_custkey")


@query("fil07_name_resolution", " SELECT id, lower(full_name) AS target FROM repositories WHERE lower(full_name) IN (SELECT concat('src', l_suppkey % 20, '/doc-', l_partkey) FROM lineitem)")
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("src"), F.col("l_suppkey") % 20, F.lit("/doc-"), "l_partkey").alias("target")).distinct()
    return repositories(spark, sf_dir).select("id", F.lower("full_name").alias("target")).join(keys, "target", "left_semi")


@query("fil08_lookup", " SELECT id, full_name, stars FROM repositories WHERE id = 'd7'")
def _(spark, sf_dir):
    return repositories(spark, sf_dir).where("id = 'd7'").select("id", "full_name", "stars")


@query("fil09_guide_stale", " SELECT id, CASE WHEN readme_status IS NULL THEN false WHEN is_fork THEN true ELSE pushed_at > TIMESTAMP '2023-01-01' END AS stale FROM repositories")
def _(spark, sf_dir):
    current = F.when(F.col("readme_status").isNotNull(), F.col("pushed_at").cast("timestamp"))
    cached = F.when(~F.col("is_fork"), F.lit(datetime(2023, 1, 1)).cast("timestamp"))
    return repositories(spark, sf_dir).select("id", filters.guide_stale(current, cached).alias("stale"))


@query("fil10_json_flatten", " SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", corpus=False)
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# --- sources --------------------------------------------------------------------------------------------

BANDS_SQL = "(VALUES (200, 400, 1), (400, 1000, 2), (1000, 2000, 50), (2000, 5000, 100), (5000, 10000, 500), (10000, 50000, 5000)) b(a, z, w)"
SHARDS_SQL = f"shards AS (SELECT CAST(lo AS BIGINT) AS lo, CAST(least(lo + w - 1, z - 1) AS BIGINT) AS hi FROM (SELECT unnest(range(a, z, w)) AS lo, z, w FROM {BANDS_SQL}) UNION ALL SELECT 50000, NULL)"


@query("src02_shards", f", {SHARDS_SQL} SELECT lo, CASE WHEN hi IS NULL THEN concat('stars:>=', lo) ELSE concat('stars:', lo, '..', hi) END AS fragment, (SELECT count(*) FROM repositories WHERE stars >= lo AND (hi IS NULL OR stars <= hi)) AS n FROM shards")
def _(spark, sf_dir):
    """Each fragment of the search with the records that it has to bring."""
    parts, records = shards.shard_table(spark), repositories(spark, sf_dir).select("stars")
    n = shards.assigned(records, parts).groupBy("lo").agg(F.count(F.lit(1)).alias("n"))
    return shards.fragments(parts).join(n, "lo", "left").select("lo", "fragment", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query("src02_shard_assignment", f", {SHARDS_SQL} SELECT lo, count(*) AS n FROM repositories JOIN shards ON stars >= lo AND (hi IS NULL OR stars <= hi) GROUP BY lo")
def _(spark, sf_dir):
    return shards.assigned(repositories(spark, sf_dir).select("stars"), shards.shard_table(spark)).groupBy("lo").agg(F.count(F.lit(1)).alias("n"))


@query("src03_pushed_since", " SELECT id FROM repositories WHERE pushed_at >= TIMESTAMP '2023-06-01 00:00:00'")
def _(spark, sf_dir):
    return filters.since(repositories(spark, sf_dir), "pushed_at", datetime(2023, 6, 1, 15, 30)).select("id")


@query("src06_finalize", r" SELECT doc_id, CASE WHEN length(c) > 0 THEN 'ok' ELSE 'empty' END AS status, sha256(CASE WHEN length(c) > 0 THEN c END) AS content FROM (SELECT doc_id, left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 8192) AS c FROM documents)", corpus=False)
def _(spark, sf_dir):
    status, content = text.finalize_readme(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", status.alias("status"), F.sha2(content, 256).alias("content"))


@query("src08_curated_lists", " SELECT id, stars FROM (SELECT *, CASE WHEN doc % 9 = 0 THEN 'awesome' ELSE 'other' END AS topic FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS doc FROM repositories)) WHERE topic = 'awesome' AND readme_status = 'ok' ORDER BY stars DESC, id LIMIT 30")
def _(spark, sf_dir):
    topic = F.when(F.substring("id", 2, 20).cast("bigint") % 9 == 0, "awesome").otherwise("other")
    return mining.curated_lists(repositories(spark, sf_dir).withColumn("topics", F.array(topic)), 30).select("id", "stars")


@query("src14_export", " SELECT full_name, length(left(readme, 1500)) AS n FROM repositories WHERE full_name IN (SELECT concat('src', item_id % 20, '/doc-', item_id) FROM benchmark)")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 20, F.lit("/doc-"), "item_id").alias("full_name"))
    out = json_sources.export_passages(repositories(spark, sf_dir), names).select(F.from_json("value", "full_name string, readme string").alias("v"))
    return out.select("v.full_name", F.length("v.readme").cast("bigint").alias("n"))


@query("src17_vectors_of_label", " SELECT repo_id, len(embedding) AS dim FROM repository_embeddings WHERE model_name = 'base' AND repo_id IN (SELECT repo_id FROM enrichment)")
def _(spark, sf_dir):
    wanted = enrichment(spark, sf_dir).select("repo_id")
    e = repository_embeddings(spark, sf_dir).where(F.col("model_name") == BASE_LABEL)
    return e.join(wanted, "repo_id", "left_semi").select("repo_id", F.size("embedding").cast("bigint").alias("dim"))


# --- writes ---------------------------------------------------------------------------------------------

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(*ORDER_COLS)
    # orders with a returned line get new values, suppliers a row of their own
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    back = o.join(returned, "o_orderkey", "left_semi").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    more = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("o_orderkey"), F.col("s_suppkey").alias("o_custkey"), F.lit("X").alias("o_orderstatus"), F.col("s_acctbal").alias("o_totalprice"))
    return o, back.unionByName(more)


UPDATES = """u AS (SELECT o_orderkey AS k, o_custkey + 1 AS c, 'X' AS s, o_totalprice + 1 AS p FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
 UNION ALL SELECT -s_suppkey, s_suppkey, 'X', s_acctbal FROM supplier)"""


@query("snk01_upsert_partial_columns", f"WITH {UPDATES} SELECT coalesce(o_orderkey, k) AS o_orderkey, coalesce(o_custkey, c) AS o_custkey, coalesce(s, o_orderstatus) AS o_orderstatus, round(coalesce(p, o_totalprice), 2) AS o_totalprice FROM orders FULL JOIN u ON o_orderkey = k", corpus=False)
def _(spark, sf_dir):
    o, u = _orders(spark, sf_dir)
    return upsert.upsert(o, u, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("snk02_update_only", f"WITH {UPDATES} SELECT o_orderkey, o_custkey, coalesce(s, o_orderstatus) AS o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders LEFT JOIN u ON o_orderkey = k", corpus=False)
def _(spark, sf_dir):
    o, u = _orders(spark, sf_dir)
    return upsert.upsert(o, u, ["o_orderkey"], ["o_orderstatus"], update_only=True).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("snk03_upsert_composite", " SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.model_name, b.model_name) AS model_name, coalesce(b.h, a.h) AS h FROM (SELECT repo_id, model_name, 'old' AS h FROM repository_embeddings) a FULL JOIN (SELECT repo_id, 'base+enrich' AS model_name, 'new' AS h FROM enrichment) b USING (repo_id, model_name)")
def _(spark, sf_dir):
    base = repository_embeddings(spark, sf_dir).select("repo_id", "model_name", F.lit("old").alias("h"))
    new = enrichment(spark, sf_dir).select("repo_id", F.lit(ENRICH_LABEL).alias("model_name"), F.lit("new").alias("h"))
    return upsert.upsert(base, new, ["repo_id", "model_name"], ["h"])


@query("snk06_two_policy_upsert", """, sc AS (SELECT id AS repo_id, CAST(NULL AS BIGINT) AS dependent_count, stars AS score FROM repositories JOIN enrichment ON repo_id = id)
 SELECT coalesce(sc.repo_id, s.repo_id) AS repo_id, s.dependent_count, sc.score FROM sc FULL JOIN signals s ON s.repo_id = sc.repo_id""")
def _(spark, sf_dir):
    base = repositories(spark, sf_dir).join(enrichment(spark, sf_dir), F.col("id") == F.col("repo_id"), "left_semi").select(F.col("id").alias("repo_id"), F.lit(None).cast("bigint").alias("dependent_count"), F.col("stars").alias("score"))
    return upsert.upsert(base, signals(spark, sf_dir), ["repo_id"], ["dependent_count"])


@query("snk08_state", " SELECT 1 AS id, max(ts) AS last_crawl FROM events", corpus=False)
def _(spark, sf_dir):
    state = spark.createDataFrame([(1, datetime(2023, 1, 1))], "id int, last_crawl timestamp_ntz")
    new = table(spark, sf_dir, "events").agg(F.max("ts").alias("last_crawl")).select(F.lit(1).alias("id"), "last_crawl")
    return upsert.upsert(state, new, ["id"], ["last_crawl"])


@query("snk09_copy_do_nothing", """ SELECT repo_id, model_name FROM repository_embeddings UNION ALL
 SELECT repo_id, 'base+enrich' FROM repository_embeddings e WHERE model_name = 'base' AND repo_id NOT IN (SELECT repo_id FROM enrichment)
  AND repo_id NOT IN (SELECT repo_id FROM repository_embeddings WHERE model_name = 'base+enrich')""")
def _(spark, sf_dir):
    e = repository_embeddings(spark, sf_dir)
    copied = e.where(F.col("model_name") == BASE_LABEL).join(enrichment(spark, sf_dir).select("repo_id"), "repo_id", "left_anti").withColumn("model_name", F.lit(ENRICH_LABEL))
    return upsert.upsert(e, copied, ["repo_id", "model_name"], [], do_nothing=True).select("repo_id", "model_name")


@query("snk10_prune", " SELECT repo_id, repo_id IN (SELECT id FROM repositories WHERE NOT is_archived) AS kept FROM enrichment")
def _(spark, sf_dir):
    alive = repositories(spark, sf_dir).where("not is_archived").select(F.col("id").alias("repo_id"))
    kept, stale = upsert.prune(enrichment(spark, sf_dir), alive, ["repo_id"])
    return kept.select("repo_id", F.lit(True).alias("kept")).unionByName(stale.select("repo_id", F.lit(False).alias("kept")))


@query("snk12_cascade", " SELECT 'orders' AS side, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10))", corpus=False)
def _(spark, sf_dir):
    alive = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("id"))
    orders = upsert.cascade({"orders": (table(spark, sf_dir, "orders"), "o_custkey")}, alive)["orders"]
    lines = upsert.cascade({"lineitem": (table(spark, sf_dir, "lineitem"), "l_orderkey")}, orders.select(F.col("o_orderkey").alias("id")))["lineitem"]
    return orders.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("side"), "n").unionByName(lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineitem").alias("side"), "n"))


@query("snk14_append_keep_first", " SELECT doc_id, arg_min(grade, o) AS grade FROM (SELECT doc_id, quality AS grade, 0 AS o FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, toxic, 1 FROM labels) GROUP BY doc_id", corpus=False)
def _(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    old = l.where("quality = 1").select("doc_id", F.col("quality").alias("grade"))
    return upsert.upsert(old, l.select("doc_id", F.col("toxic").alias("grade")), ["doc_id"], [], do_nothing=True)


@query("snk16_ledger_latest", " SELECT user_id, arg_max(event_type, ts || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS last FROM events GROUP BY user_id".replace("ts ||", "strftime(ts, '%Y%m%d%H%M%S%f') ||"), corpus=False)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("last"))
    return upsert.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "last")


# --- joins and counts -----------------------------------------------------------------------------------


@query("joi01_rrf_full", """, f AS (SELECT l_partkey AS id, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_partkey) AS rnk FROM lineitem GROUP BY 1 QUALIFY rnk <= 200),
 d AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rnk FROM part QUALIFY rnk <= 200), n AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size, p_partkey) AS rnk FROM part QUALIFY rnk <= 50)
 SELECT coalesce(f.id, d.id, n.id) AS repo_id, round(coalesce(1.0::DOUBLE / (20 + f.rnk), 0) + coalesce(1.0::DOUBLE / (20 + d.rnk), 0) + 0.5 * coalesce(1.0::DOUBLE / (20 + n.rnk), 0), 6) AS rrf
 FROM f FULL JOIN d ON d.id = f.id FULL JOIN n ON n.id = coalesce(f.id, d.id)""".replace(", f AS", "WITH f AS", 1), corpus=False)
def _(spark, sf_dir):
    def lane(df, order, k):
        # slim rows: one sorted pass for a global rank, of which k stay
        top = df.orderBy(*order).limit(k).withColumn("query_id", F.lit(0))
        return top.select("query_id", "repo_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rnk"))

    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "repo_id")
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("repo_id")).agg(F.sum("l_quantity").alias("q"))
    fused = search.rrf_fuse(lane(sold, [F.desc("q"), F.asc("repo_id")], 200), lane(part, [F.desc("p_retailprice"), F.asc("repo_id")], 200), lane(part, [F.asc("p_size"), F.asc("repo_id")], 50))
    return fused.select("repo_id", r6(F.col("rrf")).alias("rrf"))


@query("joi06_left_signals", " SELECT id, coalesce(dependent_count, 0) AS n FROM repositories LEFT JOIN signals ON repo_id = id")
def _(spark, sf_dir):
    r = repositories(spark, sf_dir).select(F.col("id").alias("repo_id"))
    return r.join(signals(spark, sf_dir), "repo_id", "left").select(F.col("repo_id").alias("id"), F.coalesce("dependent_count", F.lit(0).cast("bigint")).alias("n"))


@query("joi12_term_pairs", rf" SELECT item_id, concat(a.w, ' & ', b.w) AS pair FROM (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS ord FROM (SELECT item_id, list_slice(list_sort(list_distinct({WORDS_SQL.format('text')})), 1, 8) AS l FROM benchmark)) a JOIN (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS ord FROM (SELECT item_id, list_slice(list_sort(list_distinct({WORDS_SQL.format('text')})), 1, 8) AS l FROM benchmark)) b USING (item_id) WHERE a.ord < b.ord", corpus=False)
def _(spark, sf_dir):
    l = table(spark, sf_dir, "benchmark").select("item_id", F.slice(F.array_sort(text.words(F.col("text"))), 1, lanes.MAX_SLOTS).alias("l"))
    # at most 28 pairs of a query's eight lexemes
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.filter("l", lambda b, j: j > i), lambda b: F.concat(a, F.lit(" & "), b))))
    return l.select("item_id", F.explode(pairs).alias("pair"))


@query("joi13_lateral_unnest", rf" SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct({WORDS_SQL.format('text')})) AS word FROM conversations) GROUP BY word", corpus=False)
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("joi16_semi_lower", " SELECT id FROM repositories WHERE lower(concat('GITHUB.com/', full_name)) IN (SELECT lower(concat('github.com/', 'SRC', s_suppkey % 20, '/doc-', s_suppkey)) FROM supplier)")
def _(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select(F.lower(F.concat(F.lit("github.com/SRC"), F.col("s_suppkey") % 20, F.lit("/doc-"), "s_suppkey")).alias("key"))
    return repositories(spark, sf_dir).select("id", F.lower(F.concat(F.lit("GITHUB.com/"), "full_name")).alias("key")).join(known, "key", "left_semi").select("id")


@query("agg01_counts_filter", " SELECT count(*) AS total, count(*) FILTER (WHERE is_archived) AS archived, max(pushed_at) AS last_crawled FROM repositories")
def _(spark, sf_dir):
    return health.corpus_counts(repositories(spark, sf_dir))


@query("agg02_topn_then_agg", " SELECT count(*) FILTER (WHERE readme_status = 'ok') AS ok, count(*) FILTER (WHERE readme_status = 'not_found') AS not_found, count(*) FILTER (WHERE readme_status = 'empty') AS empty, count(*) FILTER (WHERE readme_status = 'error') AS error, count(*) FILTER (WHERE readme_status IS NULL) AS pending FROM (SELECT * FROM repositories WHERE NOT is_archived ORDER BY stars DESC, id LIMIT 300)")
def _(spark, sf_dir):
    return health.readme_outcomes(repositories(spark, sf_dir), 300)


@query("agg03_scalar_subqueries", " SELECT (SELECT count(*) FROM repositories) AS total_repos, (SELECT count(*) FROM repositories WHERE readme_status = 'ok') AS readme_success, (SELECT count(*) FROM repository_embeddings WHERE model_name = 'base') AS embeddings, (SELECT count(*) FROM repositories WHERE NOT is_archived AND readme_status IS NOT NULL AND id NOT IN (SELECT repo_id FROM repository_embeddings WHERE model_name = 'base')) AS pending")
def _(spark, sf_dir):
    return health.counters(repositories(spark, sf_dir), repository_embeddings(spark, sf_dir), BASE_LABEL)


@query("agg04_remaining", " SELECT count(*) AS remaining FROM repositories WHERE readme_status IS NULL AND NOT is_archived")
def _(spark, sf_dir):
    return repositories(spark, sf_dir).where("readme_status is null and not is_archived").agg(F.count(F.lit(1)).alias("remaining"))


@query("agg05_histogram", " SELECT readme_status, count(*) AS n FROM repositories GROUP BY readme_status")
def _(spark, sf_dir):
    return health.status_histogram(repositories(spark, sf_dir))


@query("agg06_term_fold", rf" SELECT repo_id, array_to_string(list_sort(list_distinct({WORDS_SQL.format("concat_ws(' ', array_to_string(queries, ' '), description)")})), ' ') AS terms FROM enrichment")
def _(spark, sf_dir):
    return lanes.fold_terms(enrichment(spark, sf_dir), analyze=text.words).select("repo_id", F.array_join("terms", " ").alias("terms"))


@query("agg09_ordered_fold", """, e2 AS (SELECT * FROM enrichment UNION ALL SELECT repo_id, 'awesome-mined', list_slice(queries, 1, 1), concat('mined ', repo_id) FROM enrichment)
 SELECT repo_id, array_to_string(list_filter(l, lambda x, i: NOT list_contains(list_slice(l, 1, i - 1), x)), '|') AS queries, description FROM
 (SELECT repo_id, flatten(list(queries ORDER BY source)) AS l, string_agg(description, chr(10) ORDER BY source) AS description FROM e2 GROUP BY repo_id)""")
def _(spark, sf_dir):
    e = enrichment(spark, sf_dir)
    more = e.select("repo_id", F.lit(mining.MINED).alias("source"), F.slice("queries", 1, 1).alias("queries"), F.concat(F.lit("mined "), "repo_id").alias("description"))
    return document.fold_enrichment(e.unionByName(more)).select("repo_id", F.array_join("queries", "|").alias("queries"), "description")


@query("agg10_max_by", " SELECT l_partkey AS repo_id, CAST(max(l_quantity) AS BIGINT) AS dependent_count, arg_max(concat(l_returnflag, ':', l_orderkey, ':', l_linenumber), l_quantity * 1000000000000 - (l_orderkey * 10 + l_linenumber)) AS dependent_package FROM lineitem GROUP BY l_partkey", corpus=False)
def _(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    label = F.concat("l_returnflag", F.lit(":"), "l_orderkey", F.lit(":"), "l_linenumber")
    probes = l.select(F.col("l_partkey").alias("repo_id"), label.alias("label"), F.col("l_quantity").cast("bigint").alias("n"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("probe"))
    return packages.max_dependents(probes)


@query("agg11_mean_median", " SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, count(*) AS n FROM lineitem GROUP BY l_returnflag", corpus=False)
def _(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return g.agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.median("l_extendedprice"), 4).alias("median"), F.count("l_extendedprice").alias("n"))


@query("agg12_kappa", """WITH p AS (SELECT 1 + quality AS a, 1 + toxic AS b FROM labels), s AS (SELECT count(*) AS n, avg((a = b)::INT) AS exact, avg(((a >= 2) = (b >= 2))::INT) AS ag, avg((a >= 2)::INT) AS pa, avg((b >= 2)::INT) AS pb, avg(a - b) AS bias FROM p)
 SELECT n, round(exact, 6) AS exact, round(ag, 6) AS binary_agree, round((ag - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa, round(bias, 6) AS bias FROM s""", corpus=False)
def _(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select((F.col("quality") + 1).alias("a"), (F.col("toxic") + 1).alias("b"))
    return evaluation.agreement(pairs).select("n", *[r6(F.col(c)).alias(c) for c in ("exact", "binary_agree", "kappa", "bias")])


@query("agg14_run_summary", " SELECT event_type AS status, count(*) AS shards, CAST(sum(user_id) AS BIGINT) AS inserted FROM events GROUP BY event_type", corpus=False)
def _(spark, sf_dir):
    return health.run_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.col("user_id").alias("inserted")))


@query("agg15_cost", " SELECT p_brand AS model, round(1000 * (1050 * p_size + 200 * p_size * 4) / 1000000.0, 6) AS usd FROM (SELECT DISTINCT p_brand, p_size FROM part)", corpus=False)
def _(spark, sf_dir):
    rates = table(spark, sf_dir, "part").select("p_brand", "p_size").distinct().select(F.col("p_brand").alias("model"), F.col("p_size").cast("double").alias("usd_in"), (F.col("p_size") * 4.0).alias("usd_out"))
    return health.cost_estimate(rates, 1000, 1050, 200).select("model", r6(F.col("usd")).alias("usd"))


# --- windows, sorts and sets ----------------------------------------------------------------------------


@query("win01_row_number", " SELECT primary_language, id, row_number() OVER (PARTITION BY primary_language ORDER BY stars DESC, id) AS rnk FROM repositories QUALIFY rnk <= 5")
def _(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("primary_language").orderBy(F.desc("stars"), "id"))
    return repositories(spark, sf_dir).select("primary_language", "id", rank.alias("rnk")).where("rnk <= 5").withColumn("rnk", F.col("rnk").cast("bigint"))


@query("win04_minmax_partition", " SELECT id, round(CASE WHEN mx > mn THEN (stars - mn) / (mx - mn) ELSE 1.0 END, 6) AS rel FROM (SELECT *, min(stars) OVER w AS mn, max(stars) OVER w AS mx FROM repositories WINDOW w AS (PARTITION BY primary_language))")
def _(spark, sf_dir):
    w = Window.partitionBy("primary_language")
    rows = repositories(spark, sf_dir).select("id", F.col("stars").cast("double").alias("s"), F.min("stars").over(w).alias("mn"), F.max("stars").over(w).alias("mx"))
    return rows.select("id", r6(ranking.minmax(F.col("s"), F.col("mn"), F.col("mx"))).alias("rel"))


@query("win05_geomean", " SELECT owner, round(least(20000.0, greatest(100.0, exp(avg(ln(greatest(stars, 1)))))), 6) AS pivot_value FROM repositories GROUP BY owner")
def _(spark, sf_dir):
    mean = F.avg(F.log(F.greatest(F.col("stars"), F.lit(1)).cast("double")))
    return repositories(spark, sf_dir).groupBy("owner").agg(r6(ranking.star_pivot(mean)).alias("pivot_value"))


@query("win06_ordinality", rf" SELECT item_id, w AS lexeme, ord FROM (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS ord FROM (SELECT item_id, list_sort(list_distinct({WORDS_SQL.format('text')})) AS l FROM benchmark)) WHERE ord <= 8", corpus=False)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array_sort(text.words(F.col("text")))).alias("p", "lexeme"))
    return rows.where("p < 8").select("item_id", "lexeme", (F.col("p") + 1).cast("bigint").alias("ord"))


@query("top01_topk", " SELECT id, stars FROM repositories ORDER BY stars DESC, id LIMIT 200")
def _(spark, sf_dir):
    return repositories(spark, sf_dir).select("id", "stars").orderBy(F.desc("stars"), "id").limit(200)


#: The second run has the orders with a returned line alone; orders of which no line came back or was accepted aren't judged.
RUNS = """ra AS (SELECT o_custkey AS query, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
 rb AS (SELECT o_custkey AS query, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
 qrels AS (SELECT o_custkey AS query, o_orderkey AS doc, CAST(least(3, n) AS INT) AS grade FROM orders JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag <> 'N')) ON l_orderkey = o_orderkey)"""


def _runs(spark, sf_dir):
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    rank = lambda *by: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*by))
    shape = lambda df, r: df.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), r.alias("rank"))
    a = shape(o, rank(F.desc("o_totalprice"), F.asc("o_orderkey")))
    b = shape(o.join(lines.where("l_returnflag = 'R'"), "o_orderkey", "left_semi"), rank(F.asc("o_orderdate"), F.asc("o_orderkey")))
    judged = lines.groupBy("o_orderkey").agg(F.least(F.lit(3), F.count_if(F.col("l_returnflag") == "R")).cast("int").alias("grade"), F.bool_or(F.col("l_returnflag") != "N").alias("judged"))
    qrels = o.join(judged.where("judged"), "o_orderkey").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), "grade")
    return a, b, qrels


@query("top06_pool", f"WITH {RUNS} SELECT query, doc FROM ra WHERE rank <= 3 UNION SELECT query, doc FROM rb WHERE rank <= 3", corpus=False)
def _(spark, sf_dir):
    a, b, _ = _runs(spark, sf_dir)
    return evaluation.pool([a, b], 3)


@query("set01_union_all_disjoint", " SELECT id, 'own' AS arm FROM repositories WHERE stars > 900 UNION ALL SELECT r.id, 'enriched' FROM repositories r JOIN enrichment e ON e.repo_id = r.id WHERE NOT stars > 900")
def _(spark, sf_dir):
    r = repositories(spark, sf_dir).select("id", "stars")
    own = r.where("stars > 900").select("id", F.lit("own").alias("arm"))
    rest = r.where("not stars > 900").join(enrichment(spark, sf_dir).select(F.col("repo_id").alias("id")), "id").select("id", F.lit("enriched").alias("arm"))
    return own.unionByName(rest)


@query("set02_unjudged", f"WITH {RUNS} SELECT query, doc FROM (SELECT query, doc FROM ra WHERE rank <= 3 UNION SELECT query, doc FROM rb WHERE rank <= 3) WHERE (query, doc) NOT IN (SELECT (query, doc) FROM qrels)", corpus=False)
def _(spark, sf_dir):
    a, b, qrels = _runs(spark, sf_dir)
    return evaluation.unjudged(evaluation.pool([a, b], 3), qrels)


@query("set04_missed", f"WITH {RUNS} SELECT query, array_to_string(list_slice(list_sort(list(doc)), 1, 3), ',') AS missed FROM qrels WHERE grade >= 2 AND (query, doc) NOT IN (SELECT (query, doc) FROM rb WHERE rank <= 3) GROUP BY query", corpus=False)
def _(spark, sf_dir):
    _, b, qrels = _runs(spark, sf_dir)
    missed = qrels.where("grade >= 2").join(b.where("rank <= 3"), ["query", "doc"], "left_anti")
    return missed.groupBy("query").agg(F.array_join(F.slice(F.array_sort(F.collect_list("doc")), 1, 3).cast("array<string>"), ",").alias("missed"))


# --- texts ----------------------------------------------------------------------------------------------

BUILT = r"""left(concat(full_name, ': ', description, chr(10), 'Language: ', primary_language, chr(10), 'Topics: ', array_to_string(topics, ', '),
 CASE WHEN len(queries) > 0 THEN concat(chr(10), 'Common queries: ', array_to_string(queries, '; ')) ELSE '' END,
 CASE WHEN e.description <> '' THEN concat(chr(10), left(e.description, 600)) ELSE '' END, chr(10), chr(10), readme), 2500)"""
BUILT = BUILT.replace("': ', description,", "': ', r.description,")


@query("doc01_build_text", f" SELECT id, sha256({BUILT}) AS digest, length({BUILT}) AS n FROM repositories r LEFT JOIN enrichment e ON e.repo_id = id")
def _(spark, sf_dir):
    e = enrichment(spark, sf_dir).select(F.col("repo_id").alias("id"), "queries", F.col("description").alias("enrichment_description"))
    r = repositories(spark, sf_dir).join(e, "id", "left")
    built = r.withColumn("t", document.build_text(set(r.columns)))
    return built.select("id", document.source_hash(F.col("t")).alias("digest"), F.length("t").cast("bigint").alias("n"))


@query("doc02_sha256", " SELECT doc_id, sha256(text) AS digest FROM documents", corpus=False)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", document.source_hash(F.col("text")).alias("digest"))


@query("doc03_changed", " SELECT doc_id FROM documents WHERE sha256(text) <> sha256(left(text, 5000))", corpus=False)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stored = d.select("doc_id", document.source_hash(F.left("text", F.lit(5000))).alias("was"))
    return d.join(stored, "doc_id").where(document.source_hash(F.col("text")) != F.col("was")).select("doc_id")


@query("doc06_judge_passage", " SELECT id, sha256(concat('Repository: ', full_name, chr(10), 'Description: ', description, chr(10), 'Language: ', primary_language, chr(10), 'Topics: ', array_to_string(topics, ', '), chr(10), 'README: ', left(readme, 1500))) AS digest FROM repositories")
def _(spark, sf_dir):
    return repositories(spark, sf_dir).select("id", F.sha2(document.judge_passage(), 256).alias("digest"))


@query("doc07_grade_regex", " SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(event_id % 5 AS INT) END AS grade FROM events", corpus=False)
def _(spark, sf_dir):
    said = F.concat(F.lit("Reason. Final Score:  "), F.col("event_id") % 5)
    return table(spark, sf_dir, "events").select("event_id", text.grade(said).alias("grade"))


@query("doc09_shown_file", " SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN length(text) > 2000 THEN 2012 ELSE length(text) END AS n FROM documents", corpus=False)
def _(spark, sf_dir):
    content = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("a\0b"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(document.shown_file(content, 2000)).cast("bigint").alias("n"))


STRIP = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\(\s*[^)]*\)', '\1', 'g'), '\[([^\]]*)\]\[[^\]]*\]', '\1', 'g'), '`([^`]*)`', '\1', 'g'), '<[^>\n]{{1,120}}>', ' ', 'g'), '\*{{1,3}}|_{{2,3}}', '', 'g'), '\s+', ' ', 'g'))"""


@query("min03_strip_markdown", f" SELECT page_id, sha256({STRIP.format('html')}) AS digest FROM pages", corpus=False)
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_markdown(F.col("html")), 256).alias("digest"))


@query("min09_alias_quorum", " SELECT p_name AS alias, count(DISTINCT p_brand) AS n_lists, count(*) AS votes FROM part GROUP BY p_name HAVING (n_lists < 4 OR votes >= 33) AND regexp_matches(p_name, '^[A-Za-z0-9][A-Za-z0-9 .+#/&''_-]*$')", corpus=False)
def _(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("alias")).agg(F.countDistinct("p_brand").alias("n_lists"), F.count(F.lit(1)).alias("votes"))
    return g.where(mining.alias_kept(F.col("alias"), F.floor(F.col("votes") / 33) + 1, F.col("n_lists")))


@query("min10_top_categories", " SELECT p_brand AS target, p_type AS category, count(*) AS votes FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) <= 24", corpus=False)
def _(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("target"), F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("votes"))
    nth = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("votes"), "category"))
    return g.withColumn("nth", nth).where(F.col("nth") <= mining.MAX_CATEGORIES).drop("nth")


@query("min11_norm_key", r" SELECT doc_id, sha256(regexp_replace(lower(text), '[\s\-._]+', '', 'g')) AS k FROM documents", corpus=False)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.norm_key(F.col("text")), 256).alias("k"))


@query("doc08_preamble", " SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('## What it is', text) ELSE text END AS guide FROM documents", corpus=False)
def _(spark, sf_dir):
    said = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("## What it is"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", document.trim_preamble(said).alias("guide"))


@query("doc04_sane_strings", r""" SELECT conv_id, array_to_string(list_slice(list_filter(l, lambda x, i: NOT list_contains(list_transform(list_slice(l, 1, i - 1), lambda y: lower(y)), lower(x))), 1, 8), '|') AS kept FROM
 (SELECT conv_id, list_filter(list_transform(list(text ORDER BY turn), lambda t: regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '' AND length(x) <= 80) AS l FROM conversations GROUP BY conv_id)""", corpus=False)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))).alias("l"))
    return c.select("conv_id", F.array_join(text.sane_strings(F.transform("l", lambda x: x["t"]), 8, 80), "|").alias("kept"))


@query("snk15_batch_prompts", " SELECT CAST((rn - 1) // 150 AS BIGINT) AS chunk, concat('r', (rn - 1) % 150) AS key, sha256(text) AS prompt FROM (SELECT text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)", corpus=False)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("repo_id"), F.col("text").alias("prompt"))
    line = F.from_json("value", "key string, prompt string")
    return json_sources.batch_requests(rows, "doc_id", 150)[0].select("chunk", line["key"].alias("key"), F.sha2(line["prompt"], 256).alias("prompt"))


# --- packages -------------------------------------------------------------------------------------------


#: Some packages are named like their record but for marks.
PACKAGE = "CASE WHEN p_size > 40 THEN concat(lower(p_type), '/', p_name, '-', replace(p_brand, '#', '++')) ELSE p_name END"


@query("pkg01_select", f"""WITH c AS (SELECT DISTINCT p_brand AS repo_name, p_type AS system, {PACKAGE} AS name, regexp_replace(lower(list_extract(string_split({PACKAGE}, '/'), -1)), '[^a-z0-9]+', '', 'g') AS n, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS r FROM part WHERE p_size > 10)
 SELECT repo_name, system, name, row_number() OVER (PARTITION BY repo_name ORDER BY NOT (ends_with(n, r) OR ends_with(r, n)), length(name), system, name) AS rnk FROM c QUALIFY rnk <= 3""", corpus=False)
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("repo_name"), F.col("p_type").alias("system"), F.expr(PACKAGE).alias("name"), F.when(F.col("p_size") > 10, "SOURCE_REPO").otherwise("ISSUE_TRACKER").alias("relation_type"))
    return packages.select_packages(rows).select("repo_name", "system", "name", F.col("rnk").cast("bigint").alias("rnk"))


VERSIONS = """v AS (SELECT l_partkey AS package, l_orderkey * 10 + l_linenumber AS place, concat('v', l_orderkey, '.', l_linenumber) AS version, strftime(l_shipdate, '%Y-%m-%d') AS published, l_orderkey % 13 = 0 AS is_default FROM lineitem),
 s AS (SELECT package, list(version ORDER BY published DESC, place) AS names, arg_min(version, place) FILTER (WHERE is_default) AS dv FROM v GROUP BY package)"""


def _versions(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    one = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.concat(F.lit("v"), "l_orderkey", F.lit("."), "l_linenumber").alias("version"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("published_at"), (F.col("l_orderkey") % 13 == 0).alias("is_default"))
    return l.groupBy(F.col("l_partkey").alias("package")).agg(F.array_sort(F.collect_list(one)).alias("versions"))


@query("pkg02_default", f"WITH {VERSIONS} SELECT package, dv AS version FROM s", corpus=False)
def _(spark, sf_dir):
    return _versions(spark, sf_dir).select("package", packages.default_version(F.col("versions")).alias("version"))


@query("pkg03_sample", f"""WITH {VERSIONS}, x AS (SELECT package, list_filter([dv, names[1], names[2], names[3], names[len(names) // 4 + 1], names[len(names) // 2 + 1], names[3 * len(names) // 4 + 1]], lambda x: x IS NOT NULL) AS l FROM s)
 SELECT package, array_to_string(list_slice(list_filter(l, lambda a, i: NOT list_contains(list_slice(l, 1, i - 1), a)), 1, 6), ',') AS versions FROM x""", corpus=False)
def _(spark, sf_dir):
    return _versions(spark, sf_dir).select("package", F.array_join(packages.sample_versions(F.col("versions")), ",").alias("versions"))


# --- ranking expressions --------------------------------------------------------------------------------


@query("rnk04_stars_sat", " SELECT id, round(stars / (stars + 1234.5), 6) AS sat FROM repositories")
def _(spark, sf_dir):
    return repositories(spark, sf_dir).select("id", r6(ranking.saturate(F.col("stars"), F.lit(1234.5))).alias("sat"))


@query("rnk05_criticality", " SELECT id, round(coalesce(dependent_count, 0) / (coalesce(dependent_count, 0) + 1000.0), 6) AS sat FROM repositories LEFT JOIN signals ON repo_id = id")
def _(spark, sf_dir):
    r = repositories(spark, sf_dir).select("id", F.col("id").alias("repo_id")).join(signals(spark, sf_dir), "repo_id", "left")
    return r.select("id", r6(ranking.saturate(F.col("dependent_count"), F.lit(ranking.DEPENDENTS_PIVOT))).alias("sat"))


@query("rnk06_recency", " SELECT id, round(CASE WHEN is_fork THEN 0.0 ELSE 0.25 + 0.75 * exp(-greatest(0.0, (epoch_us(TIMESTAMP '2023-06-01') - epoch_us(pushed_at)) / 86400000000.0) * ln(2.0::DOUBLE) / 180.0) END, 6) AS recency FROM repositories")
def _(spark, sf_dir):
    pushed = F.when(~F.col("is_fork"), F.col("pushed_at"))
    return repositories(spark, sf_dir).select("id", r6(ranking.recency(pushed, datetime(2023, 6, 1), 180.0)).alias("recency"))


@query("rnk07_demotion", " SELECT id, CAST(CASE WHEN is_archived THEN 0.5 WHEN is_fork THEN 0.8 ELSE 1.0 END AS DOUBLE) AS factor FROM repositories")
def _(spark, sf_dir):
    return repositories(spark, sf_dir).select("id", ranking.demotion(F.col("is_archived"), F.col("is_fork")).alias("factor"))


@query("rnk12_bar_share", " SELECT o_orderkey, round(CASE WHEN o_totalprice > 1000 THEN 300 / o_totalprice ELSE 0 END, 6) AS share FROM orders", corpus=False)
def _(spark, sf_dir):
    total = F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).otherwise(0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(ranking.bar_share(F.lit(300.0), total)).alias("share"))


@query("rnk13_formats", " SELECT id, CASE WHEN stars >= 1000 THEN concat(stars // 1000, '.', (stars // 100) % 10, 'k') ELSE CAST(stars AS VARCHAR) END AS shown FROM repositories")
def _(spark, sf_dir):
    return repositories(spark, sf_dir).select("id", ranking.short_count(F.col("stars")).alias("shown"))


# --- metrics and health ---------------------------------------------------------------------------------


@query("evl01_ndcg", f"""WITH {RUNS}, d AS (SELECT r.query, sum(coalesce(grade, 0) / log2(rank + 1)) AS dcg FROM ra r LEFT JOIN qrels USING (query, doc) WHERE rank <= 10 GROUP BY r.query),
 i AS (SELECT query, sum(grade / log2(rn + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS rn FROM qrels) WHERE rn <= 10 GROUP BY query)
 SELECT query, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END, 6) AS ndcg FROM d LEFT JOIN i USING (query)""", corpus=False)
def _(spark, sf_dir):
    a, _, qrels = _runs(spark, sf_dir)
    return evaluation.ndcg(a, qrels, 10).select("query", r6(F.col("ndcg")).alias("ndcg"))


@query("evl02_recall", f"WITH {RUNS} SELECT a.query, round(x.found / x.n, 6) AS recall FROM (SELECT DISTINCT query FROM ra) a LEFT JOIN (SELECT q.query, count(*) AS n, count(r.doc) AS found FROM qrels q LEFT JOIN (SELECT * FROM ra WHERE rank <= 3) r USING (query, doc) WHERE grade >= 2 GROUP BY q.query) x USING (query)", corpus=False)
def _(spark, sf_dir):
    a, _, qrels = _runs(spark, sf_dir)
    return evaluation.recall(a, qrels, 3).select("query", r6(F.col("recall")).alias("recall"))


@query("evl03_judged", f"WITH {RUNS} SELECT a.query, round(avg((q.doc IS NOT NULL)::INT), 6) AS judged FROM ra a LEFT JOIN qrels q USING (query, doc) WHERE rank <= 10 GROUP BY a.query", corpus=False)
def _(spark, sf_dir):
    a, _, qrels = _runs(spark, sf_dir)
    return evaluation.judged(a, qrels, 10).select("query", r6(F.col("judged")).alias("judged"))


@query("evl04_canary", f"WITH {RUNS} SELECT q.query, round(count(r.doc) / count(*), 6) AS canary FROM qrels q LEFT JOIN (SELECT * FROM rb WHERE rank <= 3) r USING (query, doc) WHERE grade = 3 GROUP BY q.query", corpus=False)
def _(spark, sf_dir):
    _, b, qrels = _runs(spark, sf_dir)
    return evaluation.canary_recall(b, qrels.where("grade = 3").select("query", "doc"), 3).select("query", r6(F.col("canary")).alias("canary"))


@query("evl05_binary", f"""WITH {RUNS}, rel AS (SELECT query, doc FROM qrels WHERE grade = 1), s AS (SELECT query, count(*) AS n FROM rel GROUP BY query),
 h AS (SELECT a.query, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg FROM ra a JOIN rel USING (query, doc) WHERE rank <= 5 GROUP BY a.query)
 SELECT query, round(CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(h, 0) / n END, 6) AS recall, round(CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg
 FROM (SELECT DISTINCT query FROM ra) LEFT JOIN s USING (query) LEFT JOIN h USING (query)""", corpus=False)
def _(spark, sf_dir):
    a, _, qrels = _runs(spark, sf_dir)
    return evaluation.binary(a, qrels.where("grade = 1"), 5).select("query", r6(F.col("recall")).alias("recall"), r6(F.col("ndcg")).alias("ndcg"))


@query("evl07_compare_deltas", f"""WITH {RUNS}, i AS (SELECT query, sum(grade / log2(rn + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS rn FROM qrels) WHERE rn <= 10 GROUP BY query),
 x AS (SELECT 'a' AS s, * FROM ra UNION ALL SELECT 'b', * FROM rb), d AS (SELECT s, x.query, sum(coalesce(grade, 0) / log2(rank + 1)) AS dcg FROM x LEFT JOIN qrels USING (query, doc) WHERE rank <= 10 GROUP BY s, x.query),
 n AS (SELECT s, query, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS v FROM d LEFT JOIN i USING (query)) SELECT query, round(b.v - a.v, 6) AS delta FROM n a JOIN n b USING (query) WHERE a.s = 'a' AND b.s = 'b'""", corpus=False)
def _(spark, sf_dir):
    a, b, qrels = _runs(spark, sf_dir)
    both = evaluation.ndcg(a, qrels, 10).withColumnRenamed("ndcg", "na").join(evaluation.ndcg(b, qrels, 10), "query")
    return both.select("query", F.round(F.col("ndcg") - F.col("na"), 6).alias("delta"))


@query("evl09_missing_grade", f"WITH {RUNS} SELECT query, doc, 0 AS grade FROM ra WHERE rank <= 2 AND (query, doc) NOT IN (SELECT (query, doc) FROM qrels)", corpus=False)
def _(spark, sf_dir):
    a, _, qrels = _runs(spark, sf_dir)
    return evaluation.unjudged(evaluation.pool([a], 2), qrels).withColumn("grade", F.lit(0))


@query("evl11_regression", """, c AS (SELECT count(*) AS total_repos, count(*) FILTER (WHERE NOT is_fork) AS originals, count(*) FILTER (WHERE stars > 400) AS starred FROM repositories), p AS (SELECT count(*) AS total_repos, count(*) AS originals, 0 AS starred FROM repositories),
 u AS (SELECT 'total_repos' AS metric, p.total_repos AS previous, c.total_repos AS current FROM c, p UNION ALL SELECT 'originals', p.originals, c.originals FROM c, p UNION ALL SELECT 'starred', p.starred, c.starred FROM c, p)
 SELECT metric, CAST(previous AS BIGINT) AS previous, current, coalesce(previous > 0 AND current / previous < 0.95, false) AS failed FROM u""")
def _(spark, sf_dir):
    r = repositories(spark, sf_dir)
    current = r.agg(F.count(F.lit(1)).alias("total_repos"), F.count_if(~F.col("is_fork")).alias("originals"), F.count_if(F.col("stars") > 400).alias("starred"))
    previous = r.agg(F.count(F.lit(1)).alias("total_repos"), F.count(F.lit(1)).alias("originals"), F.lit(0).cast("bigint").alias("starred"))
    return health.regression(current, previous)


@query("evl12_progress", " SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS status FROM repositories WHERE readme_status IS NULL AND NOT is_archived")
def _(spark, sf_dir):
    rest = repositories(spark, sf_dir).where("readme_status is null and not is_archived").agg(F.count(F.lit(1)).alias("n"))
    return rest.select(F.when(F.col("n") == 0, 1).otherwise(0).alias("status"))


# --- increments -----------------------------------------------------------------------------------------


@query("inc01_since_watermark", " SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'", corpus=False)
def _(spark, sf_dir):
    return filters.since(table(spark, sf_dir, "events"), "ts", datetime(2024, 1, 20, 9, 0)).select("event_id")


@query("inc03_latest_per_key", " SELECT user_id, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", corpus=False)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return upsert.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", r6(F.col("value")).alias("value"))


__all__ = ["NOW"]
