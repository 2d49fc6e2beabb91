"""Queries over the positional index: stored documents, web-style requests in batches, lanes that read what they need.

Requests are made of the words of benchmark items: phrases, alternatives and negations by turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import positional
from corvane.plans.catalog import ALIVE, FTS_LANE, WORDS_SQL, _alive, _fts_sql, query, requests
from corvane.scratch import scratch_path, scratch_scope
from corvane.sources.adapters import enrichment, repositories, table

_INDEXES: dict[tuple[str, str], positional.PositionalIndex] = {}


def web_index(spark, sf_dir) -> positional.PositionalIndex:
    """The stored positional index of all records and their enrichment, by the plain analyzer; built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = scratch_path(spark, "positional")
        with scratch_scope(spark):
            _INDEXES[key] = positional.build_index(repositories(spark, sf_dir), path, enrichment(spark, sf_dir), positional.PLAIN)
    return _INDEXES[key]


WORDS_OF_ITEM = f"list_filter({WORDS_SQL.format('text')}, lambda x: x <> 'or')"
SHAPES = [
    "concat('\"', w[1], ' ', w[2], '\" ', w[3])", "concat(w[1], ' ', w[2], ' OR \"', w[3], ' ', w[4], '\"')", "concat(w[1], ' -', w[2])",
    "concat('-', w[1], ' -', w[2])", "concat(w[1], ' -\"', w[2], ' ', w[3], '\" or ', w[4], ' ', w[5])",
]
#: Words that are slots: with the plain analyzer OR is one too.
USED = ["w[1:3]", "list_append(w[1:4], 'or')", "w[1:2]", "w[1:2]", "list_append(w[1:5], 'or')"]


def _has(words: str) -> str:
    return f"contains(t, concat(' ', {words}, ' '))"


def _pair(a: int) -> str:
    return f"concat(w[{a}], ' ', w[{a + 1}])"


TREES = [
    f"{_has(_pair(1))} AND {_has('w[3]')}", f"({_has('w[1]')} AND {_has('w[2]')}) OR {_has(_pair(3))}", f"{_has('w[1]')} AND NOT {_has('w[2]')}",
    f"NOT {_has('w[1]')} AND NOT {_has('w[2]')}", f"({_has('w[1]')} AND NOT {_has(_pair(2))}) OR ({_has('w[4]')} AND {_has('w[5]')})",
]


def _by_shape(parts: list[str]) -> str:
    return "CASE item_id % 5 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"


SEQUENCE = f"{WORDS_SQL.format('{0}')}"
FULL = "concat_ws(' ', translate(full_name, '/_', '  '), array_to_string(topics, ' '), primary_language, r.description, left(readme, 2500))"
LIGHT = "concat_ws(' ', translate(full_name, '/_', '  '), array_to_string(topics, ' '), primary_language, r.description)"
WEB = f""", items AS (SELECT item_id, w, list_sort(list_distinct({_by_shape(USED)}))[1:8] AS slot FROM (SELECT item_id, {WORDS_OF_ITEM} AS w FROM benchmark)),
 docs AS (SELECT id, stars, is_archived, {WORDS_SQL.format(LIGHT)} AS light, concat(' ', array_to_string({WORDS_SQL.format(FULL)}, ' '), ' ') AS own, e.repo_id IS NOT NULL AS enriched,
   concat(' ', array_to_string({WORDS_SQL.format("concat_ws(' ', array_to_string(e.queries, ' '), e.description)")}, ' '), ' ') AS extra FROM repositories r LEFT JOIN enrichment e ON e.repo_id = r.id),
 pair AS (SELECT item_id AS query_id, id AS repo_id, stars, is_archived, slot, CAST(len(list_intersect(slot, light)) AS BIGINT) AS hits, {_by_shape(TREES).replace('contains(t,', 'contains(own,')} AS whole,
   enriched AND ({_by_shape(TREES).replace('contains(t,', 'contains(extra,')}) AS in_extra,
   CAST(len(list_filter(slot, lambda x: contains(extra, concat(' ', x, ' ')) AND NOT list_contains(light, x))) AS BIGINT) AS more FROM items, docs),
 hit AS (SELECT *, hits >= least(2, len(slot)) OR whole AS member FROM pair) """


def web_requests(spark, sf_dir):
    """query_id and a web-style query of each benchmark item."""
    w = F.filter(text.sequence(F.col("text")), lambda x: x != "or")
    rows = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))
    shapes = F.expr(_by_shape([s.replace("[", "[-1 + ") for s in SHAPES]))
    return rows.select(F.col("item_id").alias("query_id"), shapes.alias("query"))


def _stored(segments: list[str], where: str) -> str:
    parts = ", ".join(f"list_transform({WORDS_SQL.format(s)}, lambda x: concat('{c}', x))" for c, s in segments)
    return f""", d AS (SELECT id, flatten([{parts}]) AS w FROM {where}), p AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d)
 SELECT id AS repo_id, x[2:] AS lexeme, string_agg(x[1], '' ORDER BY pos) AS weights, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM p GROUP BY ALL"""


def _documents(spark, sf_dir, kind: int, light: bool = False):
    rows = positional.positions(web_index(spark, sf_dir), kind, light)
    return rows.select("repo_id", "lexeme", "weights", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


OWN_SEGMENTS = [("A", "coalesce(translate(full_name, '/_', '  '), '')"), ("B", "concat_ws(' ', array_to_string(topics, ' '), primary_language)"), ("C", "coalesce(description, '')"), ("D", "coalesce(left(readme, 2500), '')")]


@query("fts02_weighted_positions", _stored(OWN_SEGMENTS, "repositories"))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, positional.OWN)


@query("fts03_light_lexemes", _stored(OWN_SEGMENTS[:3], "repositories"))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, positional.OWN, light=True)


@query("fts04_enrichment_positions", _stored([("A", "''"), ("B", "array_to_string(queries, ' ')"), ("C", "coalesce(description, '')")], "(SELECT repo_id AS id, queries, enrichment.description FROM enrichment JOIN repositories ON id = repo_id)"))
def _(spark, sf_dir):
    return _documents(spark, sf_dir, positional.ENRICHED)


@query("fts06_websearch_batch", WEB + "SELECT query_id, repo_id, hits AS coverage, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, stars DESC, repo_id) AS rnk FROM hit WHERE member AND NOT is_archived QUALIFY rnk <= 200")
def _(spark, sf_dir):
    found = positional.lane(web_index(spark, sf_dir), web_requests(spark, sf_dir), corpus=_alive(spark, sf_dir))
    return found.select("query_id", "repo_id", "coverage", F.col("rnk").cast("bigint").alias("rnk"))


@query("fts06_websearch_enriched", WEB + "SELECT query_id, repo_id, hits + least(1, more) AS coverage, row_number() OVER (PARTITION BY query_id ORDER BY hits + least(1, more) DESC, stars DESC, repo_id) AS rnk FROM hit WHERE (member OR in_extra) AND NOT is_archived QUALIFY rnk <= 200")
def _(spark, sf_dir):
    found = positional.lane(web_index(spark, sf_dir), web_requests(spark, sf_dir), corpus=_alive(spark, sf_dir), enrich=True)
    return found.select("query_id", "repo_id", "coverage", F.col("rnk").cast("bigint").alias("rnk"))


@query("fts10_websearch_whole_text", WEB + "SELECT query_id, repo_id FROM hit WHERE whole AND hits < least(2, len(slot))")
def _(spark, sf_dir):
    asked = web_requests(spark, sf_dir)
    slots = asked.select("query_id", F.least(F.lit(2), F.size(text.words(F.col("query")))).alias("least"))
    found = positional.matches(web_index(spark, sf_dir), asked).join(slots, "query_id")
    return found.where("member and coverage < least").select("query_id", "repo_id")


@query("fts13_websearch_enrichment_only", WEB + "SELECT query_id, repo_id FROM hit WHERE in_extra AND NOT member")
def _(spark, sf_dir):
    return positional.matches(web_index(spark, sf_dir), web_requests(spark, sf_dir), enrich=True).where("not member").select("query_id", "repo_id")


@query("fts14_bounded_lane", _fts_sql(ALIVE, FTS_LANE.format(cov="CAST(own AS BIGINT)", cond="member")))
def _(spark, sf_dir):
    asked = requests(spark, sf_dir).select("query_id", F.translate("query", "-", " ").alias("query"))
    lane = positional.lane(web_index(spark, sf_dir), asked, corpus=_alive(spark, sf_dir))
    return lane.select("query_id", "repo_id", "coverage", F.col("rnk").cast("bigint").alias("rnk"))
