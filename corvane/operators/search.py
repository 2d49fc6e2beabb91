"""Fusion, blending and the whole search over a batch of requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import ranking
from corvane.functions.analyze import english_words
from corvane.functions.ranking import LaneWeights, ScoringWeights
from corvane.functions.text import norm_name
from corvane.functions.vectors import cosine
from corvane.operators import lanes, positional, vector_graph
from corvane.operators.filters import SearchFilters, apply_filters
from corvane.scratch import materialize


def rrf_fuse(fts: DataFrame, dense: DataFrame, name: DataFrame, weights: LaneWeights = LaneWeights()) -> DataFrame:
    """query_id, repo_id, rrf: one shuffle over the union of the lanes."""
    rows = None
    for lane, df in (("fts", fts), ("dense", dense), ("name", name)):
        part = df.select("query_id", "repo_id", F.lit(lane).alias("lane"), "rnk")
        rows = part if rows is None else rows.unionByName(part)
    rank = lambda lane: F.max(F.when(F.col("lane") == lane, F.col("rnk"))).alias(lane)
    fused = rows.groupBy("query_id", "repo_id").agg(rank("fts"), rank("dense"), rank("name"))
    return fused.select("query_id", "repo_id", ranking.rrf(F.col("fts"), F.col("dense"), F.col("name"), weights).alias("rrf"))


def exact_flag(normalised: bool = False) -> Column:
    """Whether a record's name or full name is the query ``q`` (lower case), or (``normalised``) is without its marks; never null."""
    exact = (F.lower("full_name") == F.col("q")) | (F.lower("name") == F.col("q"))
    if normalised:
        nq = F.when(~F.col("q").rlike(r"\s"), norm_name(F.col("q")))
        exact = exact | ((nq != "") & ((norm_name(F.col("full_name")) == nq) | (norm_name(F.col("name")) == nq)))
    return F.coalesce(exact, F.lit(False))


def first_page(hits: DataFrame, limit: int) -> DataFrame:
    """Each request's hits with rank up to ``limit``: exact names first, then the blended score, stars and id."""
    rank = Window.partitionBy("query_id").orderBy(F.desc("exact_name"), F.desc(F.round("hybrid_score", 9)), F.desc("stars"), F.asc("repo_id"))
    return hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit)


def blend(
    fused: DataFrame,
    corpus: DataFrame,
    queries: DataFrame,
    now: datetime,
    weights: ScoringWeights = ScoringWeights(),
    signals: DataFrame | None = None,
    normalised: bool = False,
) -> DataFrame:
    """The fused candidates with exact_name, the four contributions and hybrid_score."""
    wide = corpus.select(F.col("id").alias("repo_id"), "full_name", "name", "stars", "pushed_at", "is_archived", "is_fork")
    rows = fused.join(wide, "repo_id").join(queries.select("query_id", F.lower(F.trim("query")).alias("q")), "query_id")
    if signals is None:
        rows = rows.withColumn("dependent_count", F.lit(None).cast("bigint"))
    else:
        rows = rows.join(signals.select("repo_id", "dependent_count"), "repo_id", "left")
    every = Window.partitionBy("query_id")
    rows = rows.withColumns(
        {
            "mn": F.min("rrf").over(every),
            "mx": F.max("rrf").over(every),
            "pivot": ranking.star_pivot(F.avg(F.log(F.greatest(F.col("stars"), F.lit(1)).cast("double"))).over(every)),
        }
    )
    demote = ranking.demotion(F.col("is_archived"), F.col("is_fork"))
    parts = {
        "similarity_contribution": F.lit(float(weights.similarity)) * ranking.minmax(F.col("rrf"), F.col("mn"), F.col("mx")),
        "stars_contribution": F.lit(float(weights.stars)) * ranking.saturate(F.col("stars"), F.col("pivot")),
        "recency_contribution": F.lit(float(weights.recency)) * ranking.recency(F.col("pushed_at"), now, weights.half_life_days),
        "criticality_contribution": F.lit(float(weights.criticality)) * ranking.saturate(F.col("dependent_count"), F.lit(ranking.DEPENDENTS_PIVOT)),
    }
    total = None
    for c in parts.values():
        total = c if total is None else total + c
    return rows.select(
        "query_id", "repo_id", "full_name", "stars", "pushed_at", "rrf", exact_flag(normalised).alias("exact_name"),
        *[(demote * c).alias(k) for k, c in parts.items()], (demote * total).alias("hybrid_score"),
    )


def search(
    corpus: DataFrame,
    embeddings: DataFrame,
    queries: DataFrame,
    now: datetime,
    flt: SearchFilters = SearchFilters(),
    lane_weights: LaneWeights = LaneWeights(),
    weights: ScoringWeights = ScoringWeights(),
    limit: int = 10,
    terms: DataFrame | None = None,
    signals: DataFrame | None = None,
    enrich: bool = False,
    analyze: lanes.Analyzer = english_words,
    index: lanes.SearchIndex | None = None,
    web: positional.PositionalIndex | None = None,
    graph: vector_graph.VectorGraph | None = None,
) -> DataFrame:
    """Ranked hits of each request: exact names first, then the blended score, stars and id.

    ``enrich`` off leaves out enrichment terms, signals and normalised names. Filters act once, before the lanes. ``index`` is the
    stored one of the whole corpus (``lanes.build_index``); without it the corpus is analysed for the batch. ``terms`` must be
    folded by the same analyzer. With ``web``, a positional index of the whole corpus and its enrichment, requests are web-style in the
    lexical lane: phrases, OR and -negation count, and enrichment terms come from the index. With ``graph`` the dense lane walks the stored graph index instead of
    comparing all vectors."""
    blank = queries.where(F.trim(F.coalesce("query", F.lit(""))) == "")
    queries = queries.join(blank.select("query_id"), "query_id", "left_anti")
    filtered = apply_filters(corpus, flt)
    if web:
        fts = positional.lane(web, queries, corpus=filtered, enrich=enrich)
    else:
        fts = lanes.fulltext(filtered, queries, terms=terms if enrich else None, analyze=analyze, index=index)
    dense = vector_graph.dense_by_graph(graph, queries, alive=filtered) if graph else lanes.dense(embeddings, queries, alive=filtered)
    name = lanes.name_match(filtered, queries, normalised=enrich, index=index)
    fused = rrf_fuse(fts, dense, name, lane_weights)
    hits = blend(fused, corpus, queries, now, weights, signals if enrich else None, enrich)
    # raw cosine for the page alone: a written table of at most ``limit`` rows a request, read twice
    page = materialize(first_page(hits, limit), "page")
    vectors = embeddings.join(page.select("repo_id").distinct(), "repo_id", "left_semi").select("repo_id", "embedding")
    shown = page.join(queries.select("query_id", "vector"), "query_id").join(vectors, "repo_id", "left")
    return shown.withColumn("similarity", F.coalesce(cosine(F.col("embedding"), F.col("vector")), F.lit(0.0))).drop("embedding", "vector")


def run_of(hits: DataFrame) -> DataFrame:
    """query, doc, rank of a search's pages, as runs are evaluated; a batch of requests is one search."""
    return hits.select(F.col("query_id").alias("query"), F.col("repo_id").alias("doc"), "rank")
