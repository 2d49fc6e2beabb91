"""Counts of a corpus, remaining work and regressions against an earlier state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
REGRESSION_RATIO = 0.95


def corpus_counts(repos: DataFrame, crawled_at: str = "pushed_at") -> DataFrame:
    return repos.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_archived").alias("archived"), F.max(crawled_at).alias("last_crawled")
    )


def readme_outcomes(repos: DataFrame, top_n: int) -> DataFrame:
    """Outcome counts over the ``top_n`` records by stars."""
    top = repos.where("not is_archived").orderBy(F.desc("stars"), "id").limit(top_n)
    of = lambda s: F.count_if(F.col("readme_status").eqNullSafe(F.lit(s)))
    return top.agg(of("ok").alias("ok"), of("not_found").alias("not_found"), of("empty").alias("empty"), of("error").alias("error"), F.count_if(F.col("readme_status").isNull()).alias("pending"))


def status_histogram(repos: DataFrame) -> DataFrame:
    return repos.groupBy("readme_status").agg(F.count(F.lit(1)).alias("n"))


def counters(repos: DataFrame, embeddings: DataFrame, label: str) -> DataFrame:
    """One row: records, READMEs found, vectors under the label, records that still need one."""
    vectors = embeddings.where(F.col("model_name") == label)
    need = repos.where("not is_archived and readme_status is not null").join(vectors, repos["id"] == vectors["repo_id"], "left_anti")
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return repos.sparkSession.range(1).select(
        n(repos).alias("total_repos"),
        n(repos.where("readme_status = 'ok'")).alias("readme_success"),
        n(vectors).alias("embeddings"),
        n(need).alias("pending"),
    )


def regression(current: DataFrame, previous: DataFrame, ratio: float = REGRESSION_RATIO) -> DataFrame:
    """metric, previous, current, failed of two one-row tables of counts; a previous 0 or a first run never fails."""
    names = [c for c in current.columns if c in previous.columns]
    pairs = ", ".join(f"'{c}', cast(`{c}` as bigint)" for c in names)
    long = lambda df, name: df.selectExpr(f"stack({len(names)}, {pairs}) as (metric, {name})")
    rows = long(current, "current").join(long(previous, "previous"), "metric", "left")
    failed = F.coalesce((F.col("previous") > 0) & (F.col("current") / F.nullif(F.col("previous"), F.lit(0)) < ratio), F.lit(False))
    return rows.select("metric", "previous", "current", failed.alias("failed"))


def progress_status(remaining: int | None) -> int:
    """0 work remains, 1 done, 2 the count failed."""
    return 2 if remaining is None else int(remaining == 0)


def run_summary(log: DataFrame) -> DataFrame:
    """shards and rows by status of a run's log (status, inserted)."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("shards"), F.sum("inserted").cast("bigint").alias("inserted"))


def cost_estimate(rates: DataFrame, n: int, tokens_in: int, tokens_out: int) -> DataFrame:
    """model, usd of ``n`` requests at rates (model, usd_in, usd_out) a million tokens."""
    usd = n * (tokens_in * F.col("usd_in") + tokens_out * F.col("usd_out")) / 1_000_000
    return rates.select("model", usd.alias("usd"))


def sample_report(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest ``by``, for a look at what a run made."""
    return rows.orderBy(F.desc(by), key).limit(n)
