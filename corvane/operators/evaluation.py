"""Retrieval metrics over run (query, doc, rank), qrels (query, doc, grade) and canary (query, doc) tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import twister

#: Numbers that a task draws at least, as far as there are so many, and at once at most.
BLOCK_DRAWS, CHUNK_DRAWS = 1 << 26, 1 << 22


def _gain(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + F.lit(1.0))


def ndcg(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query, ndcg of each query of the run; 0 without a positive grade."""
    graded = run.where(F.col("rank") <= k).join(qrels, ["query", "doc"], "left")
    dcg = graded.groupBy("query").agg(F.sum(_gain(F.coalesce("grade", F.lit(0)), F.col("rank"))).alias("dcg"))
    best = qrels.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc"))).where(F.col("r") <= k)
    ideal = best.groupBy("query").agg(F.sum(_gain(F.col("grade"), F.col("r"))).alias("idcg"))
    ratio = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    return run.select("query").distinct().join(dcg, "query", "left").join(ideal, "query", "left").select("query", F.coalesce(ratio, F.lit(0.0)).alias("ndcg"))


def recall(run: DataFrame, qrels: DataFrame, k: int, min_grade: int = 2) -> DataFrame:
    """query, recall; null where no document has the grade."""
    relevant = qrels.where(F.col("grade") >= min_grade)
    top = run.where(F.col("rank") <= k).select("query", "doc", F.lit(1).alias("found"))
    found = relevant.join(top, ["query", "doc"], "left").groupBy("query").agg((F.count("found") / F.count(F.lit(1))).alias("recall"))
    return run.select("query").distinct().join(found, "query", "left")


def judged(run: DataFrame, qrels: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """query, judged: graded documents' share of the list as long as it is; 1 for an empty list."""
    top = run.where(F.col("rank") <= k).join(qrels.select("query", "doc", F.lit(1).alias("j")), ["query", "doc"], "left")
    share = top.groupBy("query").agg((F.count("j") / F.count(F.lit(1))).alias("judged"))
    asked = queries if queries is not None else run.select("query").distinct()
    return asked.join(share, "query", "left").select("query", F.coalesce("judged", F.lit(1.0)).alias("judged"))


def canary_recall(run: DataFrame, canary: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """query, canary: expected documents' share found; 1 where none is expected."""
    top = run.where(F.col("rank") <= k).select("query", "doc", F.lit(1).alias("found"))
    share = canary.join(top, ["query", "doc"], "left").groupBy("query").agg((F.count("found") / F.count(F.lit(1))).alias("canary"))
    asked = queries if queries is not None else canary.select("query").distinct()
    return asked.join(share, "query", "left").select("query", F.coalesce("canary", F.lit(1.0)).alias("canary"))


def binary(run: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query, recall, ndcg with relevance yes or no; 1 where nothing is relevant."""
    rel = relevant.select("query", "doc").distinct()
    sizes = rel.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    hits = run.where(F.col("rank") <= k).join(rel, ["query", "doc"], "left_semi")
    found = hits.groupBy("query").agg(F.count(F.lit(1)).alias("h"), F.sum(_gain(F.lit(1.0), F.col("rank"))).alias("dcg"))
    rows = run.select("query").distinct().join(sizes, "query", "left").join(found, "query", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    none = F.col("n").isNull()
    return rows.select(
        "query",
        F.when(none, 1.0).otherwise(F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"),
        F.when(none, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def pool(runs: list[DataFrame], depth: int = 20) -> DataFrame:
    """query, doc of the first ``depth`` ranks of any run."""
    rows = None
    for run in runs:
        part = run.where(F.col("rank") <= depth).select("query", "doc")
        rows = part if rows is None else rows.unionByName(part)
    return rows.distinct()


def unjudged(pooled: DataFrame, qrels: DataFrame) -> DataFrame:
    return pooled.join(qrels, ["query", "doc"], "left_anti")


def agreement(pairs: DataFrame) -> DataFrame:
    """n, exact, binary (grade 2 and over), kappa of the binary grades, mean bias of pairs (a, b)."""
    ba, bb = (F.col("a") >= 2).cast("double"), (F.col("b") >= 2).cast("double")
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("a") == F.col("b")).cast("double")).alias("exact"),
        F.avg((ba == bb).cast("double")).alias("agree"),
        F.avg(ba).alias("pa"),
        F.avg(bb).alias("pb"),
        F.avg((F.col("a") - F.col("b")).cast("double")).alias("bias"),
    )
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(chance < 1, (F.col("agree") - chance) / (1 - chance)).otherwise(1.0)
    return row.select("n", "exact", F.col("agree").alias("binary_agree"), kappa.alias("kappa"), "bias")


def _reached(n: int, trials: int, permutations: int, observed: float, seed: int):
    """Rows (block, delta) sorted by block: how many of the block's trials reach the observed mean."""

    def count(block: int, d: np.ndarray) -> int:
        first, end = block * trials, min((block + 1) * trials, permutations)
        draws, reached = twister.after(seed, first * n), 0
        for lo in range(first, end, step := max(1, CHUNK_DRAWS // n)):
            kept = draws.random_sample((min(step, end - lo), n)) < 0.5
            reached += int((np.abs((2.0 * (kept @ d) - d.sum()) / n) >= observed - 1e-12).sum())
        return reached

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []
        for part in parts:
            blocks, deltas = part.column("block").to_numpy(), part.column("delta").to_numpy()
            for a, b in zip(at := [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist()], [*at[1:], len(blocks)], strict=True):
                if b > a:
                    if key is not None and blocks[a] != key:
                        found.append(count(key, np.concatenate(held)))
                        held = []
                    key = int(blocks[a])
                    held.append(deltas[a:b])
        if key is not None:
            found.append(count(key, np.concatenate(held)))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["reached"])

    return run


def fisher_p(deltas: DataFrame, permutations: int = 100_000, seed: int = 0, block_draws: int = BLOCK_DRAWS) -> DataFrame:
    """Two-sided paired randomisation test of rows (query, delta) as one row ``p``, by the one sequence of ``random.Random(seed)``.

    A trial keeps a delta's sign where its number is below 0.5; numbers go to the queries in their order, trial after trial. A task
    starts its trials where they lie in the sequence, so p is the same however many tasks share the work; it holds all deltas (8
    bytes a query). A row without a delta is left out; p is 1 without rows or with a mean of 0."""
    rows = deltas.where("delta is not null").select("query", F.col("delta").cast("double").alias("delta"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("delta")).first()
    observed = abs(total / n) if n else 0.0
    if observed == 0.0:
        return deltas.sparkSession.range(1).select(F.lit(1.0).alias("p"))
    trials = max(1, block_draws // n)
    blocks = -(-permutations // trials)
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, "block")
    dealt = dealt.sortWithinPartitions("block", "query", "delta").select("block", "delta")
    found = dealt.mapInArrow(_reached(n, trials, permutations, observed, seed), "reached bigint")
    return found.agg(((F.sum("reached") + 1) / F.lit(permutations + 1.0)).alias("p"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 even bits of each number (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flipped(permutations: int, words: int):
    """Sums of the deltas with the signs of each trial, for rows (key, delta, block of 64 * ``words`` trials)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            keys, deltas, blocks = (part.column(c).to_numpy() for c in ("key", "delta", "block"))
            for block in np.unique(blocks).tolist():
                rows = np.flatnonzero(blocks == block)
                total = sums.setdefault(block, np.zeros(64 * words))
                step = np.arange(1 + block * words, 1 + (block + 1) * words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for lo in range(0, len(rows), 64):
                    at = rows[lo : lo + 64]
                    bits = np.unpackbits(_mixed(keys[at].astype(np.uint64)[:, None] + step).view(np.uint8), axis=1, bitorder="little")
                    total += 2.0 * (deltas[at] @ bits.astype(np.float64)) - deltas[at].sum()
        for block, total in sums.items():
            trials = np.arange(64 * words) + 64 * words * block
            known = trials < permutations
            yield pa.RecordBatch.from_arrays([pa.array(trials[known]), pa.array(total[known])], names=["trial", "total"])

    return run


def fisher_p_distributed(deltas: DataFrame, permutations: int = 10_000, seed: int = 0, block_rows: int = 32_768, words: int = 200) -> DataFrame:
    """The test with signs from a hash, which SQL can state: spread over blocks of trials and of rows.

    The work is rows times trials; a row without a delta is left out, and one of 0 changes no sum."""
    rows = deltas.where("delta is not null").select("query", F.col("delta").cast("double").alias("delta"))
    n, total, flips = rows.agg(F.count(F.lit(1)), F.sum("delta"), F.count_if(F.col("delta") != 0)).first()
    observed = abs(total / n) if n else 0.0
    nth = F.row_number().over(Window.partitionBy("query").orderBy("delta"))
    named = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query").cast("string"), nth.cast("string")))
    keyed = rows.where("delta <> 0").select(F.conv(F.left(named, F.lit(16)), 16, -10).cast("bigint").alias("key"), "delta")
    blocks, dealt = -(-permutations // (64 * words)), max(1, -(-flips // block_rows))
    keyed = keyed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("deal", F.pmod("key", F.lit(dealt)))
    sums = keyed.repartition(blocks * dealt, "block", "deal").select("key", "delta", "block").mapInArrow(_flipped(permutations, words), "trial bigint, total double")
    sums = sums.groupBy("trial").agg(F.sum("total").alias("total"))
    below = F.count_if(F.abs(F.col("total") / F.lit(n or 1)) < F.lit(observed - 1e-12))
    return sums.agg(((F.lit(permutations) - below + 1) / F.lit(permutations + 1.0)).alias("p"))


def compare(run_a: DataFrame, run_b: DataFrame, qrels: DataFrame, canary: DataFrame, k: int = 10, gate_query: str | None = None, gate_docs: Sequence[str] = (), min_delta: float = 0.03, alpha: float = 0.05) -> tuple[dict, DataFrame]:
    """(summary with the ship gate, per-query deltas) over the queries of both runs."""
    both = run_a.select("query").distinct().join(run_b.select("query").distinct(), "query")
    a, b = run_a.join(both, "query"), run_b.join(both, "query")
    deltas = ndcg(a, qrels, k).withColumnRenamed("ndcg", "ndcg_a").join(ndcg(b, qrels, k).withColumnRenamed("ndcg", "ndcg_b"), "query")
    deltas = deltas.withColumn("delta", F.col("ndcg_b") - F.col("ndcg_a"))
    n, delta = deltas.agg(F.count(F.lit(1)), F.coalesce(F.avg("delta"), F.lit(0.0))).first()
    p = fisher_p(deltas).first()["p"]
    known = canary.join(both, "query", "left_semi")
    ca, cb = (canary_recall(x, known, k).agg(F.avg("canary")).first()[0] or 0.0 for x in (a, b))
    in_gate = {r["doc"] for r in run_b.where((F.col("query") == gate_query) & (F.col("rank") <= k)).select("doc").collect()} if gate_query else set()
    ja, jb = (judged(x, qrels, k).agg(F.avg("judged")).first()[0] or 0.0 for x in (a, b))
    checks = {"delta": delta >= min_delta, "p": p < alpha, "canary": cb > ca, "gate_docs": set(gate_docs) <= in_gate}
    summary = {"n_queries": n, "delta": delta, "p": p, "canary_a": ca, "canary_b": cb, "judged_a": ja, "judged_b": jb, "judged_low": min(ja, jb) < 0.9}
    return summary | {"checks": checks, "gate_pass": all(checks.values())}, deltas


def extremes(deltas: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(best, worst) queries by delta."""
    return deltas.orderBy(F.desc("delta"), "query").limit(n), deltas.orderBy("delta", "query").limit(n)


def sample_rows(rows: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed: those whose key and seed have the smallest MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return rows.orderBy(digest, *key).limit(n)


def worst_first(per_query: DataFrame) -> DataFrame:
    """Per-query rows (query, ndcg_graded, ndcg) from the worst on."""
    return per_query.orderBy(F.coalesce("ndcg_graded", "ndcg", F.lit(0.0)), "query")


def judged_alarm(judged_rows: DataFrame, least: float = 0.90) -> DataFrame:
    """One row if the mean share of judged documents is too low."""
    return judged_rows.agg(F.avg("judged").alias("judged")).where(F.col("judged") < least)
