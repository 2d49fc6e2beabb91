"""Connected components by alternating large-star and small-star steps on an edge table.

Each step groups edges by one end and keeps a minimum, so hubs are pre-aggregated; the join that
brings a minimum back to a hub's edges is an ordinary equi-join that adaptive execution may split.
Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import delete, materialize, scratch_path

MAX_ROUNDS = 60


def _sum_of(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")
    ).first()
    return row["n"], row["s"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v) reaches."""
    spark = edges.sparkSession

    def written(pairs: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "edges")
        return materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", path), path

    e, path = written(edges.where("u <> v"))
    state = _sum_of(e)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every edge of ``large`` has u > v; its nodes without a smaller neighbour need no edge
        large = large.where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(small_min.select("u", F.col("m").alias("v"))).where("u <> v")
        before = path
        e, path = written(small)
        delete(spark, before)
        now = _sum_of(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
