"""A navigable graph index over vectors, in ranges.

Vectors are dealt into ranges of about ``RANGE``; a task links each of a range's vectors with near ones in different directions, so that a
walk from a few far-apart entries comes near to any query. A search walks each range's graph over vectors in bytes and compares the
best it met exactly. Every vector is indexed. Under a filter the walk goes on through vectors that may not be found until it has
enough of those that may; where there are fewer, it sees all that the entries reach.

Vectors are linked by their directions, so for inner products the index is meant for vectors of similar lengths.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.lanes import DENSE_K, _query_blocks, best_of
from corvane.scratch import materialize

#: Vectors of a range, about; links of a vector; entries of a range; vectors that a walk keeps, at least.
RANGE, LINKS, ENTRIES, BEAM = 16_384, 12, 16, 15
#: Vectors that a walk keeps in a whole range, at least; by the square of its rows in a smaller one. A query whose own group of like vectors
#: lies in other ranges is near to few of a range, and a narrow walk ends before it meets them.
RANGE_BEAM = 512
#: Links to the nearest that are kept whatever their direction.
_NEAREST = 4

GRAPH = "part int, ids array<string>, bytes binary, scales binary, vectors binary, ends binary, links binary, entries binary"
PLACES = "part int, place int, repo_id string"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def linked(x: np.ndarray, links: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """(ends, links) of each row's neighbours: of the nearest rows, and of those that have it among theirs, the ones that no nearer
    neighbour is closer to; the nearest few in any case."""
    unit, n = _unit(x.astype(np.float32)), len(x)
    near = np.zeros((n, min(links, n - 1) if n else 0), np.int64)
    for lo in range(0, n, 2048):
        sim = unit[lo : lo + 2048] @ unit.T
        sim[np.arange(len(sim)), lo + np.arange(len(sim))] = -np.inf
        if near.shape[1]:
            near[lo : lo + 2048] = np.argpartition(-sim, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(near.tolist()):
        for j in row:
            back[j].append(i)
    out = []
    for i in range(n):
        others = np.union1d(near[i], np.array(back[i], np.int64))
        others = others[np.argsort(-(unit[others] @ unit[i]), kind="stable")][: 4 * links]
        between, to = unit[others] @ unit[others].T, unit[others] @ unit[i]
        kept: list[int] = []
        for k in range(len(others)):
            if len(kept) < _NEAREST or (between[k, kept] < to[k]).all():
                kept.append(k)
            if len(kept) == links:
                break
        out.append(others[kept])
    ends = np.cumsum([len(o) for o in out]) if out else np.zeros(0, np.int64)
    return ends.astype("<u4"), (np.concatenate(out) if out else np.zeros(0)).astype("<u4")


def far_apart(x: np.ndarray, n: int = ENTRIES) -> np.ndarray:
    """Rows that are far from each other: each next one is the least similar to those before."""
    unit = _unit(x.astype(np.float32))
    chosen, most = [0], unit @ unit[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(most.argmin()))
        most = np.maximum(most, unit @ unit[chosen[-1]])
    return np.array(chosen, "<u4")


def entries_of(x: np.ndarray, ends: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Rows far apart, and one more of whatever the links don't lead to from those: each row can be reached."""
    entries, reached = far_apart(x).tolist(), np.zeros(len(x), bool)
    starts = np.append(0, ends[:-1]).astype(np.int64)
    front = np.array(entries, np.int64)
    while len(front):
        reached[front] = True
        sizes = ends[front].astype(np.int64) - starts[front]
        to = np.repeat(starts[front] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        front = np.unique(links[to])
        front = front[~reached[front]]
        if not len(front) and not reached.all():
            front = np.flatnonzero(~reached)[:1]
            entries.append(int(front[0]))
    return np.array(entries, "<u4")


def in_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows as signed bytes, what each row's bytes stand for)."""
    scales = np.maximum(np.abs(x).max(axis=1), 1e-12) / 127
    return np.rint(x / scales[:, None]).astype(np.int8), scales.astype(np.float32)


def _graphs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range; one row a range."""
    names = [f.split()[0] for f in GRAPH.split(", ")]

    def graph(part: int, ids: list[str], x: np.ndarray) -> pa.RecordBatch:
        (ends, links), (codes, scales) = linked(x), in_bytes(x)
        blobs = [codes.tobytes(), scales.tobytes(), x.astype("<f4").tobytes(), ends.tobytes(), links.tobytes(), entries_of(x, ends, links).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ids], pa.list_(pa.string())), *[pa.array([b], pa.binary()) for b in blobs]], names=names)

    key, ids, rows = None, [], []
    for batch in parts:
        for part, repo, vector in zip(*[batch.column(c).to_pylist() for c in ("part", "repo_id", "embedding")], strict=True):
            if part != key and ids:
                yield graph(key, ids, np.array(rows, np.float32))
                ids, rows = [], []
            key = part
            ids.append(repo)
            rows.append(vector)
    if ids:
        yield graph(key, ids, np.array(rows, np.float32))


@dataclass(frozen=True)
class VectorGraph:
    graphs: DataFrame
    places: DataFrame


def build_graph(embeddings: DataFrame, path: str, range_rows: int = RANGE) -> VectorGraph:
    """Index every vector (repo_id, embedding, all of one length); rows without one are left out."""
    spark = embeddings.sparkSession
    rows = embeddings.where("embedding is not null").select("repo_id", F.col("embedding").cast("array<float>").alias("embedding"))
    parts = max(1, -(-rows.count() // range_rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("repo_id"), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "repo_id")
    dealt.select("part", "repo_id", "embedding").mapInArrow(_graphs, GRAPH).write.mode("overwrite").parquet(f"{path}/graphs")
    graphs = spark.read.schema(GRAPH).parquet(f"{path}/graphs")
    graphs.select("part", F.posexplode("ids").alias("place", "repo_id")).write.mode("overwrite").parquet(f"{path}/places")
    return open_graph(spark, path)


def open_graph(spark: SparkSession, path: str) -> VectorGraph:
    return VectorGraph(spark.read.schema(GRAPH).parquet(f"{path}/graphs"), spark.read.schema(PLACES).parquet(f"{path}/places"))


def walk(query: np.ndarray, codes: np.ndarray, scales: np.ndarray, ends: np.ndarray, links: np.ndarray, entries: np.ndarray, beam: int, alive: np.ndarray | None) -> tuple[list[int], int]:
    """(the ``beam`` best rows that the walk met, of those alive; how many rows it compared)."""
    seen = set(entries.tolist())
    first = list(seen)
    scores = (codes[first].astype(np.float32) @ query) * scales[first]
    open_, best = [], []

    def meet(rows: list[int], values: np.ndarray) -> None:
        for row, value in zip(rows, values.tolist(), strict=True):
            if len(best) < beam or value > best[0][0]:
                heapq.heappush(open_, (-value, row))
                if alive is None or alive[row]:
                    heapq.heappush(best, (value, row))
                    if len(best) > beam:
                        heapq.heappop(best)

    meet(first, scores)
    while open_:
        value, row = heapq.heappop(open_)
        if len(best) >= beam and -value < best[0][0]:
            break
        new = [j for j in links[(ends[row - 1] if row else 0) : ends[row]].tolist() if j not in seen]
        if new:
            seen.update(new)
            meet(new, (codes[new].astype(np.float32) @ query) * scales[new])
    return [row for _, row in best], len(seen)


def _walked(block, k: int, beam: int, filtered: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = block.value
        for part in parts:
            for raw in part.to_pylist():
                scales, x = np.frombuffer(raw["scales"], "<f4"), np.frombuffer(raw["vectors"], "<f4").reshape(len(raw["ids"]), -1)
                codes = np.frombuffer(raw["bytes"], np.int8).reshape(x.shape)
                ends, links, entries = (np.frombuffer(raw[c], "<u4") for c in ("ends", "links", "entries"))
                alive = None
                if filtered:
                    alive = np.zeros(len(x), bool)
                    alive[raw["alive"]] = True
                out: list[tuple] = []
                width = max(beam, RANGE_BEAM * len(x) ** 2 // RANGE**2)
                for q, vector in zip(ids, matrix, strict=True):
                    found, compared = walk(vector.astype(np.float32), codes, scales, ends, links, entries, width, alive)
                    exact = -(x[found].astype(np.float64) @ vector)
                    nearest = sorted(zip(exact.tolist(), [raw["ids"][i] for i in found], strict=True))[:k]
                    out += [(q, repo, d, None) for d, repo in nearest] + [(q, None, None, compared)]
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "repo_id", "dist", "compared"])

    return run


def _found(index: VectorGraph, queries: DataFrame, k: int, alive: DataFrame | None, beam: int) -> DataFrame:
    """query_id, repo_id, dist of each range's best; a row without repo_id for each range says how many rows were compared."""
    spark, graphs = index.graphs.sparkSession, index.graphs
    if alive is not None:
        kept = index.places.join(alive.select(F.col("id").cast("string").alias("repo_id")), "repo_id", "left_semi").groupBy("part").agg(F.collect_list("place").alias("alive"))
        graphs = graphs.join(materialize(kept, "alive"), "part")
    out = None
    for ids, matrix in _query_blocks(queries):
        if ids:
            rows = graphs.mapInArrow(_walked(spark.sparkContext.broadcast((ids, matrix)), k, max(beam, k), alive is not None), "query_id bigint, repo_id string, dist double, compared bigint")
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "query_id bigint, repo_id string, dist double, compared bigint")


def dense_by_graph(index: VectorGraph, queries: DataFrame, k: int = DENSE_K, alive: DataFrame | None = None, beam: int = BEAM) -> DataFrame:
    """query_id, repo_id, dist, rnk as the exact lane gives them, but for what the walks miss; ``beam`` (at least what
    the ranges' sizes ask for) trades recall for work."""
    rows = _found(index, queries, k, alive, beam).where("repo_id is not null")
    return best_of(rows, [F.asc("dist"), F.asc("repo_id")], k).select("query_id", "repo_id", "dist", "rnk")


def compared(index: VectorGraph, queries: DataFrame, k: int = DENSE_K, alive: DataFrame | None = None, beam: int = BEAM) -> DataFrame:
    """query_id, compared: how many vectors a query's walks look at."""
    return _found(index, queries, k, alive, beam).where("repo_id is null").groupBy("query_id").agg(F.sum("compared").alias("compared"))
