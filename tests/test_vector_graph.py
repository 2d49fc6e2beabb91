"""The graph index of vectors against exact search."""

import numpy as np
import pytest

from corvane.operators import lanes, vector_graph

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    x = centres[rng.integers(0, 12, 3000)] + 0.6 * rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"r{i}", v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame([*rows, ("none", None)], "repo_id string, embedding array<float>")


def asked(spark, x, n):
    return spark.createDataFrame([(i, x[i].tolist()) for i in range(0, len(x), len(x) // n)], "query_id bigint, vector array<double>")


def recall(exact, found):
    want, got = ({(r.query_id, r.repo_id) for r in f.collect()} for f in (exact, found))
    return len(want & got) / len(want)


def test_recall_and_what_is_compared(spark, tmp_path):
    """The given vectors: nine tenths of the ten nearest, for a tenth of the comparisons, and every vector in the index."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("concat('d', vec_id) AS repo_id", "embedding", "vec_id")
    queries = rows.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    index = vector_graph.build_graph(rows, str(tmp_path / "graph"))
    assert index.places.select("repo_id").distinct().count() == rows.count()
    assert recall(lanes.dense(rows, queries, 10), vector_graph.dense_by_graph(index, queries, 10)) >= 0.95
    looked = vector_graph.compared(index, queries, 10).agg({"compared": "avg"}).first()[0]
    assert looked <= 0.1 * rows.count()


def test_ranges_and_filters(spark, vectors, tmp_path):
    x, rows = vectors
    queries = asked(spark, x, 60)
    index = vector_graph.build_graph(rows, str(tmp_path / "graph"), range_rows=700)
    assert index.graphs.count() == 5 and index.places.count() == len(x)
    exact = lanes.dense(rows, queries, 10)
    found = vector_graph.dense_by_graph(index, queries, 10)
    assert recall(exact, found) >= 0.95
    # distances are exact, and ranks follow them
    at = {(r.query_id, r.repo_id): r.dist for r in exact.collect()}
    for r in found.collect():
        assert at.get((r.query_id, r.repo_id), r.dist) == pytest.approx(r.dist, abs=1e-6)
    # under a filter the walk goes on until it has enough of those that may be found
    for share in ("0 = pmod(hash(id), 3)", "id IN ('r1', 'r5', 'r77')", "false"):
        alive = rows.selectExpr("repo_id AS id").where(share)
        want, got = lanes.dense(rows, queries, 10, alive), vector_graph.dense_by_graph(index, queries, 10, alive)
        if share == "false":
            assert got.collect() == []
        else:
            assert recall(want, got) >= 0.95 and {r.repo_id for r in got.collect()} <= {r.id for r in alive.collect()}


def test_links_and_walks():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    ends, links = vector_graph.linked(x, 6)
    sizes = np.diff(np.append(0, ends.astype(int)))
    assert len(ends) == 200 and sizes.min() >= 1 and sizes.max() <= 6
    assert all(i not in links[ends[i] - sizes[i] : ends[i]] for i in range(200))
    codes, scales = vector_graph.in_bytes(x)
    assert np.abs(codes * scales[:, None] - x).max() <= scales.max() / 2 + 1e-6
    entries = vector_graph.far_apart(x, 4)
    assert len(set(entries.tolist())) == 4
    found, compared = vector_graph.walk(x[3], codes, scales, ends, links, entries, 200, None)
    assert compared == len(found) and 3 in found
    for n in (0, 1, 2):
        ends, links = vector_graph.linked(x[:n], 6)
        assert len(ends) == n and len(links) == (n if n > 1 else 0)


def test_nothing_to_index(spark, vectors, tmp_path):
    x, rows = vectors
    index = vector_graph.build_graph(rows.where("false"), str(tmp_path / "none"))
    assert vector_graph.dense_by_graph(index, asked(spark, x, 3), 5).collect() == []
    one = vector_graph.build_graph(rows.where("repo_id = 'r9'"), str(tmp_path / "one"))
    assert [r.repo_id for r in vector_graph.dense_by_graph(one, asked(spark, x, 1), 5).collect()] == ["r9"]
    assert vector_graph.dense_by_graph(one, asked(spark, x, 1).where("false"), 5).collect() == []


def test_recall_in_large_ranges(spark, tmp_path):
    """Queries with and without a group of like vectors, in ranges of several thousand."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((8000, 64))
    x[4000:] = x[rng.integers(0, 40, 4000)] + 0.09 * rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"r{i}", v) for i, v in enumerate(x.tolist())], "repo_id string, embedding array<float>")
    queries = spark.createDataFrame([(i, x[i * 40].tolist()) for i in range(200)], "query_id bigint, vector array<float>")
    index = vector_graph.build_graph(rows, str(tmp_path / "graph"))
    assert recall(lanes.dense(rows, queries, 10), vector_graph.dense_by_graph(index, queries, 10)) >= 0.9
