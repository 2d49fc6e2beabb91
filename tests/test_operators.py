import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from corvane.functions.ranking import LaneWeights
from corvane.operators import evaluation, filters, lanes, mining, packages, search, upsert


def test_upsert_policies(spark):
    base = spark.createDataFrame([(1, "a", 10, None), (2, "b", 20, "k")], "id int, name string, n int, own string")
    new = spark.createDataFrame([(2, "x", 21), (3, "c", 30)], "id int, name string, n int")
    rows = {r.id: (r.name, r.n, r.own) for r in upsert.upsert(base, new, ["id"], ["n"]).collect()}
    assert rows == {1: ("a", 10, None), 2: ("b", 21, "k"), 3: ("c", 30, None)}
    assert {r.id for r in upsert.upsert(base, new, ["id"], ["n"], update_only=True).collect()} == {1, 2}
    same = {r.id: r.n for r in upsert.upsert(base, new, ["id"], [], do_nothing=True).collect()}
    assert same == {1: 10, 2: 20, 3: 30}


def test_list_parsing(spark):
    md = """# Awesome Things
## Contents
- [x](https://github.com/no/where) in contents is still an entry
## Databases
### Columnar {#col}
- [Quick DB](https://github.com/q/db) - A quick store. ([Demo](https://d)) `MIT`
- [self](https://github.com/own/list) - the list itself
- [deep](https://github.com/a/b/tree/main) - deep links are not records
- [about](https://github.com/about/me) - reserved
~~~
- [fenced](https://github.com/f/f) - not seen
```
| [t/x](https://github.com/t/x.git) | first cell text | more |
- [one](https://github.com/a/one) and [two](https://github.com/a/two) - they share a line
"""
    lists = spark.createDataFrame([("Own/List", md), ("Own/List", "* [a](https://github.com/again/again)"), ("no/content", None), (None, "1. [b](https://github.com/b/b)\r\n# H\r\n+ [c](https://github.com/c/c)")], "list_name string, content string")
    rows = mining.parse_lists(lists).collect()
    own = sorted((r for r in rows if r.list_name == "Own/List"), key=lambda r: r.place)
    assert sorted(r.full_name for r in own if r.place == 0) == ["again/again", "no/where"]
    got = [tuple(r)[2:] for r in own if r.full_name != "again/again"]
    assert [e[0] for e in got] == ["no/where", "q/db", "t/x", "a/one", "a/two"]
    assert got[1][1:] == ("Quick DB", "A quick store.", ["Things", "Databases", "Columnar"])
    assert got[2][1:3] == ("t/x", "first cell text")
    assert got[3][2].startswith("and two") and got[4][2] is None
    assert sorted((r.full_name, r.place, r.categories) for r in rows if r.list_name is None) == [("b/b", 0, []), ("c/c", 1, ["H"])]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert (one(mining.anchor_name(F.lit("Name - Long words here"))), one(mining.anchor_said(F.lit("Name - Long words here")))) == ("Name", "Long words here")
    assert one(mining.said_of(F.lit("- short"))) is None and one(mining.said_of(F.lit(" - " + "word " * 120))).endswith("word…")
    assert one(mining.said_of(F.lit(" - " + "x" * 500))) == "x" * 400 + "…"
    assert one(mining.said_of(F.lit(" | cell | MIT |"))) == "cell | MIT" and one(mining.said_of(F.lit(" | a long cell | MIT |"))) == "a long cell"
    assert one(mining.heading_label(F.lit("Contributing"))) is None and one(mining.heading_label(F.lit("何か tools"))) is None
    assert one(mining.heading_label(F.lit("**Awesome** [Data](x) & Tools —"))) == "Data & Tools"
    assert not any(one(mining.name_like(F.lit(x))) for x in ("", "www.x.y", "a b c d e f", "x" * 41, "123")) and one(mining.name_like(F.lit("Dear ImGui")))


def test_headings_and_fences(spark):
    """A heading counts until one of its level or above comes; a fence hides headings and entries, also an open one."""
    md = "# A\n## B\n#### D\n- [1](https://github.com/o/a)\n### C\n- [2](https://github.com/o/b)\n# E\n- [3](https://github.com/o/c)\n## e\n- [4](https://github.com/o/d)\n~~~\n# X\n- [5](https://github.com/o/e)\n```\n- [6](https://github.com/o/f)\n~~~\n- [7](https://github.com/o/g)"
    rows = mining.parse_lists(spark.createDataFrame([("l", md)], "list_name string, content string")).orderBy("place").collect()
    assert [(r.full_name, r.categories) for r in rows] == [("o/a", ["A", "B", "D"]), ("o/b", ["A", "B", "C"]), ("o/c", ["E"]), ("o/d", ["E"]), ("o/f", ["E"])]


def test_votes_and_payload(spark):
    entries = [(f"l{i}", 0, "O/Imgui", "Dear ImGui" if i < 2 else f"Odd {i}", "Bloat-free graphical interface.", ["GUI"]) for i in range(4)]
    df = spark.createDataFrame(entries + [("l0", 1, "o/imgui", "dear imgui", "Another text of it.", ["gui", "C++"])], mining.ENTRY)
    targets, votes = mining.vote(df)
    assert targets.first().n_lists == 4
    corpus = spark.createDataFrame([("d1", "o/imgui", "imgui", "Bloat-free graphical interface")], "id string, full_name string, name string, description string")
    row = mining.select_payload(targets, votes, corpus).first()
    assert row.aliases == ["Dear ImGui"] and row.categories == ["GUI", "C++"]
    assert row.description.split("\n")[0] == "Bloat-free graphical interface." or "Another text of it." in row.description


def test_packages(spark):
    rows = spark.createDataFrame([("pytorch", "PYPI", "torch", "SOURCE_REPO"), ("pytorch", "GO", "github.com/pytorch/pytorch", "SOURCE_REPO"), ("pytorch", "NPM", "zzz", "ISSUE_TRACKER")], "repo_name string, system string, name string, relation_type string")
    assert [(r.system, r.name) for r in packages.select_packages(rows).orderBy("rnk").collect()] == [("PYPI", "torch"), ("GO", "github.com/pytorch/pytorch")]
    marked = spark.createDataFrame([("c++lib", "X", "aaaa", "SOURCE_REPO"), ("c++lib", "X", "my-clib", "SOURCE_REPO")], "repo_name string, system string, name string, relation_type string")
    assert [r.name for r in packages.select_packages(marked).orderBy("rnk").collect()] == ["my-clib", "aaaa"]


def test_bounded_cut_may_lose_a_lifted_record(spark):
    corpus = spark.createDataFrame([(f"d{i}", f"o/n{i}", f"n{i}", "alpha beta", "x", ["t"], 1000 - i, "", False) for i in range(5)] + [("low", "o/low", "low", "alpha beta", "x", ["t"], 1, "", False)], "id string, full_name string, name string, description string, primary_language string, topics array<string>, stars bigint, readme string, is_archived boolean")
    terms = spark.createDataFrame([("low", ["gamma"])], "repo_id string, terms array<string>")
    q = spark.createDataFrame([(1, "alpha beta gamma")], "query_id bigint, query string")
    first = lambda b: lanes.fulltext(corpus, q, k=2, terms=terms, bounded=b).where("rnk = 1").first().repo_id
    assert first(False) == "low" and first(True) == "d0"


def test_search_edges(spark):
    corpus = spark.createDataFrame([("a", "o/flask", "flask", "web tool", "py", ["t"], 5, "r", False, False, None), ("b", "o/other", "other", "web tool", None, ["t"], 500, "r", True, False, None)], "id string, full_name string, name string, description string, primary_language string, topics array<string>, stars bigint, readme string, is_archived boolean, is_fork boolean, pushed_at timestamp")
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "repo_id string, embedding array<float>")
    q = spark.createDataFrame([(1, "flask", [0.0, 1.0]), (2, "web tool", None), (3, "   ", None)], "query_id bigint, query string, vector array<float>")
    now = datetime(2024, 1, 1, tzinfo=UTC)
    flt = filters.SearchFilters(exclude_archived=False)
    hits = search.search(corpus, vectors, q, now, flt).collect()
    assert {h.query_id for h in hits} == {1, 2}
    top = next(h for h in hits if h.query_id == 1 and h.rank == 1)
    assert top.repo_id == "a" and top.exact_name and top.similarity == 0.0
    for h in hits:
        parts = h.similarity_contribution + h.stars_contribution + h.recency_contribution + h.criticality_contribution
        assert parts == pytest.approx(h.hybrid_score)
    assert {h.repo_id for h in search.search(corpus, vectors, q, now).collect()} == {"a"}
    # a lane of weight 0 keeps its candidates
    zero = search.search(corpus, vectors, q, now, flt, LaneWeights(0.0, 0.0, 0.0)).collect()
    assert len(zero) == len(hits)
    # with empty side tables the enriched search is the plain one
    none = spark.createDataFrame([], "repo_id string, terms array<string>"), spark.createDataFrame([], "repo_id string, dependent_count bigint")
    rich = search.search(corpus, vectors, q, now, flt, terms=none[0], signals=none[1], enrich=True).collect()
    key = lambda rows: sorted((h.query_id, h.rank, h.repo_id, round(h.hybrid_score, 9)) for h in rows)
    assert key(rich) == key(hits)


def test_metrics(spark):
    run = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abc")], "query string, doc string, rank int")
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 0), ("q", "c", 2), ("q", "d", 1)], "query string, doc string, grade int")
    from math import log2

    assert evaluation.ndcg(run, qrels, 10).first().ndcg == pytest.approx(4 / (3 + 2 / log2(3) + 0.5))
    assert evaluation.judged(run, qrels.where("doc in ('a', 'b')"), 3).first().judged == pytest.approx(2 / 3)
    assert evaluation.recall(run, qrels.where("grade < 2"), 10).first().recall is None
    assert evaluation.binary(run, qrels.where("false"), 3).first()[1:] == (1.0, 1.0)


def by_one_generator(deltas, permutations, seed):
    """The test drawn number by number."""
    draw, n = random.Random(seed).random, len(deltas)
    means = (abs(sum(d * (1 if draw() < 0.5 else -1) for d in deltas) / n) for _ in range(permutations))
    return (1 + sum(m >= abs(sum(deltas) / n) - 1e-12 for m in means)) / (permutations + 1)


@pytest.mark.parametrize(("n", "permutations"), [(1, 50), (12, 2000), (700, 301), (1999, 101), (2001, 101), (20_000, 23)])
def test_fisher_is_the_seeded_sequence(spark, n, permutations):
    rng = random.Random(n)
    deltas = [round(rng.uniform(-0.3, 0.31), 3) for _ in range(n)]
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(deltas)] + [(n, None)], "query int, delta double")
    want = by_one_generator(deltas, permutations, 3)
    for draws in (1 << 26, 7 * n, 1):
        if permutations * n // draws < 400:
            assert evaluation.fisher_p(frame, permutations, 3, draws).first().p == pytest.approx(want, abs=1e-12)


def test_fisher_without_a_difference(spark):
    frame = spark.createDataFrame([(1, 0.0), (2, 0.0)], "query int, delta double")
    assert evaluation.fisher_p(frame).first().p == evaluation.fisher_p(frame.where("false")).first().p == 1.0


@pytest.mark.parametrize("seed", [0, 11])
def test_sequence_from_any_place(seed):
    from corvane.functions import twister

    for n in (0, 5, 623, 1247, 1248, 100_003):
        rng = random.Random(seed)
        for _ in range(n):
            rng.random()
        assert twister.after(seed, n).random_sample(700).tolist() == [rng.random() for _ in range(700)]


def test_fisher_over_all_rows(spark, monkeypatch):
    """The registered query takes every label and 100,000 trials; p is that of all sign changes."""
    from corvane.plans import catalog

    deltas = [0.3, -0.1, 0.2, 0.05, 0.25, -0.15, 0.1, 0.0, 0.12, 0.07]
    sums = [abs(sum(d if k >> i & 1 else -d for i, d in enumerate(deltas))) for k in range(1 << len(deltas))]
    exact = sum(s >= abs(sum(deltas)) - 1e-12 for s in sums) / len(sums)
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(deltas)] + [(99, None)], "query bigint, delta double")
    p = evaluation.fisher_p_distributed(frame, 100_000).first().p
    assert abs(p - exact) < 0.006
    assert evaluation.fisher_p_distributed(frame, 100_000, block_rows=2, words=7).first().p == pytest.approx(p, abs=1e-12)
    assert evaluation.fisher_p_distributed(frame.where("delta = 0"), 100).first().p == 1.0
    assert evaluation.fisher_p_distributed(frame.where("false"), 100).first().p == 1.0
    taken, whole = [], evaluation.fisher_p_distributed
    monkeypatch.setattr(evaluation, "fisher_p_distributed", lambda d, **k: taken.append((d.count(), k)) or whole(d, **k))
    assert 0 < catalog.queries()["evl06_fisher"](spark, "/root/testdata/sf0.001").first().p <= 1
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").count()
    assert taken == [(labels, {"permutations": 100_000})] and labels > 50


def test_compare_gate(spark):
    q = [f"q{i}" for i in range(12)]
    good = spark.createDataFrame([(x, "g", 1) for x in q], "query string, doc string, rank int")
    bad = spark.createDataFrame([(x, "z", 1) for x in q], "query string, doc string, rank int")
    qrels = spark.createDataFrame([(x, "g", 3) for x in q], "query string, doc string, grade int")
    canary = qrels.select("query", "doc")
    summary, deltas = evaluation.compare(bad, good, qrels, canary, gate_query="q0", gate_docs=["g"])
    assert summary["gate_pass"] and summary["n_queries"] == 12 and summary["judged_low"]
    best, worst = evaluation.extremes(deltas, 2)
    assert best.count() == 2 and worst.count() == 2
    assert summary["p"] == by_one_generator([r.delta for r in deltas.orderBy("query").collect()], 100_000, 0)


def test_guarded_names():
    assert filters.guarded_names(["a/b"]) == ["a/b"]
    with pytest.raises(ValueError):
        filters.guarded_names(["a/b'; --"])


def test_name_lane_odd_queries(spark):
    names = spark.createDataFrame([("1", "-x", "o/-x", 5), ("2", "ab", "o/ab", 1)], "id string, name string, full_name string, stars bigint")
    q = spark.createDataFrame([(1, "-"), (2, ""), (3, None), (4, "AB")], "query_id bigint, query string")
    assert {(r.query_id, r.repo_id) for r in lanes.name_match(names, q).collect()} == {(1, "1"), (4, "2")}


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "b")], "k int, t int, v string")
    assert upsert.latest(df, ["k"], ["t"]).select("k", "v").collect()[0][1] == "b"
    assert df.agg(F.count("k")).first()[0] == 3


def test_dense_keeps_k_however_rows_come(spark):
    """The k nearest of each query leave a task, at any batch size; ties go to the smaller id."""
    rng = random.Random(5)
    vectors = [(f"d{i:04d}", [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(900)]
    queries = [(q, [float(rng.randint(-2, 2)) for _ in range(4)]) for q in range(15)] + [(99, None)]
    e = spark.createDataFrame(vectors, "repo_id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(queries, "query_id bigint, vector array<float>")
    dist = lambda a, b: -sum(x * y for x, y in zip(a, b, strict=True))
    want = {(i, d): k + 1 for i, v in queries if v for k, (_, d) in enumerate(sorted((dist(x, v), d) for d, x in vectors)[:7])}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in ("16", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        assert {(r.query_id, r.repo_id): r.rnk for r in lanes.dense(e, q, k=7).collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    held = spark.sparkContext.broadcast(([i for i, v in queries if v], __import__("numpy").array([v for _, v in queries if v]), None))
    out = e.coalesce(1).mapInArrow(lanes._nearest(held, 7), "query_id bigint, repo_id string, dist double").count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert out == 7 * 15


def test_vector_index(spark, tmp_path):
    rng = random.Random(6)
    vectors = [(f"d{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(1500)] + [("none", None)]
    e = spark.createDataFrame(vectors, "repo_id string, embedding array<float>")
    q = e.where("repo_id <> 'none'").limit(20).select(F.substring("repo_id", 2, 9).cast("bigint").alias("query_id"), F.col("embedding").alias("vector"))
    index = lanes.build_vector_index(e, str(tmp_path / "v"), cells=20)
    exact = {(r.query_id, r.repo_id) for r in lanes.dense(e, q, k=10).collect()}
    every = {(r.query_id, r.repo_id) for r in lanes.dense_indexed(index, q, k=10, probes=20).collect()}
    some = {(r.query_id, r.repo_id) for r in lanes.dense_indexed(index, q, k=10, probes=8).collect()}
    assert index.rows.count() == 1500 and every == exact and len(some & exact) >= 0.8 * len(exact)
    assert lanes.dense_indexed(index, q.where("false")).count() == 0
    assert lanes.build_vector_index(e.where("false"), str(tmp_path / "none")).rows.count() == 0


def test_stored_index_gives_the_same_lanes(spark, tmp_path):
    from corvane.plans.catalog import requests
    from corvane.sources.adapters import repositories

    sf = "/root/testdata/sf0.001"
    corpus, asked = repositories(spark, sf), requests(spark, sf)
    alive = filters.apply_filters(corpus, filters.SearchFilters())
    index = lanes.build_index(corpus, str(tmp_path / "i"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(lanes.fulltext(alive, asked, index=index)) == rows(lanes.fulltext(alive, asked))
    assert rows(lanes.name_match(alive, asked, normalised=True, index=index)) == rows(lanes.name_match(alive, asked, normalised=True))
    # stop words are no lexemes by default
    assert index.postings.where("lexeme in ('the', 'of', 'and')").count() == 0


def test_english_lane_by_brute_force(spark):
    """The lexical lane with its default analyzer against loops over records and requests."""
    from corvane.functions.analyze import analyze
    from corvane.plans.catalog import requests
    from corvane.sources.adapters import repositories

    sf = "/root/testdata/sf0.001"
    corpus = filters.apply_filters(repositories(spark, sf), filters.SearchFilters())
    asked = requests(spark, sf).unionByName(spark.createDataFrame([(900, "the of and", None), (901, "Running databases, the", None)], "query_id bigint, query string, vector array<float>"))
    records = [(r.id, r.stars, " ".join(filter(None, [r.full_name.replace("/", " ").replace("_", " "), " ".join(r.topics), r.primary_language, r.description])), r.readme or "") for r in corpus.collect()]
    texts = [(i, stars, set(analyze(light)), set(analyze(light + " " + readme[:2500]))) for i, stars, light, readme in records]
    want = set()
    for q in asked.collect():
        lexemes = sorted(set(analyze(q.query)))
        slots, found = set(lexemes[:8]), []
        for i, stars, light, full in texts:
            own = len(slots & light)
            if lexemes and (own >= min(2, len(slots)) or full >= set(lexemes)):
                found.append((-own, -stars, i))
        want |= {(q.query_id, i, -own, k + 1) for k, (own, _, i) in enumerate(sorted(found)[:20])}
    got = {(r.query_id, r.repo_id, r.coverage, r.rnk) for r in lanes.fulltext(corpus, asked, k=20).collect()}
    assert got == want and not any(g[0] == 900 for g in got)


def test_names_by_rarest_trigrams(spark, tmp_path):
    """Names that all have the same trigrams, other scripts, marks, short and empty names: the scores of every pair, with and without an index,
    and no long name is looked up by a trigram that all names have."""
    from corvane.functions.text import trigrams

    rng = random.Random(12)
    parts = ["doc", "docs", "data", "db", "graph", "ql", "ña", "日本", "x", "tool", "kit", "-", "_", "."]
    names = sorted({"doc-" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(300)} | {"", "-x", "a", "日本", "doc"})
    corpus = spark.createDataFrame([(f"r{i}", f"{rng.choice('ab')}/{n}", n, i) for i, n in enumerate(names)], "id string, full_name string, name string, stars bigint")
    asked = [*rng.sample(names, 25), "doc", "d", "-", "graphql doc", "one two three", "a/doc-x", "日", "docdata", " ", "%", "zzz"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    pairs = corpus.select("id", "name", "full_name", trigrams(F.col("name")).alias("tn")).crossJoin(queries.withColumn("q", F.lower(F.trim("query"))).withColumn("tq", trigrams(F.col("q"))))
    want = {}
    for r in pairs.collect():
        if not r.q:
            continue
        both = len(set(r.tn) & set(r.tq))
        union = len(r.tn) + len(r.tq) - both
        near, exact, begins = both / union if union else 0.0, r.q in (r.name.lower(), r.full_name.lower()), r.name.lower().startswith(r.q)
        if exact or begins or (len(r.q.split()) <= 2 and near >= 0.3):
            want[r.query_id, r.id] = round(max(1.0 * exact, 0.7 * begins, near), 5)
    index = lanes.build_index(corpus.withColumns({"topics": F.array().cast("array<string>"), "primary_language": F.lit("en"), "description": F.lit(""), "readme": F.lit("")}), str(tmp_path / "names"))
    for use in (None, index):
        found = lanes.name_scores(corpus, queries, index=use).collect()
        assert {(r.query_id, r.repo_id): round(r.score, 5) for r in found} == want and len(found) == len(want)
    common = {r.t for r in index.counts.where(f"df > {len(names) * 0.9}").collect()}
    # a name of 14 trigrams has to share five with any other; so the four that all have come last and join nothing
    assert len(common) == 4 and index.grams.where("n >= 14").count() and not index.grams.where("n >= 14").where(F.col("t").isin(sorted(common))).count()


def test_names_are_never_broadcast(spark, tmp_path):
    """Names in a small file may be many: no join sends a table that is made of them to the driver."""
    path = str(tmp_path / "names")
    spark.sql("SELECT concat('r', id) AS id, concat('a/n', id) AS full_name, concat('n', id) AS name, id AS stars FROM range(2000)").write.parquet(path)
    asked = spark.createDataFrame([(1, "n12")], "query_id int, query string")
    found = lanes.name_scores(spark.read.parquet(path), asked)
    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(plan):
        if "BroadcastHashJoin" in line and "[t#" not in line:
            side = [i for i in range(at + 1, len(plan)) if depth(plan[i]) == depth(line) + 3][: 2]["BuildRight" in line]
            below = [x for x in plan[side + 1 :]]
            end = next((i for i, x in enumerate(below) if depth(x) <= depth(plan[side])), len(below))
            assert not any("FileScan" in x for x in below[:end]), line
    assert [r.repo_id for r in found.where("exact").collect()] == ["r12"]


def test_pairs_leave_out_the_commonest_lexeme(spark, tmp_path):
    """A lexeme that all records have forms no pairs, and members, lifted records and counts are those of loops over all pairs."""
    from corvane.functions import text

    rng = random.Random(21)
    pool = ["ash", "birch", "cedar", "elm", "fir", "gum", "hazel", "ivy", "kapok", "larch"]
    some = lambda n: " ".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    records = [(f"d{i}", f"o/doc-{i}", f"doc-{i}", some(3), some(4), i % 7) for i in range(120)]
    corpus = spark.createDataFrame(records, "id string, full_name string, name string, description string, readme string, stars bigint").withColumns({"topics": F.array().cast("array<string>"), "primary_language": F.lit("en")})
    notes = {f"d{i}": some(5) for i in range(0, 120, 3)} | {"gone": "doc ash"}
    terms = spark.createDataFrame([(k, sorted(set(v.split()))) for k, v in notes.items()], "repo_id string, terms array<string>")
    asked = ["doc 7", "doc", "ash", "ash birch", "doc zzz", "zzz", "", "ash birch cedar doc", " ".join(pool), "zzz yyy", *[some(4) for _ in range(12)]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    plain, lifted, counts = set(), set(), {}
    for q, words in enumerate(asked):
        lexemes = sorted(set(words.split()))
        slots = set(lexemes[:8])
        for i, full_name, _, description, readme, _ in records:
            light = {*full_name.replace("-", "/").split("/"), "en", *description.split()}
            own, extra = len(slots & light), set(notes.get(i, "").split())
            member = bool(lexemes) and (own >= min(2, len(slots)) or {*light, *readme.split()} >= set(lexemes))
            plain |= {(q, i, own)} if member else set()
            lifted |= {(q, i, own, len(slots & extra - light), member)} if member or (lexemes and extra >= set(lexemes)) else set()
            if own:
                counts[q] = counts.get(q, 0) + 1
    index = lanes.build_index(corpus, str(tmp_path / "i"), text.words)
    for use in (None, index):
        found = lanes.coverage(corpus, queries, analyze=text.words, index=use).collect()
        assert {(r.query_id, r.repo_id, r.own) for r in found if r.member} == plain
        assert len([r for r in found if r.query_id == 0]) == 1 and len([r for r in found if r.query_id == 4]) == 0
        found = lanes.coverage(corpus, queries, terms, text.words, use).where("member or whole_in_terms").collect()
        assert {(r.query_id, r.repo_id, r.own, r.extra, r.member) for r in found} == lifted and len(found) == len(lifted)
        assert {r.query_id: r.n for r in lanes.any_term(corpus, queries, text.words, use).collect()} == counts


def test_best_names_are_those_of_all_scores(spark):
    """The name lane gives the first k of all scored pairs at any batch size, by stars and id where scores are equal, and sends no
    more than k rows of a query from a task."""
    rng = random.Random(31)
    parts = ["doc", "docs", "ql", "ña", "日本", "x", "kit", "-", "_", ".", "7", "17"]
    names = ["doc-" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) for _ in range(700)] + ["", "-", "日本", None]
    stars = [rng.choice([1, 2, 3, None]) for _ in names]
    corpus = spark.createDataFrame([(f"r{i}", n and f"{rng.choice('ab')}/{n}", n, s) for i, (n, s) in enumerate(zip(names, stars, strict=True))], "id string, full_name string, name string, stars bigint").repartition(3)
    asked = [*[n for n in names[:20]], "doc", "d", "-", "doc-17", "one two three", "doc kit x", "a/doc-x", "日", "dockit", " ", "%", "docql", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for normalised in (False, True):
        scores = lanes.name_scores(corpus, queries, normalised)
        want = {(r.query_id, r.repo_id): (r.score, r.rnk) for r in lanes.best_of(scores, [F.desc("score"), F.desc("stars"), F.asc("repo_id")], 9).collect()}
        for rows in ("64", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            found = lanes.name_match(corpus, queries, 9, normalised)
            assert {(r.query_id, r.repo_id): (r.score, r.rnk) for r in found.collect()} == want
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and found.schema["query_id"].dataType.simpleString() == "int"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_descriptions_are_made_by_all_cores(spark):
    """Parts of a single small file are dealt to as many tasks as there are cores, at least."""
    from corvane.plans import catalog

    found = catalog.queries()["min05_descriptions"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
