from datetime import datetime

import pytest

from corvane import schema
from corvane.sources import json_sources, paged
from corvane.streaming import incremental


def pages(fragment, cursor):
    n = int(cursor or 0)
    return {"nodes": [f'{{"id": "{fragment}{n}", "nameWithOwner": "o/{fragment}{n}", "stargazerCount": {n}}}'], "next": str(n + 1) if n < 2 else None}


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    rows = spark.read.format("corvane_paged").option("fragments", "a|b").option("fetch", "test_sources.pages").load()
    got = json_sources.flatten_nodes(rows).orderBy("id").collect()
    assert [r.id for r in got] == ["a0", "a1", "a2", "b0", "b1", "b2"] and got[0].topics == [] and got[2].stars == 2


def test_limiter():
    now, slept = [100.0], []
    lim = paged.RateLimiter(clock=lambda: now[0], sleep=slept.append)
    lim.update_from_headers({"X-RateLimit-Remaining": "10", "x-ratelimit-reset": "160"})
    lim.acquire()
    assert slept == [60.0]
    lim.update(5000, 160)
    lim.pause(30)
    lim.pause(5)
    assert lim.wait_time() == 30
    replies = [paged.Response(500), paged.Response(429, headers={"Retry-After": "7"}), paged.Response(200, "ok")]
    assert paged.with_retries(lambda: replies.pop(0), lim).body == "ok"


def flaky(fragment, cursor):
    """Fragment b is refused on its second page, c never ends."""
    n = int(cursor or 0)
    if fragment == "b" and n == 1:
        return paged.Response(403, "no")
    if fragment == "e":
        return paged.Response(200, {"errors": ["x"]})
    if fragment == "n":
        raise TimeoutError("late")
    return paged.Response(200, {"nodes": [f'{{"id": "{fragment}{n}"}}'], "next": str(n + 1) if fragment == "c" or n < 1 else None})


def test_how_each_fragment_ended(spark):
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("corvane_paged").option("fragments", "a|b|c|e|n").option("fetch", "test_sources.flaky").option("backoff_seconds", "0").option("retries", "2")
    got = {r.fragment: (r.outcome.split(":")[0], r.n) for r in paged.outcomes(read.option("deadline_seconds", "0.2").load()).collect()}
    assert got["a"] == ("done", 2) and got["b"] == ("aborted", 1) and got["e"] == ("aborted", 0) and got["n"] == ("aborted", 0)
    assert got["c"][0] == "deadline" and got["c"][1] > 0


def test_retries_and_limits():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    lim = paged.RateLimiter(clock=lambda: now[0], sleep=sleep)
    second = paged.Response(403, "You have exceeded a secondary rate limit")
    replies = [second, second, second, second, paged.Response(200)]
    assert paged.with_retries(lambda: replies.pop(0), lim).status == 403 and slept == [60.0, 120.0, 240.0]
    slept.clear()
    errors = [ConnectionError("x"), TimeoutError("y"), paged.Response(200, "ok")]

    def call():
        e = errors.pop(0)
        if isinstance(e, Exception):
            raise e
        return e

    assert paged.with_retries(call, lim).body == "ok" and slept == [1.0, 2.0]
    assert paged.with_retries(lambda: paged.Response(403, "denied"), lim).status == 403
    slept.clear()
    assert paged.with_retries(lambda: paged.Response(429, headers={"retry-after": "soon"}), lim, retries=1).status == 429 and slept == [60.0]


def readme_of(name):
    bodies = {
        "o/a": {"encoding": "base64", "content": "ICMgVGl0bGUgCg=="}, "o/b": {"content": "", "download_url": "big"}, "o/c": {"encoding": "utf-8", "content": "x"},
        "o/d": {"encoding": "base64", "content": "aGVsbG8ggCB3b3JsZA=="}, "o/e": {"content": "", "download_url": "gone"}, "o/f": {"encoding": "base64", "content": "a"},
    }
    if name == "o/g":
        raise ConnectionResetError("down")
    return paged.Response(200, bodies[name])


def raw_of(url):
    return paged.Response(200, b"y" * 300_000) if url == "big" else paged.Response(500)


def test_readme_payloads(spark):
    repos = spark.createDataFrame([(x, f"o/{x}") for x in "abcdefg"], "id string, full_name string")
    got = {r.id: (r.readme_status, r.readme) for r in paged.fetch_readmes(repos, readme_of, raw_of, backoff=0.0).collect()}
    assert got == {"a": ("ok", "# Title"), "b": ("ok", "y" * 8192), "c": ("error", None), "d": ("ok", "hello \ufffd world"), "e": ("error", None), "f": ("error", None), "g": ("error", None)}


def test_package_endpoints():
    assert paged.endpoint("packages", "github.com/a/b") == "projects/github.com%2Fa%2Fb:packageversions"
    assert paged.endpoint("dependents", "NPM", "@a/b", "1.0") == "systems/NPM/packages/%40a%2Fb/versions/1.0:dependents"


def fetch(name):
    return {"o/a": paged.Response(200, "  text "), "o/b": paged.Response(404), "o/c": paged.Response(200, "\n"), "o/d": paged.Response(403)}[name]


def test_readmes_and_embedding(spark):
    repos = spark.createDataFrame([(x, f"o/{x}") for x in "abcd"], "id string, full_name string")
    got = {r.id: (r.readme_status, r.readme) for r in paged.fetch_readmes(repos, fetch).collect()}
    assert got == {"a": ("ok", "text"), "b": ("not_found", None), "c": ("empty", None), "d": ("error", None)}
    rows = paged.embed(repos, "full_name", lambda: paged.hashing_encoder(8), 8).collect()
    assert all(len(r.embedding) == 8 for r in rows)
    with pytest.raises(Exception, match="dimension 9"):
        paged.embed(repos, "full_name", lambda: paged.hashing_encoder(8), 9).collect()


def test_files(spark, tmp_path):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, doc string, rank int")
    json_sources.write_run(run, str(tmp_path / "run"), "s")
    assert spark.read.json(str(tmp_path / "run")).first().docs == ["a", "b"]
    (tmp_path / "r.json").write_text('{"system": "s", "results": {"q": ["a", "b"]}}')
    assert [(r.doc, r.rank) for r in json_sources.run_file(spark, str(tmp_path / "r.json")).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    (tmp_path / "j.json").write_text('{"judgments": {"q": {"a": {"grade": 2}}}}')
    assert json_sources.judgments(spark, str(tmp_path / "j.json")).first()[:] == ("q", "a", 2)
    (tmp_path / "q.json").write_text('{"queries": [{"id": "1", "query": "x", "stratum": "task"}]}')
    assert json_sources.query_set(spark, str(tmp_path / "q.json")).first().query == "x"


def test_schemas(spark, tmp_path):
    root = str(tmp_path / "db")
    schema.create(spark, root)
    assert schema.read(spark, root, "repositories").count() == 0
    bad = spark.createDataFrame([("a", "llm"), ("a", "llm"), ("b", "odd")], "repo_id string, source string")
    assert {r.rule: r.n for r in schema.violations(bad, "repository_enrichment").collect()} == {"key": 1, "source": 1}
    with pytest.raises(ValueError):
        schema.reset(spark, root, "elsewhere")
    schema.reset(spark, root, root)


def test_incremental(spark, tmp_path):
    src, kind = str(tmp_path / "src"), "k int, t int, v string"
    snaps = incremental.Snapshots(spark, str(tmp_path / "snaps"), kind)
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], kind).coalesce(1).write.mode("append").parquet(src)
    run = lambda: incremental.ingest(spark, src, kind, snaps, ["k"], ["t"], str(tmp_path / "cp"))
    run()
    spark.createDataFrame([(1, 3, "c"), (2, 0, "late"), (3, 1, "d")], kind).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(tuple(r) for r in snaps.current().collect()) == [(1, 3, "c"), (2, 1, "b"), (3, 1, "d")]
    # a version that was not written to its end is passed over
    (tmp_path / "snaps" / "log" / "_0f").write_text("{")
    assert snaps.current().count() == 3
    # a batch wrote its own rows alone, and one that comes again counts once
    assert len([p for p in (tmp_path / "snaps").iterdir() if p.name.startswith("update-")]) == 2
    again = snaps.fold(spark.createDataFrame([(9, 9, "z")], kind), ["k"], ["t"], 0, writer="w")
    assert snaps.fold(spark.createDataFrame([(9, 10, "y")], kind), ["k"], ["t"], 0, writer="w") == again and snaps.current().where("k = 9").first().v == "z"
    mark, started = str(tmp_path / "mark"), datetime(2024, 1, 2, 3)
    assert incremental.read_watermark(spark, mark) is None
    assert not incremental.advance_watermark(spark, mark, started, 1, False)
    assert incremental.advance_watermark(spark, mark, started, 0, False) and incremental.read_watermark(spark, mark) == started
    # never back, and a run that another overtakes while it publishes gives way to the later start
    later = datetime(2024, 3, 1)
    assert incremental.advance_watermark(spark, mark, later, 0, False) and incremental.advance_watermark(spark, mark, started, 0, False)
    assert incremental.read_watermark(spark, mark) == later


def test_joins_of_tables_dealt_alike(spark, tmp_path):
    """No join of records and side tables exchanges rows, and a label's condition reads its folders alone."""
    from corvane.sources import colocated

    records = spark.range(500).selectExpr("concat('r', id) AS repo_id", "id AS stars")
    vectors = spark.range(700).selectExpr("concat('r', id) AS repo_id", "CASE WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS model_name", "array(1.0) AS embedding")
    side = spark.range(100, 900).selectExpr("concat('r', id) AS repo_id", "id AS dependent_count")
    stored = colocated.store(spark, {"records": (records, None), "vectors": (vectors, "model_name"), "signals": (side, None), "enrichment": (side.select("repo_id"), None)}, str(tmp_path / "t"), 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are large on both sides
    try:
        found = {"vectors_of": colocated.vectors_of(stored, "b"), "without_vector": colocated.without_vector(stored, "b"), "with_signals": colocated.with_signals(stored), "unexplained": colocated.unexplained(stored)}
        assert {n: f.count() for n, f in found.items()} == {"vectors_of": 167, "without_vector": 333, "with_signals": 500, "unexplained": 100}
        for name, frame in found.items():
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" in plan, name
            if name in ("vectors_of", "without_vector"):
                assert "PartitionFilters: [isnotnull(model_name" in plan
        assert found["with_signals"].where("stars < 100").agg({"dependent_count": "max"}).first()[0] == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        colocated.drop(stored)


def test_latest_by_state(spark, tmp_path):
    """State lives between batches and runs: rows, counts and late rows are those of all files in their order."""
    from corvane.streaming.stateful import latest_by_state

    kind = "k bigint, t bigint, v string"
    src = tmp_path / "src"
    batches = [[(1, 5, "a"), (2, 1, "b")], [(1, 3, "late"), (2, 4, "c"), (3, 1, "d")], [(1, 9, "e"), (1, 8, "f"), (2, 2, "late")]]

    def run(files):
        for rows in files:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(src))
        return latest_by_state(spark, str(src), spark.createDataFrame([], kind).schema, str(tmp_path / "table"), ["k"], ["t"], str(tmp_path / "cp"), max_files=1)[1]

    assert sorted(tuple(r) for r in run(batches[:1]).read().collect()) == [(1, 5, "a", 1, 0), (2, 1, "b", 1, 0)]
    table = run(batches[1:])
    want = [(1, 9, "e", 4, 1), (2, 4, "c", 3, 1), (3, 1, "d", 1, 0)]
    assert sorted(tuple(r) for r in table.read().collect()) == want
    assert sorted(tuple(r) for r in run([]).read().collect()) == want and len(table.version().updates) == 3


def test_latest_handles_many_keys_at_once():
    """Python is called for a group of keys, not for each: counts, late rows and the first of rows alike in order are those of row by row."""
    import random

    import pandas as pd
    from pyspark.sql.types import StructType

    from corvane.streaming.stateful import Latest

    class State(dict):
        def getMapState(self, *_):  # noqa: N802
            return self

        def getValue(self, key):  # noqa: N802
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

    rng, state, want = random.Random(3), State(), {}
    one = Latest(["k", "l"], ["t", "u"], StructType.fromDDL("k bigint, l string"), StructType.fromDDL("t string, u bigint, v bigint, n_rows bigint, n_late bigint"))
    one.init(state)
    for batch in range(3):
        rows = [(rng.randint(0, 40), rng.choice("ab"), rng.choice("pqrs"), rng.randint(0, 3), i + 1000 * batch) for i in range(300)]
        at = {k: r[:2] for k, r in want.items()}
        for k, l, t, u, v in rows:
            row = want.get((k, l))
            n, late = (row[3], row[4]) if row else (0, 0)
            best = row[:3] if row and not (t, u) > row[:2] else (t, u, v)
            want[k, l] = (*best, n + 1, late + ((k, l) in at and (t, u) < at[k, l]))
        frame = pd.DataFrame(rows, columns=["k", "l", "t", "u", "v"])
        (out,) = one.handleInputRows((7,), iter([frame[:120], frame[120:120], frame[120:]]), None)
        assert sorted(out.itertuples(index=False, name=None)) == sorted((*k, *want[k]) for k in {r[:2] for r in rows})
        assert state == want


def test_encoder_gives_every_text_a_direction():
    """Words whose signs cancel out, and texts of breaks alone, have unit length; empty texts and spaces have none."""
    encode = paged.hashing_encoder(32)
    pairs = [f"a{i} b{j}" for i in range(40) for j in range(40)]
    norms = (encode([*pairs, "\n", "\t\t", "", "  ", " "]) ** 2).sum(axis=1)
    assert abs(norms[: len(pairs) + 2] - 1).max() < 1e-5 and not norms[len(pairs) + 2 :].any()


def test_readmes_are_sent_on_by_bytes():
    """Large files in one batch of records are not held together, and no record is lost."""
    import pandas as pd

    from corvane.sources import paged

    class Taken:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            raise StopIteration(run)

    raw = paged.Response(200, b"x" * paged.RAW_BYTES)
    try:
        paged.fetch_readmes(Taken(), lambda _: paged.Response(200, {"content": "", "download_url": "u"}), lambda _: raw, backoff=0.0)
    except StopIteration as e:
        run = e.value
    names = [f"r{i}" for i in range(200)]
    parts = [(list(p["id"]), p["body"].str.len().sum()) for p in run(iter([pd.DataFrame({"id": names, "full_name": names})]))]
    assert [i for ids, _ in parts for i in ids] == names
    assert max(size for _, size in parts) <= (4 << 20) + paged.RAW_BYTES
