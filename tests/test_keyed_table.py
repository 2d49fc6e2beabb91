"""Updates folded when read, the commit log, and writers that meet."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from corvane.operators.keyed_table import MAX_UPDATES, Conflict, KeyedTable, Policy

KIND = "k int, part string, a string, b int, t int"


def plain(rows, updates):
    """Rows by (k, part) after each (rows as dicts, policy)."""
    state = {(r["k"], r["part"]): dict(r) for r in rows}
    for changed, policy in updates:
        for r in changed:
            key = r["k"], r["part"]
            if key not in state:
                if not policy.known_only:
                    state[key] = {c: r.get(c) for c in ("k", "part", "a", "b", "t")}
            elif not policy.keep_known and not (policy.order and r["t"] < state[key]["t"]):
                for c in r if policy.columns is None else policy.columns:
                    if c in r:
                        state[key][c] = r[c]
    return {tuple(r.values()) for r in state.values()}


def files(path):
    return {p for p in path.rglob("*.parquet")}


def test_policies_in_turn(spark, tmp_path):
    rng = random.Random(4)
    row = lambda k, names: {"k": k, "part": rng.choice("xy"), **{c: {"a": rng.choice("pqr"), "b": rng.randint(0, 9), "t": rng.randint(0, 50)}[c] for c in names}}
    unique = lambda rows: list({(r["k"], r["part"]): r for r in rows}.values())
    base = unique(row(k, "abt") for k in range(60))
    rounds = [
        (unique(row(rng.randint(0, 80), "abt") for _ in range(20)), Policy(())),
        (unique(row(rng.randint(0, 80), "a") for _ in range(20)), Policy(())),
        (unique(row(rng.randint(0, 90), "ab") for _ in range(20)), Policy((), columns=("b",))),
        (unique(row(rng.randint(0, 120), "abt") for _ in range(30)), Policy((), known_only=True)),
        (unique(row(rng.randint(0, 120), "bt") for _ in range(30)), Policy((), keep_known=True)),
        (unique(row(rng.randint(0, 60), "abt") for _ in range(30)), Policy((), order=("t",))),
    ]
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f for f in KIND.split(", ") if f.split()[0] in rows[0]))
    table = KeyedTable(spark, str(tmp_path / "t"), KIND, ["k", "part"])
    assert table.read().collect() == []
    table.append(frame(base))
    table.compact()
    done = []
    for rows, policy in rounds[:5]:
        # an order by a column that the row may lack is tested with rows that have it
        table.append(frame(rows), policy)
        done.append((rows, policy))
        assert {tuple(r) for r in table.read().collect()} == plain(base, done)
    assert {tuple(r) for r in table.read(1).collect()} == {tuple(r.values()) for r in base}
    before = table.compact()
    assert {tuple(r) for r in table.read().collect()} == plain(base, done) and not before.updates
    filled = table.read().fillna({"t": 0})
    newer = KeyedTable(spark, str(tmp_path / "newer"), KIND, ["k", "part"])
    newer.append(filled)
    newer.append(frame(rounds[5][0]), rounds[5][1])
    assert {tuple(r) for r in newer.read().collect()} == plain([r.asDict() for r in filled.collect()], [rounds[5]])
    table.vacuum()
    assert {tuple(r) for r in table.read().collect()} == plain(base, done) and len(table.log.numbers()) == 1


def test_an_update_writes_what_it_has(spark, tmp_path):
    """Files written follow the updates, and rows of the base that no update touches aren't shuffled."""
    table = KeyedTable(spark, str(tmp_path / "t"), "k bigint, v string", ["k"])
    table.append(spark.range(100_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v")))
    table.compact()
    before = files(tmp_path)
    table.append(spark.createDataFrame([(7, "new"), (200_000, "more")], "k bigint, v string").coalesce(1))
    new = files(tmp_path) - before
    assert len(new) == 1 and sum(p.stat().st_size for p in new) < sum(p.stat().st_size for p in before) / 500
    assert table.read().count() == 100_001 and table.read().where("k = 7").first().v == "new"
    # the last of many appends compacts
    for i in range(MAX_UPDATES + 1):
        table.append(spark.createDataFrame([(i, str(i))], "k bigint, v string"))
    assert len(table.version().updates) < MAX_UPDATES and table.read().where("k < 5").agg(F.sum("v")).first()[0] == 10


def test_two_writers(spark, tmp_path):
    """Both start from one version: one publishes, the other goes behind it; nothing is lost."""
    one, two = (KeyedTable(spark, str(tmp_path / "t"), "k int, v int", ["k"]) for _ in range(2))
    one.append(spark.createDataFrame([(0, 0)], "k int, v int"))
    stale = two.version()
    tried, publish = [], two._publish

    def first_the_other(version):
        if not tried:
            one.append(spark.createDataFrame([(1, 1), (5, 1)], "k int, v int"))
        tried.append(publish(version))
        return tried[-1]

    two._publish = first_the_other
    done = two.append(spark.createDataFrame([(2, 2), (5, 2)], "k int, v int"))
    assert tried == [False, True] and done.number == stale.number + 2
    assert {tuple(r) for r in one.read().collect()} == {(0, 0), (1, 1), (2, 2), (5, 2)}
    workers = [threading.Thread(target=lambda i=i: KeyedTable(spark, str(tmp_path / "t"), "k int, v int", ["k"]).append(spark.createDataFrame([(100 + i, i)], "k int, v int"))) for i in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert {r.k for r in one.read().collect()} == {0, 1, 2, 5, 100, 101, 102, 103}


def test_compactions_that_meet(spark, tmp_path):
    one, two = (KeyedTable(spark, str(tmp_path / "t"), "k int, v int", ["k"]) for _ in range(2))
    for i in range(3):
        one.append(spark.createDataFrame([(i, i)], "k int, v int"))
    written = two._written

    def compacted_meanwhile(rows, kind):
        one.compact()
        return written(rows, kind)

    two._written = compacted_meanwhile
    with pytest.raises(Conflict):
        two.compact()
    assert one.read().count() == 3 and not one.version().updates

    def appended_meanwhile(rows, kind):
        one.append(spark.createDataFrame([(9, 9)], "k int, v int"))
        return written(rows, kind)

    one.append(spark.createDataFrame([(1, 7)], "k int, v int"))
    two._written = appended_meanwhile
    assert len(two.compact().updates) == 1 and {tuple(r) for r in one.read().collect()} == {(0, 0), (1, 7), (2, 2), (9, 9)}


def test_a_batch_that_comes_twice(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k int, v int", ["k"])
    for batch, v in ((0, 1), (1, 2), (1, 3), (0, 4)):
        table.append(spark.createDataFrame([(1, v)], "k int, v int"), writer="w", batch=batch)
    assert [tuple(r) for r in table.read().collect()] == [(1, 2)] and table.version().batches == {"w": 1}
