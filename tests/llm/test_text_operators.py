import random
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import decontaminate, near_dup, quality_rules
from corvane.llm.fm_index import FMIndex, suffix_ranks


def same(rows, want):
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_base_rules(spark, odd_frame, odd_docs, no_docs):
    got = quality_rules.judge(odd_frame).collect()
    want = [(d[0], *brute.base_counts(d[1])) for d in odd_docs]
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], want)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(no_docs).count() == 0 and quality_rules.clean(no_docs).columns == no_docs.columns


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "A", "é"]), max_size=40))
def test_repeated_words(spark, words):
    text = " ".join(words)
    got = spark.createDataFrame([(1, text, "s")], "doc_id bigint, text string, source string")
    assert quality_rules.base_rules(got).first().n_repeat_words == brute.base_counts(text)[4]


def test_line_frequency(spark):
    rng = random.Random(2)
    text = lambda i: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(60)) + f" own{i}"
    rows = [(i, f"{text(i)}\nBoiler   plate line {i % 10}", "h") for i in range(60)]
    rows += [(100 + i, "Boiler plate line 1\n" + "\n".join(" ".join(f"{k}x{j}y" for j in range(9)) for k in "abcdefg"), "h") for i in range(3)]
    rows += [(200 + i, "\n".join(" ".join(f"{k}x{j}y" for j in range(9)) for k in "abcdefg") + f"\nx{i}", "h") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(df, line_docs=20).collect()}
    assert all(got[i].kept and got[i].removed_words == (0 if i == 0 else 4) for i in range(60))
    # one of the documents made of common lines keeps them; the others are depleted
    assert [i for i in got if i >= 100 and got[i].kept] == [100]
    cleaned = {r.doc_id: r.text for r in quality_rules.clean(df, 20).collect()}
    assert "Boiler" in cleaned[0] and "Boiler" not in cleaned[1] and set(cleaned) == {*range(60), 100}
    # copies are documents too: over the limit the lowest stays, up to it all do, and rows that share a doc_id are one document
    copies = [(i, rows[0][1], "h") for i in range(50)]
    kind = "doc_id bigint, text string, source string"
    assert [r.doc_id for r in quality_rules.judge(spark.createDataFrame(copies, kind), 20).where("kept").collect()] == [0]
    assert quality_rules.judge(spark.createDataFrame(copies[:20], kind), 20).where("kept").count() == 20
    assert quality_rules.judge(spark.createDataFrame([(7, *c[1:]) for c in copies] + copies[:19], kind), 20).where("kept").count() == 69


def test_line_count_on_a_large_host(spark):
    """A passage in a few dozen documents is found however many texts its host has."""
    import corpus_pipeline

    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    passage = "this passage stands in a few dozen documents"
    rows = [(i, " ".join(rng.choices(words, k=60)) + (f"\n{passage}" if i < 30 else ""), "hot") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.removed_words for r in quality_rules.judge(df).where("removed_words > 0").collect()}
    assert got == {i: 8 for i in range(1, 30)}
    staged = corpus_pipeline.quality_stage(spark, df, "")
    assert [r.doc_id for r in staged.where(F.col("text").contains(passage)).collect()] == [0] and staged.count() == 4000


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (10, "short item"), (2, ""), (3, None), (None, "null item"), (4, "... !!"), (5, "short item")]


def test_decontamination(spark, odd_frame, odd_docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    hit = " ".join(f"{w}," for w in ITEMS[0][1].upper().split())
    extra = [(300, f"before it {hit} and after", None, None), (301, "a Short-item here", None, None), (302, ITEMS[0][1] + " " + ITEMS[0][1], None, None), (303, ITEMS[0][1][:50], None, None), (302, "short item", None, None)]
    docs = [(d[0], d[1]) for d in [*odd_docs, *extra]]
    df = odd_frame.select("doc_id", "text", "sig").unionByName(spark.createDataFrame([e[:2] for e in extra], "doc_id bigint, text string"), allowMissingColumns=True)
    want = brute.contamination(docs, [i for i in ITEMS if i[0] is not None])
    same([tuple(r) for r in decontaminate.contamination_report(df, bench).collect()], want)
    small = decontaminate.find_contamination(df, bench, shard_words=50).select("doc_id", "n_words", F.size("spans").alias("n"), "items")
    blocks = decontaminate.find_contamination(df, bench, phrase_bytes=20).select("doc_id", "n_words", F.size("spans").alias("n"), "items")
    whole = decontaminate.find_contamination(df, bench).select("doc_id", "n_words", F.size("spans").alias("n"), "items")
    same(small.collect(), whole.collect())
    same(blocks.collect(), whole.collect())
    cut = {r.doc_id: r.text for r in decontaminate.remove_contamination(df.where("doc_id in (0, 300, 301)"), bench).collect()}
    assert cut[300] == "before it , and after" and cut[301] == "a  here" and cut[0] == odd_docs[0][1]
    assert decontaminate.contamination_report(no_docs, bench).count() == 0
    none = decontaminate.contamination_report(df, bench.where("false"))
    assert none.where("n_hit > 0 or n_items > 0 or contaminated").count() == 0 and none.count() == len(docs)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=5))
def test_fm_index(symbols, phrases):
    text = np.array([0, *symbols, 0], np.int32)
    place = np.cumsum(text == 0)
    order = sorted(range(len(text)), key=lambda i: [(int(x), int(place[i + k]) if x == 0 else 0) for k, x in enumerate(text[i:])])
    assert suffix_ranks(text)[order].tolist() == list(range(len(text)))
    index = FMIndex(text, 4)
    rows = np.zeros((len(phrases), 4), np.int64)
    for i, p in enumerate(phrases):
        rows[i, 4 - len(p) :] = p
    lo, hi = index.search(rows, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def near_copies(n, edits, seed):
    rng = random.Random(seed)
    base = [f"b{rng.randint(0, 400)}" for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd_frame, odd_docs, no_docs, width, percent):
    rng = random.Random(8)
    texts = near_copies(150, 8, 1) + near_copies(12, 3, 2) + [" ".join(f"w{rng.randint(0, 30)}" for _ in range(40)) for _ in range(60)]
    texts += ["pass age shared by all of these many documents " * 3 + f"own{i} text{i} of{i} mine{i}" for i in range(60)]
    docs = [(1000 + i, t) for i, t in enumerate(texts)] + [(1000, texts[3]), (1500, texts[0])]
    more = spark.createDataFrame(docs, "doc_id bigint, text string")
    df = odd_frame.unionByName(more, allowMissingColumns=True)
    got = near_dup.near_duplicates(df, width, percent).collect()
    known = [(d[0], d[1]) for d in odd_docs if d[0] is not None] + docs
    want = brute.components(known, width, percent)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None], want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Crowds dealt out as many pairs of blocks give the same components."""
    for name, value in (("BLOCK", 16), ("CROWD_BLOCK", 16), ("NODE_LIMIT", 8)):
        monkeypatch.setattr(near_dup, name, value)
    docs = list(enumerate(near_copies(120, 9, 5)))
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 85).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], brute.components(docs, 3, 85))
    assert Counter(r.kept for r in got)[True] < 120


def test_a_crowd_is_not_opened(spark, monkeypatch):
    """Children are made only of nodes that they part: a crowd of near copies is compared as it is."""
    for name, value in (("BLOCK", 64), ("CROWD_BLOCK", 64), ("NODE_LIMIT", 8)):
        monkeypatch.setattr(near_dup, name, value)
    made, write = Counter(), near_dup.materialize

    def counted(df, name, path=None):
        out = write(df, name, path)
        made[name.split("_")[0]] += out.count()
        return out

    monkeypatch.setattr(near_dup, "materialize", counted)
    docs = list(enumerate(near_copies(400, 5, 7)))
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 85).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], brute.components(docs, 3, 85))
    assert made["level"] > 3000 and made["children"] <= 400


@pytest.mark.parametrize("rule, groups, most", [("a.cid % 3 = b.cid % 3", 3, 12_000), ("abs(a.cid - b.cid) = 1", 1, 12_000), ("a.cid < 0", 500, 12_000), ("least(a.cid, b.cid) > 0", 2, 1200)])
def test_large_groups_in_two_rounds(spark, rule, groups, most):
    """Cliques, a chain, no links and one clique of 499 among 500 members in 20 blocks: no link is lost, and one clique costs about two transfers, not 20."""
    dealt = []

    def compare(rows):
        dealt.append(rows.count())
        pairs = rows.alias("a").join(rows.alias("b"), F.expr(f"a.grp = b.grp and a.i = b.i and a.j = b.j and a.cid < b.cid and {rule}"))
        return pairs.select(F.col("a.cid").alias("u"), F.col("b.cid").alias("v"))

    rows = spark.range(500).selectExpr("7L as grp", "id as cid", "500L as m", "20 as blocks", "'x' as payload")
    found = {r.node: r.component for r in near_dup._linked(rows, "grp", "payload", compare).collect()}
    assert len({found.get(i, i) for i in range(500)}) == groups
    assert all(found.get(i, i) <= i for i in range(500)) and sum(dealt) <= most


def test_one_document_of_each_group(spark, odd_frame, no_docs):
    """Rows that share a doc_id are told apart by their texts; of alike rows one stays, and no differing text is lost."""
    a, b, c, d = near_copies(1, 0, 3) + near_copies(1, 0, 4) + near_copies(1, 0, 5) + near_copies(1, 0, 6)
    rows = [(1, a, "1a"), (1, b, "1b"), (2, a, "2a"), (None, a, "na"), (None, c, "nc"), (3, d, "3d"), (3, d, "3d again"), (4, None, "4"), (4, "", "4e"), (5, a + " end", "5a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, own_id string")
    got = sorted(r.own_id for r in near_dup.keep_one(df).collect())
    assert got in (["1b", "2a", "3d", "4", "4e", "nc"], ["1b", "2a", "3d again", "4", "4e", "nc"])
    assert near_dup.keep_one(no_docs).columns == no_docs.columns and near_dup.keep_one(no_docs).count() == 0
    assert near_dup.keep_one(odd_frame).columns == odd_frame.columns
    many = spark.range(3000).selectExpr("7L as doc_id", "'a text of some words that all share' as text")
    assert near_dup.keep_one(many).count() == 1


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_recall_just_above_the_threshold(spark, width, percent):
    """400 pairs whose sets are within 0.02 of the threshold: the trees and sketches together find all of them."""
    rng, docs = random.Random(percent), []
    while len(docs) < 800:
        w = [f"p{rng.randint(0, 10**6)}" for _ in range(180)]
        x = list(w)
        for k in rng.sample(range(180), rng.randint(2, 9)):
            x[k] = f"q{k}"
        s, t = brute.shingles(" ".join(w), width), brute.shingles(" ".join(x), width)
        if 0 <= 100 * len(s & t) / len(s | t) - percent <= 2:
            docs += [(len(docs), " ".join(w)), (len(docs) + 1, " ".join(x))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), width, percent).collect()}
    assert sum(got[i + 1] == i for i in range(0, 800, 2)) == 400


def test_phrases():
    items = [("b", "one two three"), ("a", "two three four " * 7), ("b", "one two three"), ("c", None), ("d", "..")]
    p = decontaminate.Phrases(items, 3)
    back = {v: k.decode() for k, v in p.codes.items()}
    found = {tuple(back[c] for c in row if c): [p.names[i] for i in p.owned_by(w)] for w, row in enumerate(p.rows.tolist())}
    assert found == {("one", "two", "three"): ["b"], ("two", "three", "four"): ["a"], ("three", "four", "two"): ["a"], ("four", "two", "three"): ["a"]}
    assert len(decontaminate.Phrases([], 3).rows) == 0
