"""Language-model scores, ranked search and collocations against plain versions."""

import random
import tracemalloc
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from corvane.llm import attention, collocations, language_model, lexical
from corvane.llm.coded import code
from corvane.llm.tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {k: x.astype(np.float64) + rng.standard_normal(x.shape) * 0.1 for k, x in attention.fresh(70).items()}
    tokens, ends = rng.integers(0, 70, 100), np.array([40, 43, 100])
    inputs, targets, first, _ = attention.layout(tokens, ends, len(p["embed"]) - 1)
    _, g = attention.gradients(p, inputs, targets, first)
    for name, x in p.items():
        for _ in range(3):
            at, step = tuple(rng.integers(0, n) for n in x.shape), 1e-4
            sides = []
            for by in (step, -2 * step):
                x[at] += by
                sides.append(attention.gradients(p, inputs, targets, first)[0])
            x[at] += step
            assert abs((sides[0] - sides[1]) / (2 * step) - g[name][at]) < 1e-6, name


def test_windows_score_each_token_once():
    """Batches of windows give what position by position gives, whatever the batch and the documents around."""
    rng = np.random.default_rng(1)
    p = {k: x + rng.standard_normal(x.shape).astype(np.float32) * 0.2 for k, x in attention.fresh(300).items()}
    docs = [rng.integers(0, 300, n) for n in (1, 16, 17, 500, 3, 40)]
    got = attention.log_probabilities(p, np.concatenate(docs), np.cumsum([len(d) for d in docs]))
    want = np.concatenate([brute.attention_log_p(p, d.tolist(), attention.STRIDE, attention.class_bounds(300).tolist()) for d in docs])
    assert np.allclose(got, want, atol=1e-3)
    # a model's tokens share one
    total = sum(np.exp(attention.log_probabilities(p, np.array([5, t]), np.array([2]))[1]) for t in range(300))
    assert abs(total - 1) < 1e-3


def test_spelling_is_prefix_free_and_reversible():
    words = ["the", "thé", "zzzzqqqq", "x" * 60, "\xa0a", "中文", "th", "a<|endoftext|>b"]
    entries = language_model.vocabulary(PATH, Counter(dict.fromkeys(words[:2], 3)), 4)
    speller = language_model.Speller(PATH, entries)
    asked = pa.array(["", *words])
    ids, sizes = speller.spell(asked)
    parts = [tuple(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert parts[0] == (speller.end,) and len(set(parts)) == len(parts)
    assert not any(a != b and b[: len(a)] == a for a in parts for b in parts)
    for word, spelled in zip(words[3:], parts[4:], strict=True):
        if word not in ("中文", "th"):
            assert bytes((-2 - entries[i]) // 2 for i in spelled) == word.encode()
    # what is kept gives the same
    kept, hashes = language_model.Spelled(speller), language_model.hashes_of(asked)
    for some in (slice(0, 3), slice(2, 7), slice(0, 9), slice(8, 1, -1)):
        at = np.arange(9)[some]
        got, n = kept.spell(asked.take(pa.array(at)), hashes[at])
        assert [tuple(x.tolist()) for x in np.split(got, np.cumsum(n)[:-1])] == [parts[i] for i in at]


def test_scores_of_odd_rows(odd_frame, no_docs):
    frame = odd_frame.repartition(3)
    got = language_model.score_texts(frame, PATH, steps=20).collect()
    assert len(got) == odd_frame.count()
    docs = rows_of(odd_frame)
    base = brute.base_scores([t for _, t in docs], [held(d) for d, _ in docs])
    want = Counter((d, held(d), *b[:3], round(b[3], 6)) for (d, _), b in zip(docs, base, strict=True))
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    # the score of a text is the sum over its words of what the model gives them
    assert language_model.score_texts(no_docs, PATH, steps=1).collect() == []
    alone = language_model.score_texts(odd_frame.where("doc_id = 5"), PATH, steps=5).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in alone] == [(1, 1, 1)]


def test_no_training_texts(spark):
    ids = [i for i in range(100) if held(i)][:3]
    got = language_model.score_texts(spark.createDataFrame([(i, "some words") for i in ids], "doc_id bigint, text string"), PATH, steps=1).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 3 and all(np.isfinite(r.score) for r in got)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_model.score_texts(docs, PATH, steps=800).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def ranks(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r.rank):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


ITEMS = [(1, "the of WITH and zzz"), (2, ""), (3, None), (4, "same line HERE"), (4, "two"), (5, "nothing-that-is-there qqq"), (6, "é中 中文 12 345"), (7, "the"), (None, "they was"), (8, "x")]


def test_ranks_of_odd_rows(spark, odd_frame, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("score", F.lit("own"))
    want = {k: v for k, v in brute.ranked(rows_of(odd_frame), ITEMS).items() if v}
    for frame in (odd_frame.coalesce(1), odd_frame.repartition(7)):
        assert ranks(lexical.rank_documents(frame, items)) == want
    assert lexical.rank_documents(no_docs, items).collect() == []
    empty = lexical.rank_documents(odd_frame, items.where("false"))
    assert empty.collect() == [] and empty.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_ranks_over_many_blocks(spark, tmp_path):
    """More blocks than the first waves take, many equal documents, and a stored index that is opened again."""
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.randint(1, 40)) if i % 3 else "the same text of all that with these words") for i in range(3000)]
    items = [(k, prose(rng, 12)) for k in range(12)] + [(50, "same text words"), (51, "the")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(60)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    lexical.build_index(frame, str(tmp_path / "index"))
    index = lexical.open_index(spark, str(tmp_path / "index"))
    assert index.blocks.count() > max(lexical.WAVES)
    for k in (10, 3):
        assert ranks(lexical.search(index, asked, k)) == brute.ranked(docs, items, k)


def test_block_heads_bound_every_score():
    block = lexical._Block()
    lengths, doc, term, n = np.array([5, 9, 2]), np.array([0, 0, 1, 2]), np.array([7, 9, 7, 9], np.uint64), np.array([3, 2, 4, 1])
    block.ids, block.lengths, block.doc, block.term, block.n = [3, None, 4], [lengths], [doc], [term], [n]
    _, n_docs, n_terms, head, _, _ = block.written(0)
    hashes, facts = lexical._head(head)
    assert (n_docs, n_terms, hashes.tolist(), facts.tolist()) == (3, 16, [7, 9], [[4, 2], [5, 2], [2, 2]])
    stats = lexical.Statistics(3, 16, np.array([10, 20]))
    for t, d, c in zip((0, 1, 0, 1), doc, n, strict=True):
        assert stats.share(facts[0], facts[1])[t] >= stats.share(np.array([c]), lengths[[d]])[0]


def test_sums_beyond_doubles():
    stats = lexical.Statistics(1, 1, np.array([2**33, 3]))
    held_, shares = np.array([[2**33], [3]]), np.array([[999_999, 1], [1, 999_999]])
    assert stats.sums(shares, held_).tolist() == [[2**33 * 999_999 + 3], [2**33 + 3 * 999_999]]


def tuples(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


def pairs(frame):
    return [(r.lang, r.text) for r in frame.select("lang", "text").collect()]


def test_phrases_of_odd_rows(odd_frame, no_docs):
    for least, best in ((2, 50), (5, 2000)):
        want = brute.collocations(pairs(odd_frame), least, best)
        assert want and tuples(collocations.collocations(odd_frame.repartition(5), best, least)) == want
    assert collocations.collocations(no_docs).collect() == []


@pytest.mark.parametrize("words", [2, 6])
def test_runs_of_a_very_common_word_over_ranges(spark, words):
    """Few words, so that bounds of ranges fall inside the runs of one word and one pair; ties everywhere."""
    rng = random.Random(words)
    names = ["a", "b", "é", "d'", "e", "f"][:words]
    docs = [(rng.choice(["en", "de", None]), " ".join(rng.choice(names) + rng.choice(["", "", "", ",", "\n", "\t"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = tuples(collocations.collocations(frame, 100, 3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute.collocations(docs, 3, 100)


def test_tries_keep_their_leaves():
    rng = np.random.default_rng(3)
    rows, counts = collocations.counted(collocations._runs(np.append(rng.integers(0, 9, 500), [0] * 4)))
    names = [b"w%d" % i for i in range(9)]
    again, leaves, n = collocations.deserialise(collocations.serialise(names, rows, counts))
    text = lambda words, row: [words[k - 1] for k in row if k]
    assert [text(names, r) for r in rows.tolist()] == [text(again, r) for r in leaves.tolist()] and n.tolist() == counts.tolist()
    assert collocations.deserialise(collocations.serialise(names, rows[:0], counts[:0]))[1].shape == (0, 4)


def test_a_shards_runs_are_counted_in_little_memory():
    """The words held and the counting of their runs take at most 70 bytes a position outside of Arrow (135 before)."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 500).clip(0, 30_000)) + (". " if i % 3 else "") for i in range(400)]
    pa.array(texts[:1]).to_pandas()  # what Arrow imports late doesn't count
    tracemalloc.start()
    stream = collocations.Stream()
    for lo in range(0, len(texts), 50):
        stream.add(*code(pa.array(texts[lo : lo + 50]), collocations.TABLE, pieces=True))
    names, rows, counts = stream.leaves()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = Counter()
    for text in texts:
        words = text.replace(".", "").encode().split()
        want.update(tuple(words[i : i + 4]) for i in range(len(words)))
    assert {tuple(names[k - 1] for k in row if k): n for row, n in zip(rows.tolist(), counts.tolist(), strict=True)} == want
    assert names == sorted(names) and rows.tolist() == sorted(rows.tolist())
    assert peak < 70 * stream.n, peak / stream.n
