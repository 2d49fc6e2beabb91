import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import language_id, quality_classifier, toxicity
from corvane.llm._common import bounded_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(rows, labels, column):
    found = rows.where("held_out").join(labels, "doc_id").select(column, "score", "predicted").collect()
    pos, neg = [r.score for r in found if r[0] == 1], [r.score for r in found if r[0] == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    return auc, sum(r[0] == r.predicted for r in found) / len(found)


def test_quality_on_held_out_documents(tables):
    auc, accuracy = held_out(quality_classifier.classify(*tables), tables[1], "quality")
    assert auc > 0.97 and accuracy > 0.93


def test_toxicity_on_held_out_documents(tables):
    auc, accuracy = held_out(toxicity.classify(*tables), tables[1], "toxic")
    assert auc > 0.8 and accuracy > 0.85


def test_toxicity_with_more_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    auc, accuracy = held_out(toxicity.classify(docs, labels), labels, "toxic")
    assert auc > 0.9 and accuracy > 0.95


def test_unseen_misspelling(spark, tables):
    model = toxicity.train(*tables)
    seed = "Anat with by of nteres atre are the thnt eringing onheed with erenenst thaner ing tionha and "
    df = spark.createDataFrame([(1, seed + "patheticc"), (2, seed + "pathetik"), (3, seed)], "doc_id bigint, text string")
    s = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert min(s[1], s[2]) > 2 * s[3]


def test_long_tokens_are_scored_whole(spark, tables):
    words = "Anat with by of nteres atre are the thnt eringing onheed with erenenst thaner ing tionha and".split() * 8
    glued = "/".join(words)
    marked = f"<{glued.lower()}>"
    grams = {xxhash.xxh32_intdigest(marked[i : i + n]) % toxicity.BUCKETS for n in toxicity.NGRAMS for i in range(len(marked) - n + 1)}
    assert grams <= {int(b) for w in toxicity.words_of(glued) for b in toxicity.buckets_of(w)}
    assert toxicity.words_of("a" * 40 + " " + "b" * 40 + "...") == ["a" * 40, "b" * 40]
    model = toxicity.train(*tables)
    rows = [(i, glue.join(words + ["pathetic"] * n + words)) for i, (glue, n) in enumerate([("/", 0), ("/", 1), ("_", 0), ("_", 1), ("\u2060", 0), ("\u2060", 1)])]
    s = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert all(s[i + 1] > 1.2 * s[i] for i in (0, 2, 4)), s  # equal where only a prefix is read


def test_language_on_held_out_documents(tables):
    rows = language_id.identify(tables[0]).join(tables[0].select("doc_id", "lang"), "doc_id").where("held_out")
    right = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_odd_documents(spark, odd_frame, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1), (3, 1, 0), (7, None, 5), (None, 1, 1), (999, 1, 1), (21, 0, 0), (22, 1, 1)], "doc_id bigint, quality int, toxic int")
    n = odd_frame.count()
    for module in (quality_classifier, toxicity):
        for some in (labels, labels.where("false")):
            rows = module.classify(odd_frame, some).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
            assert not any(r.held_out for r in rows if r.doc_id is None)
        assert module.classify(no_docs, labels).count() == 0
    assert quality_classifier.classify(odd_frame, labels.where("false")).where("score <> 0.5").count() == 0
    found = {r.doc_id: r for r in language_id.identify(odd_frame).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (4, 5, 6))
    assert all(0 <= r.score <= 1 for r in found.values())
    unknown = language_id.identify(odd_frame.withColumn("lang", F.lit(None).cast("string")))
    assert unknown.where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(no_docs).count() == 0


def test_scores_do_not_read_other_columns(spark, tables):
    docs, labels = tables
    part = docs.where("doc_id < 50")
    changed = part.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    weights = quality_classifier.train(docs, labels)
    score = lambda df: sorted(tuple(r) for r in quality_classifier.score(df, weights).collect())
    assert score(part) == score(changed)


MASK = 2**64 - 1


def plain_mix(x):
    x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & MASK
    return x ^ (x >> 29)


def plain_features(text):
    """Counts of the quality classifier's hashed features, by a loop over the words."""
    found, stems, tails = Counter(), [], []
    for w in (text or "").encode().split():
        stem = w.rstrip(quality_classifier._CLOSING)
        tail = w[len(stem) :]
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in stem)
        stems.append(xxhash.xxh32_intdigest(low, seed=int(stem.isupper() and len(stem) > 1)))
        tails.append(xxhash.xxh32_intdigest(tail) | 1 if tail else 0)
    for i, (s, t) in enumerate(zip(stems, tails, strict=True)):
        found[plain_mix(s + 5) >> 44] += 1
        found[plain_mix(t + 17) >> 44] += 1
        if i:
            same = stems[i - 1] == s
            found[(1 if same else plain_mix((stems[i - 1] * 0x9E3779B97F4A7C15 + s) & MASK)) >> 44] += 1
            found[plain_mix((tails[i - 1] * 0xC2B2AE3D27D4EB4F + t + 3) & MASK) >> 44] += 1
    return found


def test_quality_scores_by_brute_force(spark, tables, odd_docs):
    weights = quality_classifier.train(*tables)
    got = quality_classifier.score(spark.createDataFrame([d[:2] for d in odd_docs], "doc_id bigint, text string"), weights).collect()
    for (_, text, *_), row in zip(odd_docs, got, strict=True):
        found = plain_features(text)
        total = sum(found.values())
        logit = float(weights[-1]) + (20.0 * sum(float(weights[k]) * n for k, n in found.items()) / total if total else 0.0)
        assert row.score == pytest.approx(1 / (1 + math.exp(-min(35.0, max(-35.0, logit)))), abs=1e-6)


def test_updates_by_brute_force():
    """Follow-the-regularised-leader updates of single coordinates in dictionaries give the same weights."""
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 40, 6)).astype(np.uint32), None, int(rng.integers(0, 2))) for _ in range(60)]
    rows = [(i, np.full(len(i), 1 / len(i), np.float32), y) for i, _, y in rows]
    z, n = Counter(), Counter()
    alpha, beta, l1, l2 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else (math.copysign(l1, z[k]) - z[k]) / ((beta + math.sqrt(n[k])) / alpha + l2)
    for _ in range(2):
        for idx, share, y in rows:
            x = {int(k): 20.0 * float(s) for k, s in zip(idx, share, strict=True)} | {64: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
            for k, v in x.items():
                g, w = (p - y) * v, weight(k)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
                n[k] += g * g
    got = quality_classifier.fit(rows, bits=6, epochs=2)
    assert got.tolist() == pytest.approx([weight(k) for k in range(65)], abs=1e-5)


def test_toxicity_scores_by_brute_force(spark, tables, odd_docs):
    scalars, slope, offset = model = toxicity.train(*tables)
    rows = [d[:2] for d in odd_docs] + [(900, "ein İstanbul " * 5 + "日本語テキスト好き " * 3 + "x" * 70 + " a.b/c_" * 30)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    for (_, text), row in zip(rows, got, strict=True):
        means = []
        for w in toxicity.words_of(text):
            w = w.strip(toxicity._EDGES)
            marked = f"<{w}>".replace("<\n", "").replace("\n>", "")
            grams = [marked] + [marked[i : i + k] for k in (3, 4, 5, 6) for i in range(len(marked) - k + 1)]
            known = any(c.isalpha() for c in w)
            means.append(sum(float(scalars[xxhash.xxh32_intdigest(g) % toxicity.BUCKETS]) for g in grams) / len(grams) if known else None)
        best = -math.inf
        for lo in range(0, max(1, len(means) - 4), 4):
            window = [m for m in means[lo : lo + 8] if m is not None]
            best = max(best, sum(window) / max(1, len(window)))
        assert row.score == pytest.approx(1 / (1 + math.exp(-min(35.0, max(-35.0, slope * best + offset)))), abs=1e-6)


def test_toxicity_words():
    assert toxicity.words_of("A a B,  b\tb\u00a0c") == ["a", "b,", "b", "c"] and toxicity.words_of(None) == toxicity.words_of(" \n") == []
    words = ["héllo", "a", "..", "xx-yy", "ab", "日本語テキスト", "x" * 60, "\nab", "ab\n", "naïve\U0001f600s"]
    found = {}
    for owner, bucket in toxicity.grams_of(words):
        for i, b in zip(owner.tolist(), bucket.tolist(), strict=True):
            found.setdefault(i, []).append(b)
    assert all(sorted(found.get(i, [])) == sorted(toxicity.buckets_of(w).tolist()) for i, w in enumerate(words))


def plain_profile(text):
    """Sum of the bound vectors of a text's letter triples, by a loop."""
    vector = lambda c: np.random.default_rng([71, c]).integers(0, 2, 1024, dtype=np.int8) * 2 - 1
    total, run = np.zeros(1024), [0]
    for c in (text or "").lower() + "\n":
        if c.isalpha() or run[-1]:
            run.append(ord(c) if c.isalpha() else 0)
    for a, b, c in zip(run, run[1:], run[2:], strict=False):
        if b:
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return total


def test_language_by_brute_force(spark):
    base = {"aa": "tha tho ther and thing ", "bb": "sch ein der und ich nicht ", "cc": "öde größe süß üben "}
    rows = [(i, base[lang] * (1 + i % 3), lang) for i, lang in enumerate(list(base) * 6)]
    rows += [(100, "the thing und", None), (101, None, None), (102, "12 34 ..", "aa"), (103, "größe thing", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    sums = {}
    for i, text, lang in rows:
        v = plain_profile(text)
        if lang and zlib.crc32(str(i).encode()) % 4 != 2 and np.linalg.norm(v):
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    for i, text, _ in rows:
        v = plain_profile(text)
        cosines = {lang: v @ s / np.linalg.norm(v) / np.linalg.norm(s) for lang, s in sums.items()} if np.linalg.norm(v) else {"und": 0.0}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(max(0.0, cosines[best]), abs=1e-4)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_any_number_of_languages(spark):
    """Prototypes in blocks give what one block gives, and a sample has rows of each of more than 10,000 strata."""
    rows = [(i, " ".join(f"{chr(97 + i % 20)}{chr(97 + (i * j) % 26)}x" for j in range(9)), f"l{i % 40}") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    one, many = language_id.train(df), language_id.train(df, lang_block=7)
    assert many.n_blocks > 3 and one.n_langs == many.n_langs > 30
    found = lambda model: sorted(language_id.nearest(df, ["doc_id"], model).collect())
    for a, b in zip(found(one), found(many), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-5)
    strata = spark.range(36_000).selectExpr("id", "concat('s', id % 12000) as s")
    sample = bounded_rows(strata, "id", ["s"], 2)
    assert sample.select("s").distinct().count() > 11_000 and sample.groupBy("s").count().where("count > 3").count() == 0
    again = strata.unionByName(strata)
    assert bounded_rows(again, "id", [], 500).distinct().count() == bounded_rows(strata, "id", [], 500).count() == bounded_rows(again, "id", [], 500).count()


def test_many_letters():
    enc = language_id.Encoder()
    texts = ["".join(chr(0x4E00 + (i * 7 + k) % 900) for k in range(300)) for i in range(3)] + ["plain text"]
    first = enc.bundle(texts)
    assert (enc.bundle(texts) == first).all() and (language_id.Encoder().bundle(texts[::-1])[::-1] == first).all()


def test_toxicity_learns_from_the_highest_windows():
    scores = np.array([0.5, 0.9, 0.91, 0.2, 0.89, 0.9, 0.95, 0.94, 0.93, 0.9, 1.0])
    assert toxicity.top_windows(scores, 0.3).tolist() == [1, 2, 6, 7, 8, 10]  # the best six by score, not by place
    assert toxicity.top_windows(scores, 0.06).tolist() == [6, 7, 10]
    assert toxicity.top_windows(np.array([-0.2, -0.1, -0.105]), 0.1).tolist() == [1, 2]


def test_toxicity_round_by_brute_force():
    """One step over all windows of a few documents against sums bucket by bucket."""
    texts = ["you are vile scum and more words follow here", "a kind and plain text of some words to read today", "", "... ---"]
    trainer = toxicity.Trainer(texts, np.array([1, 0, 0, 1]))
    trainer.out[:] = np.linspace(-0.3, 0.3, trainer.out.size).reshape(trainer.out.shape)
    emb, out = trainer.emb.astype(np.float64), trainer.out.astype(np.float64)
    windows = [(0, 0), (0, 1), (1, 0), (1, 1), (3, 0)]
    targets, weights, rate = np.array([1, 1, 0, 0, 1]), np.array([0.5, 0.5, 0.7, 0.7, 1.0], np.float32), 0.1
    words = [toxicity.words_of(t) for t in texts]
    g_out, g_emb = np.zeros_like(out), {}
    for (d, k), target, weight in zip(windows, targets, weights, strict=True):
        bags = [toxicity.buckets_of(w) for w in words[d][k * toxicity.STRIDE : k * toxicity.STRIDE + toxicity.WINDOW]]
        bags = [b for b in bags if len(b)]
        if not bags:
            continue
        hidden = sum(emb[b].mean(axis=0) for b in bags) / len(bags)
        p = np.exp(hidden @ out) / np.exp(hidden @ out).sum()
        p[target] -= 1
        p *= float(weight)
        g_out += np.outer(hidden, p)
        for bag in bags:
            for b in bag.tolist():
                g_emb[b] = g_emb.get(b, 0) + out @ p / (len(bag) * len(bags))
    trainer.epoch(windows, targets, weights, rate)
    want = out - rate * g_out / np.sqrt(1e-6 + g_out**2)
    assert np.allclose(trainer.out, want, atol=1e-4)
    for b, g in g_emb.items():
        assert np.allclose(trainer.emb[b], emb[b] - rate * g / np.sqrt(1e-6 + (g**2).mean()), atol=1e-4)
    rest = np.ones(len(emb), bool)
    rest[list(g_emb)] = False
    assert (trainer.emb[rest] == emb[rest].astype(np.float32)).all()
