import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from tokenizers import Tokenizer

from corvane.llm import packing, token_files
from corvane.llm.tokens import encoder, slices, tokenizer_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = tokenizer_path(request.param)
    return encoder(path), Tokenizer.from_file(path)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abAB  \n\t'.,!|<>éßΣσ中9 \u00a0\u180e\x1c\u0301", "<|endoftext|>", "'s", "'ll", "  "]), max_size=30).map("".join), max_size=4))
def test_same_ids_as_whole_texts(both, texts):
    enc, plain = both
    ids, rows = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts(both, odd_docs):
    enc, plain = both
    texts = [d[1] for d in odd_docs]
    ids, rows = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:], strict=False)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(slices(pa.array(["a" * 9, None, "b"]), 8)) == [(0, 1), (1, 3)]


def test_token_files(spark, odd_frame, odd_docs, tmp_path):
    path = tokenizer_path(FILES[0])
    known = [(d[0], d[1]) for d in odd_docs if d[0] is not None]
    got = {r.doc_id: r[1:] for r in token_files.token_file_digest(odd_frame.where("doc_id is not null"), path, path=str(tmp_path / "t")).collect()}
    assert got == brute.token_rows(known, Tokenizer.from_file(path))
    one = token_files.lookup(spark, str(tmp_path / "t"), [7]).first()
    assert one.n_tokens == len(one.ids) and one.ids[-1] == 2
    assert token_files.token_file_digest(odd_frame, path).count() == len(odd_docs)


def test_token_files_with_repeated_ids_and_empty(spark, no_docs):
    path = tokenizer_path(FILES[0])
    df = spark.createDataFrame([(5, "b b"), (5, "a"), (5, "a"), (1, None)], "doc_id bigint, text string")
    rows = token_files.token_file_digest(df, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 5, 5, 5]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert token_files.token_file_digest(no_docs, path).count() == 0


def rows_scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_stripes_indexes_and_bloom_filters(spark, tmp_path):
    """Files have several stripes; statistics and Bloom filters let a lookup skip row groups, and a stripe can be read alone."""
    rng = random.Random(3)
    rows = [(2 * i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(60))) for i in range(6000)]
    path = token_files.write_token_files(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), str(tmp_path / "t"), tokenizer_path(FILES[0]), 2, 1 << 18, 1000)
    files = [orc.ORCFile(str(f)) for f in sorted((tmp_path / "t").glob("*.orc"))]
    assert sum(f.nrows for f in files) == 6000 and sum(f.nstripes for f in files) > len(files)
    assert all(f.row_index_stride == 1000 for f in files)
    whole = next(f for f in files if f.nstripes > 1)
    assert sum(whole.read_stripe(k).num_rows for k in range(whole.nstripes)) == whole.nrows
    assert spark.read.orc(path).count() == 6000
    assert 0 < rows_scanned(token_files.lookup(spark, path, [4000])) <= 1000
    assert rows_scanned(token_files.lookup(spark, path, [10**9])) == 0  # outside all ranges
    assert sum(rows_scanned(token_files.lookup(spark, path, [2 * k + 1])) > 0 for k in range(1000, 1020)) <= 3  # inside ranges, not in the filter


def test_files_of_limited_records(spark):
    path = tokenizer_path(FILES[0])
    df = spark.createDataFrame([(i, "a b c " * i) for i in range(50)], "doc_id bigint, text string")
    want = sorted(token_files.token_file_digest(df, path).collect())
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        assert sorted(token_files.token_file_digest(df, path).collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_cache_is_bounded(monkeypatch):
    from corvane.llm import tokens

    monkeypatch.setattr(tokens, "MAX_CACHE_BYTES", 20_000)
    enc, plain = tokens.ChunkEncoder(tokenizer_path(FILES[1])), Tokenizer.from_file(tokenizer_path(FILES[1]))
    for k in range(6):
        text = " ".join(f"w{i * 7}x" for i in range(k * 300, k * 300 + 400))
        ids, _ = enc.encode(pa.array([text]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
        kept = sum(tokens._ENTRY_BYTES + len(c) + len(x) for cache in (enc.bare, enc.spaced) for c, x in cache.items() if c)
        assert kept <= 1.05 * (20_000 + tokens._ENTRY_BYTES)


def check_packing(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("group_items", [4, 60_000])
def test_packing(spark, odd_frame, odd_docs, group_items):
    path, capacity = tokenizer_path(FILES[1]), 300
    rows = packing.pack(odd_frame, path, capacity=capacity, group_items=group_items).collect()
    want = brute.pieces([(d[0], d[1]) for d in odd_docs], Tokenizer.from_file(path), capacity)
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(repr, want))
    n = check_packing(rows, capacity)
    assert n <= 1.15 * sum(w[3] for w in want) / capacity + 2


def test_packing_empty_and_ids(spark, no_docs, odd_frame):
    path = tokenizer_path(FILES[1])
    assert packing.pack(no_docs, path).count() == 0
    packed = packing.pack(odd_frame, path, capacity=256, with_ids=True)
    plain = packing.pack(odd_frame, path, capacity=256)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(repr, packed.select(*columns).collect())) == sorted(map(repr, plain.select(*columns).collect()))
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in packed.limit(50).collect())
    whole = packing.sequences(packed).collect()
    assert all(len(r.ids) <= 256 for r in whole) and sum(len(r.ids) for r in whole) == sum(r.length for r in packed.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_best_fit(lengths):
    a = np.array(lengths)
    bins, offsets, fills = packing.best_fit(a, 50)
    assert fills.max() <= 50 and np.bincount(bins, weights=a).tolist() == fills.tolist()
    assert len(fills) <= 11 / 9 * -(-sum(lengths) // 50) * 1.5 + 1
    for b in range(len(fills)):
        parts = sorted((int(offsets[i]), int(a[i])) for i in np.flatnonzero(bins == b))
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts])[:-1].tolist()


def test_rounds_merge_underfull_bins(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "a " * rng.randint(5, 40)) for i in range(400)], "doc_id bigint, text string").repartition(8)
    rows = packing.pack(df, tokenizer_path(FILES[1]), capacity=64, group_items=16).collect()
    assert check_packing(rows, 64) <= 1.12 * sum(r.length for r in rows) / 64 + 1


def test_a_cache_holds_many_chunks(monkeypatch):
    """20,000 words of 7 characters fit into 1 MB, so the second time none is encoded (before, a third of them fitted)."""
    from corvane.llm import tokens

    enc, plain = tokens.ChunkEncoder(tokenizer_path(FILES[0]), 1 << 20), Tokenizer.from_file(tokenizer_path(FILES[0]))
    text = " ".join(f"w{i:05d}x" for i in range(20_000))
    for again in (False, True):
        if again:
            monkeypatch.setattr(enc, "_whole", lambda texts: [] if not texts else pytest.fail(f"{len(texts)} encoded again"))
        for odd in ("", " é\n", "x" * 60 if not again else ""):
            words = text + odd if not again else text
            ids, _ = enc.encode(pa.array([words, None, words]))
            assert ids.tolist() == 2 * plain.encode(words, add_special_tokens=False).ids
