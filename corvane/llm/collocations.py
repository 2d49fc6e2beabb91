"""Phrases whose words belong together, mined with count tries over word sequences.

1. Tasks cut their texts into pieces and words and count, for each language apart, all runs of ``LONGEST`` words: each position
   gives one run, shorter at a piece's end. A shard is ``SHARD_WORDS`` positions. Its distinct runs in the order of their words'
   bytes are the leaves of a trie of limited depth; a phrase's count is the sum of the leaves below it.
2. A shard's leaves are cut at the bounds of ranges of (language, run) and serialised by range: the range's words, the length
   that each leaf shares with the one before, the words that follow, counts. Bounds come from a sample of documents and only
   balance the work. They are whole runs, not first words, so the runs of one very common word or pair spread over ranges too.
   With each range go the shard's counts of those few phrases whose leaves lie on both sides of one of its bounds.
3. A task merges the sorted leaves of all shards of its range, sums them and walks the trie: a phrase's own count and those of its
   first parts (left parts) lie on one path. Phrases below the least count end here: no longer phrase reaches it then.
4. The suffix link of a phrase is the phrase without its first word. It lies in any range, so right parts come by joins of
   frequent phrases on (language, suffix). The shorter phrases that a longer one covers meet it by a grouping.
5. The best of each language: the best of each of ``DEALT`` groups of its phrases, then the best of those.

Defined results: a null text counts as empty; a null language is ``und`` (with what is called so); an empty table gives no rows;
repeated rows count as often as they are there; equal scores and counts are in the order of the phrase's bytes; other columns
are not read. A language of which no phrase reaches the least count has no row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from corvane.llm._common import batch_rows, batches, give_back, materialize, scratch_path, scratch_scope
from corvane.llm.coded import byte_order, code, expand, squeeze, translation
from corvane.llm.tokens import slices

LONGEST, LEAST, COVERED, BEST = 4, 30, 80, 2000
SHARD_WORDS, HELD_WORDS = 1_000_000, 2_000_000
#: Texts that are cut into words at once.
CODED_BYTES = 2 << 20
#: Positions of a range, about; documents of the sample for the bounds, and runs taken of each.
RANGE_WORDS, SAMPLE_DOCS, SAMPLE_RUNS = 2_000_000, 2_000, 64
DEALT = 16

TABLE = translation(b"\x09", b".,;:!?\x0a\x0b\x0c\x0d")

Run = tuple[bytes, ...]
#: A bound is (language, run); runs compare as tuples of words, a shorter one before its continuations.
Bound = tuple[str, Run]


class Stream:
    """The words of one language's pieces: batch by batch the distinct words and their numbers from 1, with a zero after each piece."""

    def __init__(self) -> None:
        self.known: list[pa.Array] = []
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, known: pa.Array, codes: np.ndarray, starts: np.ndarray) -> None:
        self.known.append(known)
        self.parts.append(np.insert(codes.astype(np.int32) + np.int32(1), np.unique(starts[1:]), np.int32(0)))
        self.n += len(codes)

    def leaves(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words in the order of their bytes, runs as rows of places from 1 with 0 behind a piece's end, their counts), sorted.

        The stream is empty then."""
        sizes = [len(k) for k in self.known]
        words = pa.concat_arrays(self.known).dictionary_encode()
        self.known.clear()
        order = byte_order(words.dictionary)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        number, at = place[words.indices.to_numpy()], 0
        for i, n in enumerate(sizes):
            self.parts[i] = np.append(np.int32(0), number[at : at + n])[self.parts[i]]
            at += n
        flat = np.concatenate([*self.parts, np.zeros(LONGEST, np.int32)])
        self.parts.clear()
        names = words.dictionary.take(pa.array(order)).cast(pa.binary())
        del words, number, place, order
        rows, counts = _distinct(*_stream_keys(flat))
        return names.to_pylist(), rows, counts


def _runs(flat: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(flat)
    rows = np.stack([flat[at + k] if len(at) else at for k in range(LONGEST)], axis=1)
    for k in range(1, LONGEST):
        rows[rows[:, k - 1] == 0, k] = 0
    return rows


def _coded_pairs(pairs: np.ndarray, wide: np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(the place of each pair's number among the distinct ones in order, the words of the distinct ones)."""
    coded = pa.array(pairs).dictionary_encode()
    codes, known = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    order = np.argsort(known)
    rank = np.empty(len(known), np.int32)
    rank[order] = np.arange(len(known), dtype=np.int32)
    known = known[order]
    return rank[codes], np.stack([known // wide, known % wide], axis=1).astype(np.int32)


def _stream_keys(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_keys``, of the run at each position of a stream that ends in zeros: a run is the pair there and the pair two places on."""
    wide = np.int64(flat.max(initial=0) + 1)
    at = np.flatnonzero(flat).astype(np.int32 if len(flat) < 2**31 else np.int64)
    pairs = flat[at] * wide
    pairs += flat[at + 1]
    codes, known = _coded_pairs(np.append(pairs, 0), wide)  # the pair of zeros is the first
    del pairs
    placed = np.zeros(len(flat), np.int32)
    placed[at] = codes[:-1]
    keys = codes[:-1].astype(np.int64) << 32
    del codes
    second = placed[at + 2] if len(at) else placed[:0]
    second[flat[at + 1] == 0] = 0
    keys |= second
    return keys, known


def _keys(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each row that orders as the row, the distinct pairs of words that the numbers' halves stand for)."""
    wide = np.int64(rows.max(initial=0) + 1)
    pairs = np.empty(2 * len(rows), np.int64)
    for k, half in enumerate((pairs[: len(rows)], pairs[len(rows) :])):
        np.multiply(rows[:, 2 * k], wide, out=half)
        half += rows[:, 2 * k + 1]
    codes, known = _coded_pairs(pairs, wide)
    del pairs
    keys = codes[: len(rows)].astype(np.int64) << 32
    keys |= codes[len(rows) :]
    return keys, known


def _distinct(keys: np.ndarray, pairs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the distinct keys in order, and how often each is there (or the sums of ``counts``)."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        del order
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    n = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)
    keys = keys[first]
    rows = np.empty((len(keys), LONGEST), np.int32)
    rows[:, :2] = pairs[keys >> 32]
    rows[:, 2:] = pairs[keys & 0xFFFFFFFF]
    return rows, n


def counted(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and how often each is there. With ``counts`` the rows are sorted runs one after another,
    which a stable sort merges."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    return _distinct(*_keys(rows), counts)


class _Words:
    """Rows of places as tuples of words, for binary search."""

    def __init__(self, names: list[bytes], rows: np.ndarray, cut: int = LONGEST):
        self.names, self.rows, self.cut = names, rows, cut

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> Run:
        return tuple(self.names[k - 1] for k in self.rows[i, : self.cut].tolist() if k)


def _span(words: _Words, phrase: Run) -> tuple[int, int]:
    """The leaves below a phrase."""
    lo = bisect_left(words, phrase)
    cut = _Words(words.names, words.rows, len(phrase))
    hi, end = lo, len(words)
    while hi < end:
        mid = (hi + end) // 2
        if cut[mid] == phrase:
            hi = mid + 1
        else:
            end = mid
    return lo, hi


def ranges_of(bounds: list[Bound], lang: str) -> tuple[int, int]:
    """First and last range that a language's runs lie in; range j lies between bounds j - 1 and j."""
    lo = bisect_left(bounds, (lang, ()))
    hi = lo
    while hi < len(bounds) and bounds[hi][0] == lang:
        hi += 1
    return lo, hi


def cut_phrases(bounds: list[Bound], lang: str, j: int) -> list[Run]:
    """The phrases whose leaves may lie on both sides of a bound of range j: the first parts of its two bounds."""
    near = [run for name, run in bounds[max(0, j - 1) : j + 1] if name == lang]
    return sorted({run[:k] for run in near for k in range(1, len(run) + 1)})


def serialise(names: list[bytes], rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted leaves: the words in use, what each shares with the leaf before, the places that follow, counts."""
    used = np.unique(rows)
    used = used[used > 0]
    narrow = np.searchsorted(used, rows) + 1
    narrow[rows == 0] = 0
    same = np.cumprod(narrow[1:] == narrow[:-1], axis=1).sum(axis=1) if len(rows) else np.zeros(0, int)
    shared = np.append(0, same)[: len(rows)].astype(np.uint8)
    rest = narrow[np.arange(LONGEST) >= shared[:, None]].astype(np.uint32)
    # the high and low bytes apart compress better
    parts = [squeeze(b"\n".join(names[i - 1] for i in used.tolist())), squeeze(shared), squeeze(rest.view(np.uint8).reshape(-1, 4).T), squeeze(counts.astype(np.int64))]
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def deserialise(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    sizes = np.frombuffer(blob[:16], np.uint32)
    ends = 16 + np.cumsum(sizes)
    words, shared, rest, counts = (expand(blob[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True))
    shared = np.frombuffer(shared, np.uint8)
    rest = np.ascontiguousarray(np.frombuffer(rest, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    own = np.arange(LONGEST) >= shared[:, None]
    # a place that is shared comes from the last leaf before that has its own
    rows = np.zeros((len(shared), LONGEST), np.int32)
    rows[own] = rest
    for k in range(LONGEST):
        at = np.flatnonzero(own[:, k])
        rows[:, k] = np.repeat(rows[at, k], np.diff(np.append(at, len(shared))))
    return words.split(b"\n") if words else [], rows, np.frombuffer(counts, np.int64)


TRIES = "part int, lang string, cut binary, leaves binary"


def _tries(held):
    """A task's shards, cut by range."""

    def emit(lang: str, stream: Stream, bounds: list[Bound]) -> pa.RecordBatch:
        names, rows, counts = stream.leaves()
        words, total = _Words(names, rows), np.append(0, np.cumsum(counts))
        lo, hi = ranges_of(bounds, lang)
        at = [0, *(bisect_left(words, run) for _, run in bounds[lo:hi]), len(rows)]
        parts, cuts, leaves = [], [], []
        for j in range(lo, hi + 1):
            a, b = at[j - lo], at[j - lo + 1]
            spans = [_span(words, p) for p in cut_phrases(bounds, lang, j)]
            parts.append(j)
            cuts.append(np.array([total[e] - total[s] for s, e in spans], np.int64).tobytes())
            leaves.append(serialise(names, rows[a:b], counts[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([lang] * len(parts), pa.string()), pa.array(cuts, pa.binary()), pa.array(leaves, pa.binary())], names=["part", "lang", "cut", "leaves"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = held.value
        streams: dict[str, Stream] = {}
        for part in batches(parts):
            langs = part.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = part.column("text").filter(pc.equal(langs.indices, i))
                for lo, hi in slices(texts, CODED_BYTES):
                    stream = streams.setdefault(lang, Stream())
                    stream.add(*code(texts.slice(lo, hi - lo), TABLE, pieces=True))
                    if stream.n >= SHARD_WORDS:
                        yield emit(lang, streams.pop(lang), bounds)
                        give_back()
            while sum(s.n for s in streams.values()) > HELD_WORDS:
                lang = max(streams, key=lambda x: streams[x].n)
                yield emit(lang, streams.pop(lang), bounds)
                give_back()
        for lang, stream in streams.items():
            if stream.n:
                yield emit(lang, stream, bounds)
        streams.clear()
        give_back()

    return run


PHRASES = "lang string, phrase string, n_words int, a bigint, l1 bigint, l2 bigint, l3 bigint"


def _walk(bounds: list[Bound], j: int, lang: str, blocks: list[tuple[bytes, bytes]], least: int) -> pa.RecordBatch:
    """The frequent phrases of a language in range j with their first parts' counts, and the number of positions (no phrase)."""
    decoded = [deserialise(leaves) for _, leaves in blocks]
    sizes = [len(names) for names, _, _ in decoded]
    words = pa.chunked_array([pa.array(names, pa.binary()) for names, _, _ in decoded]).combine_chunks().dictionary_encode()
    counts = np.concatenate([c for _, _, c in decoded])
    parts = [own for _, own, _ in decoded]
    del decoded
    order = byte_order(words.dictionary)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    number, known, at = place[words.indices.to_numpy()], words.dictionary.take(pa.array(order)), 0
    for i, n in enumerate(sizes):
        parts[i] = np.append(np.int32(0), number[at : at + n])[parts[i]]
        at += n
    rows = np.concatenate(parts)
    del words, number, place, order, parts
    keys, pairs = _keys(rows)
    del rows
    rows, counts = _distinct(keys, pairs, counts)
    del keys, pairs
    cut = np.sum([np.frombuffer(c, np.int64) for c, _ in blocks], axis=0)
    cut = dict(zip(cut_phrases(bounds, lang, j), cut.tolist() if np.ndim(cut) else [], strict=True))
    low = bounds[j - 1] if j else ("", ())
    high = bounds[j] if j < len(bounds) else None
    leaves = _Words(known.to_pylist(), rows)
    heads, sums, out = [], [], {c: [] for c in ("phrase", "n_words", "a", "l1", "l2", "l3")}

    def give(phrase: list, n_words: int, a: list, lefts: list) -> None:
        out["phrase"].append(pa.array(phrase, pa.string()) if not isinstance(phrase, pa.Array) else phrase)
        out["n_words"].append(pa.array(np.full(len(phrase), n_words, np.int32)))
        out["a"].append(pa.array(a, pa.int64()))
        for k in range(LONGEST - 1):
            out[f"l{k + 1}"].append(pa.array(lefts[k], pa.int64()) if k < n_words - 1 else pa.nulls(len(phrase), pa.int64()))

    changed = np.zeros(len(rows), bool)
    for depth in range(1, LONGEST + 1):
        changed |= np.append(True, rows[1:, depth - 1] != rows[:-1, depth - 1])[: len(rows)]
        first = np.flatnonzero(changed)
        f = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
        own = rows[first, depth - 1] > 0 if len(first) else np.zeros(0, bool)
        # phrases on a bound: the shards' whole counts, given once, in the range that the phrase itself lies in
        for phrase, whole in cut.items():
            if len(phrase) != depth:
                continue
            lo, hi = _span(leaves, phrase)
            if hi > lo:
                i = int(np.searchsorted(first, lo))
                f[i] = whole
                own[i] = False
            if whole >= least and low <= (lang, phrase) and (high is None or (lang, phrase) < high):
                give([b" ".join(phrase).decode("utf-8", "surrogatepass")], depth, [whole], [[cut[phrase[:k]]] for k in range(1, depth)])
        heads.append(first)
        sums.append(f)
        hit = own & (f >= least)
        if hit.any():
            at = first[hit]
            columns = [known.take(pa.array(rows[at, k] - 1)) for k in range(depth)]
            phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if depth > 1 else columns[0]
            give(phrase.cast(pa.string()), depth, f[hit], [sums[k][np.searchsorted(heads[k], at, "right") - 1] for k in range(depth - 1)])
    give([None], 0, [int(counts.sum())], [])
    columns = {c: pa.concat_arrays(x) for c, x in out.items()}
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(columns["a"]), pa.string()), *columns.values()], names=["lang", *columns])


def _merged(held, least: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, []
        for part in parts:
            for j, lang, cut, leaves in zip(*[part.column(c).to_pylist() for c in ("part", "lang", "cut", "leaves")], strict=True):
                if key != (j, lang) and blocks:
                    yield _walk(held.value, *key, blocks, least)
                    blocks = []
                key = (j, lang)
                blocks.append((cut, leaves))
        if blocks:
            yield _walk(held.value, *key, blocks, least)
        del blocks
        give_back()

    return run


def _sampled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its number of words and some of its runs, evenly spaced."""
    for part in batches(parts):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            stream = Stream()
            stream.add(*code(pa.array([text], pa.string()), TABLE, pieces=True))
            names = ["", *stream.known[0].to_pylist()]
            rows = _runs(np.concatenate([*stream.parts, np.zeros(LONGEST, np.int64)]))
            at = np.unique(np.linspace(0, len(rows) - 1, SAMPLE_RUNS).astype(int)) if len(rows) else []
            runs = ["\n".join(names[k] for k in rows[i].tolist() if k) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(rows)], pa.int64()), pa.array([runs], pa.list_(pa.string()))], names=["lang", "n", "runs"])


def _bounds(docs: DataFrame) -> list[Bound]:
    """Bounds of ranges of about RANGE_WORDS positions; at least one range a shuffle partition."""
    spark = docs.sparkSession
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    rows = docs.sample(share, 11).mapInArrow(_sampled, "lang string, n bigint, runs array<string>").collect()
    words = sum(r["n"] for r in rows) / share
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), round(words / RANGE_WORDS))
    weighted = sorted((r["lang"], tuple(w.encode("utf-8", "surrogatepass") for w in run.split("\n")), r["n"] / len(r["runs"])) for r in rows for run in r["runs"])
    total = np.cumsum([w for _, _, w in weighted])
    if not len(total):
        return []
    at = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges)
    return sorted({weighted[i][:2] for i in at.tolist()})


def phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, n_words, a, l1, l2, l3 of the phrases of up to LONGEST words with a count of ``least``; a row without
    phrase for each range and language holds positions."""
    spark = docs.sparkSession
    batch_rows(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    bounds = _bounds(docs)
    held = spark.sparkContext.broadcast(bounds)
    tries = docs.mapInArrow(_tries(held), TRIES)
    dealt = tries.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(_merged(held, least), PHRASES)


def _rest(phrase: str, k: int) -> str:
    """SQL for a phrase without its first k words: k suffix links."""
    for _ in range(k):
        phrase = f"substr({phrase}, instr({phrase}, ' ') + 1)"
    return phrase


def _exact(column: Column) -> Column:
    return column.cast(DecimalType(20, 0))


def collocations(docs: DataFrame, best: int = BEST, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``best`` phrases of 2 to 4 words."""
    at = scratch_path(docs.sparkSession, "phrases")
    with scratch_scope(docs.sparkSession):
        known = materialize(phrases(docs, least), "phrases", at)
    totals = known.where("phrase is null").groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = known.where("phrase is not null")
    longer = frequent.where("n_words >= 2")
    cuts = longer.select("lang", "phrase", "a", F.expr("posexplode(filter(array(l1, l2, l3), x -> x is not null)) as (k, l)"))
    rest = F.expr(f"CASE k WHEN 0 THEN {_rest('phrase', 1)} WHEN 1 THEN {_rest('phrase', 2)} ELSE {_rest('phrase', 3)} END")
    rights = frequent.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cuts = cuts.withColumn("rest", rest).join(rights, ["lang", "rest"])
    score = F.call_function("div", _exact(F.col("a")) * F.lit(2_000_000).cast(DecimalType(7, 0)), _exact(F.col("l") + F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    # the shorter phrases inside a longer one, each with the largest count of those around it
    runs = lambda n: [f"slice(w, {i}, {m})" for m in range(2, n) for i in range(1, n - m + 2)]
    inside = longer.where("n_words >= 3").select("lang", "a", "n_words", F.split("phrase", " ").alias("w"))
    inside = inside.select("lang", F.col("a").alias("around"), F.expr(f"explode(CASE n_words WHEN 3 THEN array({', '.join(runs(3))}) ELSE array({', '.join(runs(4))}) END)").alias("w"))
    around = inside.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("around").alias("around"))
    lost = _exact(F.col("around")) * 100 >= _exact(F.col("a")) * covered
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | ~lost)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "x.l", "x.r", F.col("x.score").cast("bigint").alias("score"))
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    rows = rows.withColumn("nth", F.row_number().over(dealt.orderBy(*order))).where(F.col("nth") <= best)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
