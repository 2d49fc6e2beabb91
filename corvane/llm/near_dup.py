"""Near-duplicate documents by a chosen-path similarity join over word-shingle sets.

1. Each text becomes its set of distinct shingles, a 128-bit key of the set and ``WIDTH`` minwise
   tokens. Documents with equal sets form a class; only one row a class goes on.
2. Independent trees: a node selects ``BRANCH`` of the minwise tokens by a hash of its path, and each
   document goes on to the child named by its own token's value. Nodes of up to ``CROWD_BLOCK``
   documents are compared exhaustively by their token sketches; larger ones branch again. All
   levels are DataFrame steps over (path, class) rows: no larger node is gathered in one task.
   A pair of similarity s stays together at a level with 1 - (1 - s)^BRANCH. If it has to at all MAX_DEPTH levels, the
   trees miss a pair at the threshold with probability 1.7e-7 at 0.85 and 4.9e-6 at 0.8, at three levels 1e-8 and 3.2e-7.
   Sketches that disagree too often rule a pair out in any tree: at the threshold with probability 1.5e-7 at
   0.85 and 8e-8 at 0.8 (binomial). Pairs above the threshold are missed less often.
   A node of which most selected tokens leave half its documents in one child can't well be parted (a
   crowd of near copies); about ``TRIED`` of its documents show that, so that it is not opened as a whole. It is
   dealt out as blocks of ``CROWD_BLOCK`` sketches (4), and each task returns a spanning forest of the sketches that agree.
3. Candidate groups are the components of what 2 found. Shingle sets are made again for their members
   alone, and all links within a group are decided on the full sets. A large group is dealt out as
   blocks of bounded size (4); each task returns a spanning forest of the links it confirmed, never all pairs.
4. What has several blocks is linked in two rounds. First each block is compared within itself and with a few members
   that all blocks get. Then those outside the largest component so far are compared with all others: a pair
   within that component is connected already, any other pair meets in a task.
5. Components of the confirmed links, spread over the classes' members.

A group of m mutually similar *different* texts costs about one transfer of each of their sets in the first round; r texts
that it leaves outside cost r / ``BLOCK`` transfers of each set, and m / ``BLOCK`` of their own. Equal texts cost nothing more.

Defined results: a null text, or one without words, has no shingles, is linked with nothing and is
its own component; a row with a null doc_id is linked with nothing, and its component is null; rows
that share a doc_id are one document for linking; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import as_row, batch_rows, batches, from_row, materialize, scratch_path, scratch_scope
from corvane.llm.components import connected_components
from corvane.llm.words import hold_words, shingle_set

WIDTH = 64
TREES = 4
BRANCH = 3
NODE_LIMIT = 32
MAX_DEPTH = 6
#: A node is not parted if most of its selected tokens leave this share of it in one child.
DENSE = 0.5
CROWD_BLOCK = 1024
#: Documents of a node that show whether it can be parted, and members of a large group that all its blocks get (on average).
TRIED, PIVOTS = 512, 16
#: Sketches must agree in this many places less than expected at the threshold, in standard deviations.
SLACK = 5.5
BLOCK = 768
BLOCK_BYTES = 24 << 20
#: The filter of candidate members that each task holds has at most this many bits (8 MB).
BLOOM_BITS, BLOOM_HASHES = 26, 3

SIGNED = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary"

_MULTIPLIERS = np.random.default_rng(20240607).integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """Minimum of WIDTH multiplicative hashes, the upper 32 bits of each."""
    least = np.full(WIDTH, 2**32 - 1, np.uint64)
    for start in range(0, len(shingles), 2048):
        part = shingles[start : start + 2048, None] * _MULTIPLIERS
        np.minimum(least, part.min(axis=0) >> np.uint64(32), out=least)
    return least.astype(">u4")


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    key = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (key & (2**64 - 1)) - 2**63, (key >> 64) - 2**63


def _sign(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_words()
        for part in batches(parts):
            sizes, k1, k2, sigs = [], [], [], []
            for text in part.column("text").to_pylist():
                s = shingle_set(text, width)
                a, b = _set_key(s)
                sizes.append(len(s))
                k1.append(a)
                k2.append(b)
                sigs.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "sig"],
            )

    return run


def _token(sig: Column, place: Column) -> Column:
    return F.substring(sig, place * 4 + 1, F.lit(4))


_PLACES = np.random.default_rng(7).permutation(WIDTH).tolist()


def _roots() -> Column:
    """Paths of the first level: each tree starts with BRANCH tokens of its own."""
    return F.array(*[F.xxhash64(F.lit(i), _token(F.col("sig"), F.lit(p))) for i, p in enumerate(_PLACES[: TREES * BRANCH])])


def _children(depth: int) -> Column:
    """The node's tokens follow from its path alone, so all its documents branch by the same ones. Each depth
    has tokens of its own to select from, so no path selects one twice."""
    rest = _PLACES[TREES * BRANCH :]
    size = len(rest) // (MAX_DEPTH - 1)
    own = rest[(depth - 1) * size : depth * size]
    place = lambda k: F.element_at(F.array(*map(F.lit, own)), (F.pmod(F.xxhash64("path") + k, F.lit(size)) + 1).cast("int"))
    return F.array(*[F.xxhash64("path", F.lit(k), _token(F.col("sig"), place(k))) for k in range(BRANCH)])


def _compare_nodes(agree: int):
    """Rows sorted by path; pairs within a node whose sketches agree in ``agree`` places."""

    def pairs(path: np.ndarray, cid: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        for d in range(1, NODE_LIMIT):
            at = np.flatnonzero(path[d:] == path[:-d])
            if not len(at):
                break
            for lo in range(0, len(at), 200_000):
                i = at[lo : lo + 200_000]
                hit = i[((sig[i] == sig[i + d]).sum(axis=1) >= agree) & (cid[i] != cid[i + d])]
                left.append(cid[hit])
                right.append(cid[hit + d])
        empty = np.empty(0, np.int64)
        return (np.concatenate(left) if left else empty), (np.concatenate(right) if right else empty)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None

        def batch(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            a, b = pairs(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for part in parts:
            if not part.num_rows:
                continue
            raw = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, WIDTH)
            rows = (part.column("path").to_numpy(), part.column("cid").to_numpy(), raw)
            if kept is not None:
                rows = tuple(np.concatenate([a, b]) for a, b in zip(kept, rows, strict=True))
            cut = int(np.searchsorted(rows[0] != rows[0][-1], False)) if rows[0][0] == rows[0][-1] else int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1
            if cut:
                yield batch(tuple(x[:cut] for x in rows))
            kept = tuple(x[cut:] for x in rows)
        if kept is not None:
            yield batch(kept)

    return run


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of classes: each pair that the trees bring together has one component."""
    agree = max(1, math.floor(WIDTH * threshold - SLACK * math.sqrt(WIDTH * threshold * (1 - threshold))))
    slim = classes.select("cid", "sig")
    rows = slim.select("cid", F.explode(_roots()).alias("path"))
    small: DataFrame | None = None
    crowds: DataFrame | None = None
    for depth in range(1, MAX_DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        level = materialize(rows.join(sizes, "path"), f"level_{depth}")
        part = level.where(F.col("n") <= NODE_LIMIT).select("path", "cid")
        small = part if small is None else small.unionByName(part)
        crowd = level.where(F.col("n") > NODE_LIMIT)
        large = crowd.where(F.col("n") > CROWD_BLOCK)
        last = depth == MAX_DEPTH or large.isEmpty()
        if not last:
            tried = large.where(_unit(F.xxhash64("cid", "path")) < F.lit(float(TRIED)) / F.col("n"))
            counts = _opened(tried, slim, depth).groupBy("parent", "branch", "path").agg(F.count(F.lit(1)).alias("k"))
            largest = counts.groupBy("parent", "branch").agg((F.max("k") / F.sum("k")).alias("share"))
            middle = F.element_at(F.array_sort(F.collect_list("share")), BRANCH // 2 + 1)
            dense = largest.groupBy("parent").agg(middle.alias("share")).where(F.col("share") >= DENSE)
            dense = materialize(dense.select(F.col("parent").alias("path")), f"dense_{depth}")
            crowd = crowd.where(F.col("n") <= CROWD_BLOCK).unionByName(large.join(dense, "path", "left_semi"))
            rows = materialize(_opened(large.join(dense, "path", "left_anti"), slim, depth).select("cid", "path"), f"children_{depth}")
        crowds = crowd if crowds is None else crowds.unionByName(crowd)
        if last:
            break
    # one byte of each minwise token is enough to compare by
    sketch = F.unhex(F.concat(*[F.hex(F.substring("sig", 4 * j + 4, 1)) for j in range(WIDTH)]))
    joined = small.join(slim, "cid").select("path", "cid", sketch.alias("sketch"))
    near = joined.repartition("path").sortWithinPartitions("path", "cid").mapInArrow(_compare_nodes(agree), "u bigint, v bigint")
    near = near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    crowds = crowds.select("path", "cid", F.col("n").alias("m"), F.ceil(F.col("n") / CROWD_BLOCK).cast("int").alias("blocks"))

    def compare(dealt: DataFrame) -> DataFrame:
        dealt = dealt.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "cid")
        return dealt.mapInArrow(_compare_crowds(agree), "u bigint, v bigint")

    members = crowds.join(slim, "cid").select("path", "cid", "m", "blocks", sketch.alias("sketch"))
    return _linked(members, "path", "sketch", compare, near)


def _unit(h: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return h.cast("double") / F.lit(float(2**64)) + F.lit(0.5)


def _opened(nodes: DataFrame, slim: DataFrame, depth: int) -> DataFrame:
    return nodes.join(slim, "cid").select("cid", F.col("path").alias("parent"), F.posexplode(_children(depth)).alias("branch", "path"))


def _linked(rows: DataFrame, key: str, payload: str, compare: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> DataFrame:
    """(node, component) of the links that ``compare`` finds between rows (cid, m, blocks) of equal ``key``, and of the edges ``more``.

    ``compare`` takes rows dealt to tasks (key, i, j) and gives a spanning forest of each task's links. No pair of rows is left
    out but those that are connected already."""
    place = F.xxhash64(key, "cid", F.lit(11))
    blocks = F.col("blocks")
    few = F.least(F.lit(float(PIVOTS)) / F.col("m"), F.lit(0.25) / blocks)  # a block grows by a quarter at most
    pivot = (blocks > 1) & (_unit(F.xxhash64(key, "cid", F.lit(12))) < few)
    at = F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(place, blocks).cast("int")))
    first = rows.select(key, "cid", payload, F.explode(at).alias("i")).withColumn("j", F.col("i"))
    edges = compare(first)
    found = connected_components(edges if more is None else edges.unionByName(more))
    several = rows.where("blocks > 1").join(found, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("component", "cid"))
    labels = several.groupBy(key, "label").agg(F.count(F.lit(1)).alias("k"), F.max("blocks").alias("of"))
    sizes = labels.groupBy(key).agg(F.max_by("label", "k").alias("bulk"), F.max("k").alias("most"), F.sum("k").alias("all"), F.max("of").alias("of"))
    share = lambda n: F.ceil(n * F.col("of") / F.col("all")).cast("int")
    sizes = sizes.select(key, "bulk", share(F.col("all") - F.col("most")).alias("outer"), share(F.col("most")).alias("inner"))
    sizes = materialize(sizes.where(F.col("outer") > 0), "bulks")
    if sizes.isEmpty():
        return found
    # blocks 0 to outer - 1 have the rows outside the largest component, which meet all; the others meet only those
    dealt = several.join(sizes, key).withColumn("out", F.col("label") != F.col("bulk"))
    own = F.when(F.col("out"), F.pmod(place, F.col("outer"))).otherwise(F.col("outer") + F.pmod(place, F.col("inner"))).cast("int")
    last = F.when(F.col("out"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
    dealt = dealt.select(key, "cid", payload, own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", payload)
    return connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(compare(dealt)))


def _grouped(parts: Iterator[pa.RecordBatch], keys: tuple[str, ...], values: tuple[str, str]) -> Iterator[tuple[list, list]]:
    """The two value columns of each run of equal keys in sorted rows."""
    key, first, second = None, [], []
    for part in parts:
        for row in zip(*[part.column(c).to_pylist() for c in (*keys, *values)], strict=True):
            if row[: len(keys)] != key:
                if first:
                    yield first, second
                key, first, second = row[: len(keys)], [], []
            first.append(row[-2])
            second.append(row[-1])
    if first:
        yield first, second


def _compare_crowds(agree: int):
    """Rows sorted by (path, i, j); a spanning forest of the sketches that agree, by breadth-first search."""

    def forest(ids: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
        edges, rest = [], np.arange(len(ids))
        while len(rest):
            frontier, rest = [int(rest[0])], rest[1:]
            while frontier and len(rest):
                at = frontier.pop()
                hit = (sketches[rest] == sketches[at]).sum(axis=1) >= agree
                found = rest[hit].tolist()
                edges += [(int(ids[at]), int(ids[k])) for k in found]
                frontier += found
                rest = rest[~hit]
        return edges

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for ids, sketches in _grouped(parts, ("path", "i", "j"), ("cid", "sketch")):
            if len(ids) > 1:
                out += forest(np.array(ids, np.int64), np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, WIDTH))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links with 100 * intersection >= percent * union, all pairs considered."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[b] = a
            if ids[i] != ids[j]:
                edges.append((int(ids[i]), int(ids[j])))

    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) <= 12:
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                lo, hi = min(sizes[i], sizes[j]), max(sizes[i], sizes[j])
                if 100 * lo >= percent * hi and find(i) != find(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                        link(i, j)
        return edges
    owner = np.repeat(np.arange(len(sets)), sizes)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    shared = np.bincount(code)[code] > 1
    owner, code = owner[shared], code[shared]
    code = np.unique(code, return_inverse=True)[1] if len(code) else code
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(code.max()) + 1 if len(code) else 0, 4096):
        at = (code >= lo) & (code < lo + 4096)
        marks = np.zeros((len(sets), 4096), np.float32)
        marks[owner[at], code[at] - lo] = 1
        both += marks @ marks.T
    both = both.astype(np.int64)
    hits = np.argwhere(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
    for i, j in hits.tolist():
        link(i, j)
    return edges


def _confirm(width: int, percent: int):
    """Rows sorted by (grp, i, j), each a member's shingle set; confirmed edges of each task group."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for ids, sets in _grouped(parts, ("grp", "i", "j"), ("cid", "shingles")):
            if len(ids) > 1:
                out += _forest(np.array(ids, np.int64), [np.frombuffer(x, np.uint64) for x in sets], percent)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _bloom_places(doc_id: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(bits)) for seed in range(BLOOM_HASHES)]


def _bloom(ids: DataFrame) -> tuple[np.ndarray, int]:
    """Bloom filter of the column cid; at most 2**BLOOM_BITS bits, whatever the number of ids."""
    bits = 1 << min(BLOOM_BITS, max(10, (10 * ids.count()).bit_length()))
    places = ids.select(F.explode(F.array(*_bloom_places(F.col("cid"), bits))).alias("p"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(63).cast("int"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(mask).alias("m"))
    table = np.zeros(max(1, bits // 64), np.int64)
    for row in words.toLocalIterator():
        table[row["w"]] = row["m"]
    return table, bits


def _member_sets(width: int, bloom):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_words()
        words = bloom.value
        for part in batches(parts):
            hit = np.ones(part.num_rows, bool)
            for k in range(BLOOM_HASHES):
                p = part.column(f"p{k}").to_numpy(zero_copy_only=False)
                hit &= ((words[p >> 6] >> (p & 63)) & 1).astype(bool)
            part = part.filter(pa.array(hit))
            sets = [shingle_set(t, width) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())],
                names=["doc_id", "shingles", "n"],
            )

    return run


def _confirmed(docs: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the confirmed links between the members (cid) of each candidate group (grp).

    A Bloom filter of the members picks their texts where they are read, so only members' sets are shuffled."""
    words, bits = _bloom(groups)
    places = [c.alias(f"p{k}") for k, c in enumerate(_bloom_places(F.col("doc_id"), bits))]
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text", *places)
    bloom = docs.sparkSession.sparkContext.broadcast(words)
    found = texts.mapInArrow(_member_sets(width, bloom), "doc_id bigint, shingles binary, n bigint").where("n > 0")
    sets = materialize(found.join(groups, F.col("doc_id") == F.col("cid")).select("cid", "grp", "shingles", "n"), "sets")
    sizes = sets.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), (F.sum("n") * 8).alias("bytes"))
    blocks = sizes.select("grp", "m", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))

    def compare(dealt: DataFrame) -> DataFrame:
        dealt = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        return dealt.mapInArrow(_confirm(width, percent), "u bigint, v bigint")

    return _linked(sets.join(blocks, "grp"), "grp", "shingles", compare)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``width``-word shingles have 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id that a document reaches."""
    spark = docs.sparkSession
    batch_rows(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_sign(width), SIGNED), "signed")
    classes = materialize(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min(F.struct("doc_id", "sig")).alias("x"))
        .select("k1", "k2", F.col("x.doc_id").alias("cid"), "x.sig"),
        "classes",
    )
    at = {name: scratch_path(spark, name) for name in ("groups", "linked")}
    with scratch_scope(spark):
        candidates = _candidates(classes, percent / 100)
        groups = materialize(candidates.select(F.col("node").alias("cid"), F.col("component").alias("grp")), "groups", at["groups"])
    with scratch_scope(spark):
        found = materialize(_confirmed(docs, groups, width, percent), "linked", at["linked"])
    by_class = classes.select("k1", "k2", "cid").join(found, F.col("cid") == F.col("node"), "left")
    by_class = materialize(by_class.select("k1", "k2", F.coalesce("component", "cid").alias("of_class")), "class_components")
    linked = F.col("n_shingles") > 0
    joined = signed.select("doc_id", "n_shingles", "k1", "k2").join(by_class, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(linked, F.col("of_class")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of near duplicates, all columns whatever their names.

    Here a document is a doc_id and a text: rows that share a doc_id, or have none, are documents of their own if their
    texts differ, and stay unless they are near duplicates; of rows alike in both, one stays. A null text, or one without
    words, is linked with nothing. Only ids and hashes are compared for that; texts are moved once, to be
    joined with the ids that stay."""
    names = docs.columns
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), as_row(docs))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    keys = materialize(rows.groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")), "keys")
    several = keys.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 or doc_id is null").select(F.col("doc_id").alias("s_id"), F.lit(True).alias("several"))
    several = materialize(several, "several")
    again = materialize(keys.where("n > 1").select(F.col("doc_id").alias("a_id"), F.col("h1").alias("a1"), F.col("h2").alias("a2")), "again")
    if not again.isEmpty():
        same = F.expr("doc_id <=> a_id AND h1 = a1 AND h2 = a2")
        first = rows.join(again, same, "left_semi").groupBy("doc_id", "h1", "h2").agg(F.first("text").alias("text"), F.first("row").alias("row"))
        rows = rows.join(again, same, "left_anti").unionByName(first)
    # documents whose id isn't theirs alone get numbers above all others
    other = F.xxhash64("doc_id", "h1", "h2").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = rows.join(several, F.expr("doc_id <=> s_id"), "left").withColumn("own_id", F.when(F.col("several"), other).otherwise(F.col("doc_id")))
    found = near_duplicates(rows.select(F.col("own_id").alias("doc_id"), "text"), width, percent)
    kept = materialize(found.where("kept").select(F.col("doc_id").alias("own_id")).distinct(), "kept")
    # one plan at every size: ids of what stays are hashed in each task, texts are not sorted
    return from_row(rows.join(kept.hint("shuffle_hash"), "own_id", "left_semi"), names)
