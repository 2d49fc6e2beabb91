"""Quality rules with DataFrame functions alone: per-document counts, and cross-document line frequency.

Line frequency: each line with a word is normalised (lower case, numbers to 0, white space folded) and
hashed to 128 bits. Per host, the distinct documents that hold a line are counted; a line above the limit is
boilerplate of that host and is removed. A document left with too few of its words is rejected. The lowest
doc_id that has a line keeps it: without that, a text with more copies on a host than the limit would be lost
with all its copies, and no later stage could keep one.

Lines are hashed once and kept as one row a document. Counting shuffles (host, hash) rows that are aggregated before,
so a host with a third of all rows costs no more than others; only lines over the limit are joined back, and
only for them are rows that share a doc_id told apart.

Defined results: a null text has no words and no lines, is base_failed and not kept; a null source is a
host of its own; rows with an equal doc_id are judged row by row and count as one document of a line;
a row with a null doc_id is not counted and keeps no line over the limit; columns other than doc_id, text and
source are not read, and ``clean`` returns all columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import as_row, from_row, materialize

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEATED_PERCENT = 50
#: A line is boilerplate if over this many documents of a host hold it, however large the host.
LINE_DOCS = 20
#: A document with less than this percentage of its words left is depleted.
LEFT_PERCENT = 50


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for a row however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    A window's hash and its place share one integer: as many low bits as the places need, the hash above
    them. Sorted, equal windows are neighbours; neighbours count only if their words are equal."""

    def covered(w: Column) -> Column:
        n = F.size(w) - 2
        shift = F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int") + 1
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def keyed(h: Column, bits: Column) -> Column:
            mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
            code = F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("bigint")))

            def place(x: Column) -> Column:
                return x.bitwiseAND(mask).cast("int")

            def same(x: Column, y: Column) -> Column:
                alike = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
                p, q = place(x), place(y)
                equal = F.lit(True)
                for k in range(3):
                    equal = equal & (F.get(w, p + k) == F.get(w, q + k))
                return alike & equal

            def repeated(s: Column) -> Column:
                twice = F.filter(s, lambda x, i: ((i > 0) & same(x, F.get(s, i - 1))) | ((i < n - 1) & same(x, F.get(s, i + 1))))
                return F.sort_array(F.transform(twice, place))

            return let(F.sort_array(code), repeated)

        def total(places: Column) -> Column:
            # each window adds the words up to the next repeated window, three at most
            steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        def of_hashes(h: Column) -> Column:
            none = F.size(F.array_distinct(h)) == n
            return F.when(none, F.lit(0).cast("bigint")).otherwise(let(let(shift, lambda bits: keyed(h, bits)), total))

        return F.when(n < 2, F.lit(0).cast("bigint")).otherwise(let(hashes, of_hashes))

    return let(words, covered)


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = (
        docs.withColumn("_words", split_words(text))
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, BLANKS, "")).cast("bigint"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
        .withColumn("n_repeat_words", repeated_words(F.col("_words")))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return counts.drop("_words").withColumn("base_failed", failed)


def text_key() -> Column:
    return F.xxhash64("text")


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, t1 (hash of its text), host and lines (place, words, h1, h2 of each line with a word) of every document."""
    plain = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[\x20\x09\x0B-\x0D]+", " "), r"\b[0-9]+\b", "0")
    cut = F.transform(F.split(plain, "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("x")))
    lines = F.transform(
        F.filter(cut, lambda s: s["x"] != ""),
        lambda s: F.struct(
            s["pos"].alias("pos"),
            (F.length(s["x"]) - F.length(F.translate(s["x"], " ", "")) + 1).alias("words"),
            F.xxhash64(s["x"]).alias("h1"),
            F.xxhash64(F.lit(1), s["x"]).alias("h2"),
        ),
    )
    return docs.where("text is not null").select("doc_id", text_key().alias("t1"), F.col("source").alias("host"), lines.alias("lines"))


def removed_lines(docs: DataFrame, line_docs: int) -> DataFrame:
    """doc_id, t1, removed_words, drop (places of the lines that go), for documents that lose a line.

    Keyed by doc_id and text, so rows that repeat a document count once."""
    rows = materialize(line_rows(docs), "lines")
    held = rows.where("doc_id is not null").select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"], x["h2"])))).alias("x"))
    often = held.groupBy("host", "x.h1", "x.h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs).drop("n")
    often = materialize(often, "often").alias("o")
    each = rows.select("doc_id", "t1", "host", F.explode("lines").alias("x")).select("doc_id", "t1", "host", "x.*").alias("l")
    same = F.expr("l.host <=> o.host AND l.h1 = o.h1 AND l.h2 = o.h2")
    hits = materialize(each.join(often, same).select("l.*"), "hits")
    # rows that share a doc_id were counted one by one so far
    over = hits.groupBy("host", "h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first_id"))
    over = materialize(over.where(F.col("n") > line_docs).select("host", "h1", "h2", "first_id"), "over").alias("o")
    gone = hits.alias("l").join(over, same).where("not (l.doc_id <=> o.first_id)").select("l.doc_id", "l.t1", "l.pos", "l.words").distinct()
    return gone.groupBy("doc_id", "t1").agg(F.sum(F.col("words").cast("bigint")).alias("removed_words"), F.collect_list("pos").alias("drop"))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")
    )


def _left(left_percent: int) -> Column:
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0).cast("bigint"))
    return ~F.col("base_failed") & (100 * left >= F.lit(left_percent) * F.col("n_words"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, kept, removed_words."""
    docs = _source(docs)
    removed = removed_lines(docs, line_docs).select(F.col("doc_id").alias("r_id"), F.col("t1").alias("r_t1"), "removed_words")
    base = base_rules(docs.withColumn("t1", text_key())).select("doc_id", "t1", *COUNTS, "base_failed")
    joined = base.join(removed, F.expr("doc_id <=> r_id AND t1 = r_t1"), "left")
    words = F.coalesce("removed_words", F.lit(0).cast("bigint"))
    return joined.select("doc_id", *COUNTS, "base_failed", _left(left_percent).alias("kept"), words.alias("removed_words"))


def clean(docs: DataFrame, line_docs: int = LINE_DOCS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """The documents that stay, with their boilerplate lines removed; all columns of ``docs``."""
    removed = removed_lines(_source(docs), line_docs)
    removed = removed.select(F.col("doc_id").alias("r_id"), F.col("t1").alias("r_t1"), "removed_words", "drop")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), as_row(docs)).withColumn("t1", text_key())
    judged = base_rules(rows).drop("word_chars", "n_symbols", "n_dup_lines")
    joined = judged.join(removed, F.expr("doc_id <=> r_id AND t1 = r_t1"), "left").where(_left(left_percent))

    def rest(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("drop").isNotNull(), let(F.split("text", "\n", -1), rest)).otherwise(F.col("text"))
    return from_row(joined, docs.columns, text=text)
