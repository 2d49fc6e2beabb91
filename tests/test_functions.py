from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import analyze, ranking, text
from corvane.sources import shards


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in values.items())) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_name_forms_and_like(spark):
    assert one(spark, text.norm_name(F.col("a")), a="Next.js") == "nextjs"
    assert one(spark, text.norm_name(F.col("a")), a="vercel/next.js") == "vercel/nextjs"
    assert one(spark, text.like_prefix(F.col("a")), a="50%_off\\x") == "50\\%\\_off\\\\x%"


def test_trigram_similarity(spark):
    for a, b, want in (("word", "two words", 4 / 11), ("pytorch", "pytorhc", 5 / 11)):
        ta, tb = text.trigrams(F.col("a")), text.trigrams(F.col("b"))
        got = one(spark, text.trigram_similarity(F.size(F.array_intersect(ta, tb)), F.size(ta), F.size(tb)), a=a, b=b)
        assert got == pytest.approx(want, abs=1e-6)


def test_markdown_and_readme(spark):
    assert one(spark, text.strip_markdown(F.col("a")), a="![i](u) [a](b) **c** `d` <br> e_f") == "a c d e_f"
    status, content = text.finalize_readme(F.col("a"))
    assert one(spark, status, a=" \n ") == "empty"
    assert len(one(spark, content, a=" " + "x" * 9000)) == 8192
    assert one(spark, text.grade(F.col("a")), a="ok. Final score: 2") == 2
    assert one(spark, text.grade(F.col("a")), a="none") is None


def test_recency_and_blend_terms(spark):
    now = datetime(2024, 1, 1, tzinfo=UTC)
    at = lambda s: ranking.recency(F.lit(s).cast("timestamp"), now, 365.0)
    assert one(spark, at("2024-01-01 00:00:00")) == pytest.approx(1.0)
    assert one(spark, at("2030-01-01 00:00:00")) == pytest.approx(1.0)
    assert one(spark, at("2023-01-01 00:00:00")) == pytest.approx(0.25 + 0.75 / 2)
    assert one(spark, at(None)) == 0.0
    assert one(spark, ranking.minmax(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 1.0
    assert one(spark, ranking.demotion(F.lit(True), F.lit(True))) == 0.5
    assert one(spark, ranking.rrf(F.lit(1), F.lit(None).cast("int"), F.lit(2))) == pytest.approx(1 / 21 + 0.5 / 22)


@pytest.mark.parametrize(
    "word, stem",
    [("consigned", "consign"), ("consolation", "consol"), ("knightly", "knight"), ("happiness", "happi"), ("hopping", "hop"), ("hoping", "hope"), ("flies", "fli"), ("dies", "die"),
     ("databases", "databas"), ("libraries", "librari"), ("agreed", "agre"), ("skies", "sky"), ("national", "nation"), ("controlling", "control"), ("by", "by")],
)
def test_stems(word, stem):
    assert analyze.stem(word) == stem


def test_websearch(spark):
    groups = analyze.parse_websearch('web "state machine" -php or rust')
    assert [[(t.lexemes, t.negated) for t in g] for g in groups] == [[(("web",), False), (("state", "machin"), False), (("php",), True)], [(("rust",), False)]]
    rows = spark.createDataFrame([(1, "web state machine"), (2, "machine state web"), (3, "web state machine php"), (4, "Rust")], "id int, t string")
    hit = analyze.matches(groups, analyze.english_words(F.col("t")), analyze.english_sequence(F.col("t")))
    assert [r.id for r in rows.where(hit).orderBy("id").collect()] == [1, 4]
    assert analyze.parse_websearch("the of") == []
    assert not rows.where(analyze.matches([], analyze.english_words(F.col("t")))).collect()
    assert analyze.query_lexemes("zebra apple the") == ["appl", "zebra"]


def test_shards(spark):
    rows = shards.shard_table(spark).orderBy("lo").collect()
    assert len(rows) == 569 and rows[-1].hi is None and rows[0].lo == 200
    assert all(a.hi + 1 == b.lo for a, b in zip(rows, rows[1:], strict=False))
    for lo, hi, n in ((200, 400, 200), (400, 1000, 300), (1000, 2000, 20), (2000, 5000, 30), (5000, 10000, 10), (10000, 50000, 8)):
        assert sum(lo <= r.lo < hi for r in rows) == n
    with pytest.raises(ValueError):
        shards.shard_table(spark, 100)
    since = shards.fragments(shards.shard_table(spark), datetime(2024, 5, 6, 23)).orderBy("lo").first().fragment
    assert since == "stars:200..200 pushed:>=2024-05-06"


@settings(max_examples=15, deadline=None)
@given(st.integers(200, 60_000))
def test_shards_cover_from_any_start(spark, least):
    rows = sorted((r.lo, r.hi) for r in shards.shard_table(spark, least).collect())
    assert rows[0][0] == min(least, 50_000)
    assert all(hi + 1 == nxt for (_, hi), (nxt, _) in zip(rows, rows[1:], strict=False))
