import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = "the of and to in is that for was on are with as his they at be this from have or by one had not but what all were when we there can an your which".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs():
    """(doc_id, text, lang, source) with nulls, empty, blank, tiny and very long texts, copies and ties."""
    rng = random.Random(4)
    base = prose(rng, 120)
    edited = base.replace("the", "THE", 1) + " end"
    far = " ".join(w if rng.random() < 0.8 else "zzz" for w in base.split())
    rows = [
        (0, base, "en", "a"),
        (1, base, "en", "a"),
        (2, edited, None, "a"),
        (3, far, "en", None),
        (4, None, "en", "a"),
        (5, "", "fr", "b"),
        (6, " \n\t ", None, None),
        (7, "word", "en", "b"),
        (8, "two words", "en", "b"),
        (9, "x " * 30_000 + prose(rng, 20_000), "en", "c"),
        (10, "é́ 中文 \U0001f600 <|endoftext|> <|im_end|> a\\b  c\r\n\x1f d e f", "de", "c"),
        (11, "Upper CASE a|b # * $ % & < > 12 345\nline one\nline one\n\nline one", "es", "c"),
        (None, base, "en", "a"),
        (None, "null id text of some words", "en", None),
        (12, "\n".join(["same line here"] * 40), "en", "a"),
    ]
    rows += [(20 + i, prose(rng, 60 + i), "en", "big") for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd_frame(spark, odd_docs):
    """The same with columns whose names clash with those the operators use."""
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, score double, cid string, path int, sig binary, t1 int, host string, _row int, ids array<int>, fill int, grp int"
    extra = ("x", 0.5, "c", 1, b"s", 2, "h", 3, [1], 4, 5)
    more = """lang_pred lang_score word_chars n_symbols n_dup_lines n_repeat_words n_words base_failed kept _words _t1 _r_id drop removed_words _nth
        row own_id h1 h2 several again component_id k1 n lines often over first_id bin parent shift spans items nth predicted held_out a.b""".split()
    kind += ", " + ", ".join(f"`{m}` string" for m in more)
    extra += tuple(f"of {m}" for m in more)
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in odd_docs], kind)


@pytest.fixture(scope="session")
def no_docs(odd_frame):
    return odd_frame.where("false")
