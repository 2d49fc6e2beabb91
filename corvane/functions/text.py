"""Text expressions: names, Markdown, normal forms, README state. All are built-in column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

README_CHARS = 8192
_SPACE = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"

#: Fixed values.
TRIGRAM_THRESHOLD = 0.3
FUZZY_MAX_TOKENS = 2


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for a row however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def sequence(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def words(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, in order of first use (the ``simple`` analyzer)."""
    return F.array_distinct(sequence(text))


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{_SPACE}+", " "))


def norm_key(text: Column) -> Column:
    """Comparison key without case, white space and ``-._``."""
    return F.regexp_replace(F.lower(text), r"[\s\-._]+", "")


def norm_name(text: Column) -> Column:
    """Lower case without ``-._``."""
    return F.translate(F.lower(text), "-._", "")


def like_prefix(text: Column) -> Column:
    """A LIKE pattern for what starts with ``text``: backslash, percent and underscore are escaped."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))
    return F.concat(escaped, F.lit("%"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded with two spaces before and one after."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(parts, of_word)))


def trigram_similarity(shared: Column, left: Column, right: Column) -> Column:
    """Shared trigrams as a share of all, in single precision as stored."""
    return F.try_divide(shared, left + right - shared).cast("float").cast("double")


def strip_markdown(text: Column) -> Column:
    """Inline Markdown reduced to what it shows; images go before links. The patterns are fixed values."""
    for pattern, to in (
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]*)\]\(\s*[^)]*\)", "$1"),
        (r"\[([^\]]*)\]\[[^\]]*\]", "$1"),
        (r"`([^`]*)`", "$1"),
        (r"<[^>\n]{1,120}>", " "),
        (r"\*{1,3}|_{2,3}", ""),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def finalize_readme(text: Column) -> tuple[Column, Column]:
    """(status, content): stripped, cut to the limit; what is then blank is ``empty``."""
    content = F.left(strip(text), F.lit(README_CHARS))
    return F.when(F.length(content) > 0, "ok").otherwise("empty"), F.when(F.length(content) > 0, content)


def grade(text: Column) -> Column:
    """The grade of a verdict ``final score: 0..3``, else null."""
    found = F.regexp_extract(F.lower(text), r"final score:\s*([0-3])", 1)
    return F.when(found != "", found.cast("int"))


def sane_strings(values: Column, cap: int, max_len: int) -> Column:
    """White space collapsed, empty and long values dropped, the first of those alike but for case kept, capped."""
    fit = F.filter(F.transform(values, collapse), lambda v: (v != "") & (F.length(v) <= max_len))

    def add(kept: Column, v: Column) -> Column:
        known = F.exists(kept, lambda k: F.lower(k) == F.lower(v))
        return F.when(known, kept).otherwise(F.concat(kept, F.array(v)))

    return F.slice(F.aggregate(fit, F.array().cast("array<string>"), add), 1, cap)
