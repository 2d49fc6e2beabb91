"""English full-text analysis: tokens, stop words, Porter2 stems, and web-style queries.

Tokens are runs of letters and digits; a hyphenated word gives itself and its parts. The analyzer is one Arrow
UDF; ``corvane.functions.text.words`` is the plain analyzer of built-ins."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

# The public Snowball English stop words and the stemmer's exceptions.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can
    will just don should now""".split()
)
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"


def _region(word: str, start: int) -> int:
    found = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return found.end() if found else len(word)


def _short_end(w: str) -> bool:
    return bool(re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", w))


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", w)
    prefix = re.match("gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()
    if found := re.search("(eedly|eed)$", w):
        if found.start() >= r1:
            w = w[: found.start()] + "ee"
    elif (found := re.search("(ingly|edly|ing|ed)$", w)) and re.search("[aeiouy]", w[: found.start()]):
        w = w[: found.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end, to in STEP_2:
        if w.endswith(end):
            at = len(w) - len(end)
            fits = at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple(LI_ENDINGS))
            w = w[:at] + to if fits else w
            break
    for end, to in STEP_3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + to
            break
    for end in STEP_4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def tokens(text: str) -> list[str]:
    found = []
    for m in re.finditer(r"[^\W_]+(?:-[^\W_]+)*", text.lower()):
        parts = m[0].split("-")
        found += [m[0], *parts] if len(parts) > 1 else parts
    return found


def analyze(text: str | None) -> list[str]:
    """Stems in order, stop words left out."""
    return [stem(t) for t in tokens(text or "") if t not in STOP_WORDS]


def positions(text: str | None) -> list[str | None]:
    """A stem or, for a stop word, null at each position."""
    return [None if t in STOP_WORDS else stem(t) for t in tokens(text or "")]


def plain_positions(text: str | None) -> list[str | None]:
    """``corvane.functions.text.sequence`` of one text."""
    return re.findall(r"[^\W_]+", (text or "").lower())


@arrow_udf(ArrayType(StringType()))
def _english(texts: pa.Array) -> pa.Array:
    return pa.array([list(dict.fromkeys(analyze(t))) if t is not None else None for t in texts.to_pylist()], pa.list_(pa.string()))


def english_words(text: Column) -> Column:
    """Distinct English lexemes, in order of first use."""
    return _english(text)


@arrow_udf(ArrayType(StringType()))
def _english_all(texts: pa.Array) -> pa.Array:
    return pa.array([analyze(t) if t is not None else None for t in texts.to_pylist()], pa.list_(pa.string()))


def english_sequence(text: Column) -> Column:
    """All English lexemes in order, for phrases."""
    return _english_all(text)


@arrow_udf(ArrayType(StringType()))
def _english_positions(texts: pa.Array) -> pa.Array:
    return pa.array([positions(t) if t is not None else None for t in texts.to_pylist()], pa.list_(pa.string()))


def english_positions(text: Column) -> Column:
    """The English lexeme at each position, null for a stop word."""
    return _english_positions(text)


@dataclass(frozen=True)
class Term:
    """A word or phrase of a web-style query; ``offsets`` are the lexemes' places from the first on."""

    lexemes: tuple[str, ...]
    negated: bool = False
    offsets: tuple[int, ...] = ()


def parse_websearch(query: str, analyzer=analyze) -> list[list[Term]]:
    """Alternatives (OR) of conjunctions: words, "phrases" and -negations; terms without a lexeme drop out.

    An analyzer that gives null at the places of stop words keeps the distances within a phrase."""
    groups: list[list[Term]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', query):
        if m[3] is not None and m[3].lower() == "or":
            groups.append([])
            continue
        raw = m[2] if m[3] is None else m[3]
        negated = m[1] == "-" if m[3] is None else raw.startswith("-")
        found = [(i, x) for i, x in enumerate(analyzer(raw.lstrip("-") if m[3] is not None else raw)) if x is not None]
        if found:
            groups[-1].append(Term(tuple(x for _, x in found), negated, tuple(i - found[0][0] for i, _ in found)))
    return [g for g in groups if g]


def matches(groups: list[list[Term]], lexemes: Column, sequence: Column | None = None) -> Column:
    """Whether a record's lexemes meet the query; phrases need the ordered sequence. An empty query matches nothing."""

    def one(term: Term) -> Column:
        hit = F.lit(True)
        for x in term.lexemes:
            hit = hit & F.array_contains(lexemes, x)
        if len(term.lexemes) > 1 and sequence is not None:
            # lexemes hold no spaces
            hit = hit & F.contains(F.concat(F.lit(" "), F.array_join(sequence, " "), F.lit(" ")), F.lit(f" {' '.join(term.lexemes)} "))
        return ~hit if term.negated else hit

    found = F.lit(False)
    for g in groups:
        every = F.lit(True)
        for term in g:
            every = every & one(term)
        found = found | every
    return found


def query_lexemes(query: str, analyzer=analyze, slots: int = 8) -> list[str]:
    """The query's slots: its distinct lexemes in sorted order, the first eight."""
    return sorted(set(analyzer(query)))[:slots]
