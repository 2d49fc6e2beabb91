"""Documents for embedding, judging and guides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import collapse, sane_strings

#: Fixed values.
SOURCE_CHARS, ENRICHMENT_CHARS, JUDGE_README_CHARS, GUIDE_README_CHARS = 2500, 600, 1500, 12000
PAYLOAD_DESCRIPTION_CHARS = 800
CAPS = {"queries": (8, 120), "aliases": (5, 40), "categories": (6, 60)}


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def build_text(columns: set[str], max_chars: int = SOURCE_CHARS) -> Column:
    """Header, labelled lines, enrichment description, blank line and README of a record; empty parts are left out."""
    has = lambda c: c in columns

    def listed(label: str, c: str, sep: str) -> Column:
        joined = F.array_join(c, sep) if has(c) else F.lit(None).cast("string")
        return F.when(F.size(c) > 0, F.concat(F.lit(label), joined)) if has(c) else joined

    text = lambda c: _filled(F.col(c)) if has(c) else F.lit(None).cast("string")
    parts = [
        F.coalesce(F.concat("full_name", F.lit(": "), text("description")), F.col("full_name")),
        F.concat(F.lit("Language: "), text("primary_language")),
        listed("Topics: ", "topics", ", "),
        listed("Also known as: ", "aliases", ", "),
        listed("Categories: ", "categories", ", "),
        listed("Common queries: ", "queries", "; "),
        F.left(text("enrichment_description"), F.lit(ENRICHMENT_CHARS)),
        F.concat(F.lit("\n"), text("readme")),
    ]
    return F.left(F.array_join(F.array_compact(F.array(*parts)), "\n"), F.lit(max_chars))


def source_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fold_enrichment(enrichment: DataFrame) -> DataFrame:
    """One row a record: lists in source order without repeats, descriptions joined by line breaks."""
    rows = F.array_sort(F.collect_list(F.struct("source", *[c for c in ("queries", "aliases", "categories", "description") if c in enrichment.columns])))
    folded = enrichment.groupBy("repo_id").agg(rows.alias("r"))
    out = [F.col("repo_id")]
    for c in ("queries", "aliases", "categories"):
        if c in enrichment.columns:
            out.append(F.array_distinct(F.flatten(F.filter(F.col(f"r.{c}"), lambda x: x.isNotNull()))).alias(c))
    texts = F.filter(F.transform("r", lambda x: x["description"]), lambda d: d.isNotNull() & (d != ""))
    return folded.select(*out, F.when(F.size(texts) > 0, F.array_join(texts, "\n")).alias("description"))


def assemble_payload(df: DataFrame) -> DataFrame:
    """Generated fields cleaned and capped; rows where nothing is left go."""
    df = df.withColumn("description", _filled(F.left(collapse(F.coalesce("description", F.lit(""))), F.lit(PAYLOAD_DESCRIPTION_CHARS))))
    for c, (cap, size) in CAPS.items():
        df = df.withColumn(c, sane_strings(F.coalesce(c, F.array().cast("array<string>")), cap, size))
    return df.where(F.col("description").isNotNull() | (F.size("queries") + F.size("aliases") + F.size("categories") > 0))


def judge_passage(readme_chars: int = JUDGE_README_CHARS) -> Column:
    none = lambda c: F.coalesce(_filled(c), F.lit("(none)"))
    return F.concat(
        F.lit("Repository: "), F.col("full_name"),
        F.lit("\nDescription: "), none(F.col("description")),
        F.lit("\nLanguage: "), none(F.col("primary_language")),
        F.lit("\nTopics: "), none(F.array_join("topics", ", ")),
        F.lit("\nREADME: "), none(F.left("readme", F.lit(readme_chars))),
    )


def guide_prompt(readme_chars: int = GUIDE_README_CHARS) -> Column:
    """What a guide is written from: the record's header and its README, cut."""
    line = lambda label, c: F.concat(F.lit(label), c)
    return F.concat_ws(
        "\n", line("Repository: ", F.col("full_name")), line("Description: ", _filled(F.col("description"))), line("Language: ", _filled(F.col("primary_language"))),
        line("Topics: ", _filled(F.array_join("topics", ", "))), line("\nREADME:\n", _filled(F.left("readme", F.lit(readme_chars)))),
    )


def trim_preamble(guide: Column, heading: str = "## What it is") -> Column:
    """A guide from its first heading on; as it is without one."""
    at = F.instr(guide, heading)
    return F.when(at > 0, F.substring(guide, at, F.length(guide))).otherwise(guide)


def shown_file(content: Column, max_chars: int = 20_000) -> Column:
    """File text cut to a limit; null for a binary (a NUL among the first 1,024 characters)."""
    binary = F.contains(F.left(content, F.lit(1024)), F.lit("\0"))
    return F.when(~binary, F.when(F.length(content) > max_chars, F.concat(F.left(content, F.lit(max_chars)), F.lit("\n[truncated]"))).otherwise(content))


def consistent_queries(generated: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, threshold: float = 0.45) -> DataFrame:
    """repo_id, queries: those near enough to their record's vector; a record without a vector keeps all."""
    from corvane.functions.vectors import dot

    rows = generated.select("repo_id", F.posexplode_outer("queries").alias("place", "query"))
    rows = rows.join(query_vectors, ["repo_id", "query"], "left").join(doc_vectors, "repo_id", "left")
    norm = lambda v: F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0))
    near = dot(F.col("doc_vector"), F.col("query_vector")) / (norm(F.col("doc_vector")) * norm(F.col("query_vector"))) >= threshold
    kept = F.when(F.col("query").isNotNull() & (F.col("doc_vector").isNull() | F.coalesce(near, F.lit(False))), F.struct("place", "query"))
    return rows.groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["query"]).alias("queries"))
