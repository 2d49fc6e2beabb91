"""Every registered query of the search and ranking operators against its SQL in DuckDB."""

import pytest
from oracle import compare, connect

from corvane.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_oracle(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_whole_readmes_are_searched(spark, tmp_path):
    """fts10: a query's words are found after character 2,500 of a README, and a word that this cuts in two isn't (before, the reverse)."""
    sf, far, near = str(tmp_path), "x " * 1500, "x " * 500
    half = f"{near}beta gamma delta "
    texts = {1: f"{far}alpha beta gamma delta", 2: f"alpha beta {far}gamma delta", 3: f"{far}alpha beta gamma", 4: half + "x" * (2494 - len(half)) + " alphabet", 5: f"{near}alpha beta gamma delta", 6: None, 10: f"{far}alpha beta gamma delta"}
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "none"), (2, "Alpha beta, gamma delta"), (4, "x")], "item_id bigint, text string").coalesce(1).write.parquet(f"{sf}/benchmark.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").coalesce(1).write.parquet(f"{sf}/embeddings.parquet")
    con = connect(SF)
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    name = "fts10_whole_query_in_readme"
    found = {(r["query_id"], r["repo_id"]) for r in QUERIES[name](spark, sf).collect()}
    assert found == {(2, "d1"), (2, "d5")}
    assert compare(spark, con, QUERIES[name], SQL[name], sf) == ""
    begun = [k for k in sorted(SQL) if k.startswith("fts07")]
    assert begun and all(compare(spark, con, QUERIES[k], SQL[k], sf) == "" for k in begun)
