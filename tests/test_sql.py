"""Queries against their DuckDB SQL on rows that the given tables hold too rarely."""

import duckdb
import pytest

from adledger.catalog import load
from adledger.catalog.views import Tables


@pytest.fixture
def both(spark, tmp_path):
    def run(name, table, df):
        path = str(tmp_path / f"{table}.parquet")
        df.coalesce(1).write.parquet(path)
        queries, sql = load()
        out = queries[name](Tables(spark, str(tmp_path)))
        db = duckdb.connect()
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
        said = db.execute(f"SELECT {', '.join(out.columns)} FROM ({sql[name]})").fetchall()
        return sorted(map(tuple, out.collect()), key=str), sorted(said, key=str)
    return run


@pytest.mark.parametrize("name", ["read_details", "detail_headingless", "fetched_pages"])
def test_prose_just_under_the_least_length(spark, both, name):
    docs = spark.createDataFrame([(3 + 4 * n, "a" * n) for n in range(78, 104)], "doc_id long, text string")
    got, said = both(name, "documents", docs)
    assert got == said


def test_entities_without_a_semicolon(spark, both):
    html = ["<b>x &amp;&amp</b> &copy y", "&amp;copy &middot; &quot", "a&ampb"]
    got, said = both("html_to_text", "pages", spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))
    assert got == said == [(0, "x && © y"), (1, '&copy · "'), (2, "a&b")]


def test_sizes_that_are_not_plausible(spark, both):
    rows = [(1, 1, 1 + 4 * i, key) for i, key in enumerate((5, 19_700, 19_701, 60_000))]
    got, said = both("size_from_payload", "lineitem", spark.createDataFrame(
        rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"))
    assert got == said
    assert {r[2]: r[3] for r in got} == {1: 305, 5: 20_000, 9: None, 13: None}
