"""Each registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from sheerlight import queries as Q
from sheerlight.operators import detect
from sheerlight.sources import pages as P

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canon(rows, order):
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, sql, name):
    df = Q.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in Q.ORACLES:
        want = sql.sql(Q.ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        columns = sorted(df.columns)
        assert canon(rows, [df.columns.index(c) for c in columns]) == canon(want.fetchall(), [want.columns.index(c) for c in columns])


def test_repairs(spark):
    rows = {r.doc_id: r.tail for r in Q.typoglycemia_repair(spark, SF).collect()}
    assert [rows[k] for k in range(5)] == Q.REPAIRED


@pytest.fixture
def larger(spark, tmp_path):
    """Makes a folder of made-up tables, and gives it with what a query's SQL says about them."""

    def made(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path / t}.parquet/*.parquet')")
        df, want = Q.QUERIES[name](spark, str(tmp_path)), con.sql(Q.ORACLES[name])
        columns = sorted(df.columns)
        return canon(df.collect(), [df.columns.index(c) for c in columns]), canon(want.fetchall(), [want.columns.index(c) for c in columns])

    return made


def test_code_points_of_two_bytes(spark, larger):
    """Keys beyond those of the smallest tables reach selectors from 128 on; alone, such a byte is no finding."""
    got, want = larger("code_points", part=spark.range(1, 1300).withColumnRenamed("id", "p_partkey"))
    assert got == want
    lone = spark.createDataFrame([(Q._SPELL + Q._selectors("a")[0] + chr(0xE0100 + b - 16),) for b in (128, 143, 255)], "text string")
    assert [r.n for r in lone.select(F.size(detect.variation_selectors(F.col("text"))).alias("n")).collect()] == [0, 0, 0]


@pytest.mark.parametrize("name", ["scan_text_documents", "worst_severity_by_lang"])
def test_planted_tokens_after_dotted_triples(spark, larger, name):
    """A host or an address at the end of the row's own text is no part of what is planted after it."""
    rows = [(k, "write to mail7.example.com" if k % 2 else "at 61.131.143.9", "en") for k in range(32)]
    got, want = larger(name, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got == want


def test_references_without_a_semicolon(spark, larger):
    """They count as the source has them, as in the SQL; scans read them as HTML does."""
    pages = ["<h1>a &amp;&amp</h1>", "<p>&lt &#65 x &notit &amp;lt</p>", '<p title="?a=1&lt=2">AT&T &copy;</p><!-- AT&T &amp -->', "<p>a & b &&amp; &lt;&quot;</p>"]
    df = spark.createDataFrame([(k, f"http://a/{k}", f"<html><body>{x}</body></html>") for k, x in enumerate(pages)], "page_id long, url string, html string")
    got, want = larger("page_text_nodes", pages=df)
    assert got == want
    assert [r.text for r in P.page_nodes(df.filter("page_id = 0")).collect()] == ["a &&"]


def test_entry_survives_without_the_optional_parts():
    import importlib.util

    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(Q.ORACLES) <= set(e.oracle_sql())
    if importlib.util.find_spec("sheerlight.llm") is None:
        assert set(e.queries()) == set(Q.QUERIES)


def test_streams(spark, tmp_path):
    """A file source, scanned batch by batch."""
    from sheerlight.plans.scan import page_summary
    from sheerlight.streaming.scan import scan_page_stream

    page = spark.createDataFrame([(1, "http://a", "<p>you are now"), (2, "http://b", "<p>x")], "page_id long, url string, html string")
    page.write.parquet(str(tmp_path / "in"))
    got = {}
    q = scan_page_stream(spark.readStream.schema(page.schema).parquet(str(tmp_path / "in")), lambda df, k: got.update({r.page_id: r["count"] for r in df.collect()}), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert got == {1: 1, 2: 0} == {r.page_id: r["count"] for r in page_summary(page).collect()}
