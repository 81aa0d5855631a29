"""Every query outside the llm folder against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from verso.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    mine = got.select(*columns).collect()
    assert mine
    if name not in catalogue.SQL:
        return
    rel = con.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == columns
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, mine), key=key) == sorted(theirs, key=key)


def test_titles_cut_inside_an_entity(spark, tmp_path):
    """A title that ends in a cut entity stays as it is in SQL, while the text reads it."""
    bodies = ["<h1>Rain &amp;&amp; sun&amp;&amp</h1><p>a &amp; b</p>", "<h1> </h1><h2>One &lt;two&gt; &amp</h2><p>c</p>", f"<h1>{'x' * 200}</h1><h3>Three</h3>", "<p>none</p>", None]
    pages = [(i, f"https://a.example/{i}", b and f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    mine = catalogue.QUERIES["html_to_text_dom"](spark, str(tmp_path)).select("page_id", "text", "title").orderBy("page_id").collect()
    theirs = c.sql(f"SELECT page_id, text, title FROM ({catalogue.SQL['html_to_text_dom']})").fetchall()
    assert [tuple(r) for r in mine] == sorted(theirs) and mine[0]["title"].endswith("&amp")
