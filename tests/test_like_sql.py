"""Queries against their SQL on rows that the given tables hold rarely or not at all."""

import duckdb

from weftline.operators import corpus
from weftline.queries import ORACLE_SQL, QUERIES


def both(spark, folder, query, name, rows, schema):
    """Sorted rows of a query and of its SQL over one table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[query])
    names = [c[0] for c in want.description]
    plain = lambda rs: sorted(tuple(map(str, r)) for r in rs)
    return plain(QUERIES[query](spark, str(folder)).select(*names).collect()), plain(want.fetchall())


def test_documents_without_a_part(spark, tmp_path):
    rows = [(1, "a b", "en", "s"), (2, None, "en", "s"), (3, "", "de", "s"), (4, "x", None, "s"), (5, "y\n", "", None), (6, None, None, None), (None, "z", "fr", "s"), (8, "é" * 70, "fr", "s")]
    got, want = both(spark, tmp_path, "fn11_document_text", "documents", rows, "doc_id long, text string, lang string, source string")
    assert got == want and len({w for _, w in got}) == len(rows)


def test_titles_of_odd_pages(spark, tmp_path):
    heads = ["<h1>a&amp;b&amp</h1>", "<h1 class='x'>\u3000a\n\t b\x0bc&lt;&quot;&#x27;&gt;&nbsp;&#39;\u00a0 </h1>", "<h1></h1><h1>b</h1>", "<h1><b>a</b></h1><h1>c</h1>", "<title>t</title>", "<H1>a</H1>", "", None, "<h1>&amp;lt;</h1>", "<h1>a</h1", "<h1>a\r\n</h1>"]
    got, want = both(spark, tmp_path, "fn32_page_titles", "pages", list(enumerate(heads)), "page_id long, html string")
    assert got == want and dict(got)["0"] == "a&b&amp"


def test_pages_of_one_url_give_one_harvest(spark):
    """Links at the same place of two pages of a URL: the SQL leaves their order open, the query does not."""
    rows = [(k, f"http://u{k % 40}", f'<a href="/{k}-x"><a href="/{k}-y">') for k in range(400)]
    runs = [corpus.harvest(spark.createDataFrame(rows[::step], "page_id long, url string, html string").repartition(n), "http://site.example/", "/", 5, (), 5, ties=["page_id"]) for n, step in ((1, 1), (7, -1))]
    one, two = ([sorted(map(tuple, r.collect())) for r in runs])
    assert one == two and ("http://u3", 2, "http://site.example/43-x") in one
