"""Character references that were cut, as in SQL."""

import duckdb
import pytest

from provenant.plans.queries import ORACLES, QUERIES
from provenant.sources import html_units

ODD = [
    "<html><head><title>One &amp;&amp;&amp</title></head><body><h1>A heading that is long enough &amp</h1><p>Text &lt;b&gt of a paragraph &copy;, &copyleft and &#39 on &amplify; it</p></body></html>",
    "<html><head><title>Two</title></head><body><script>a &lt b</script><!-- &amp --><p>Nothing of this was cut, &quot;as all&quot; can see &middot; here</p></body></html>",
]


@pytest.mark.parametrize("name", ["page_metadata", "page_texts", "units_html"])
def test_references_without_their_end_stay_as_in_sql(spark, tmp_path, name):
    # page_id 5 and 13 get no tags in page_metadata; its SQL and units_html's know fewer references than page_texts'.
    pages = [h if name == "page_texts" else h.replace("&copy;", "").replace("&middot;", "") for h in ODD]
    spark.createDataFrame([(5, "https://a.example/x", pages[0]), (13, "https://a.example/y", pages[1])], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))


def test_closed_references():
    assert html_units.closed_references("&amp; &#38; &#x26; &amp &#38 &nosuch; & b") == "&amp; &#38; &#x26; &amp;amp &amp;#38 &amp;nosuch; &amp; b"
    assert html_units.closed_references("<script>a && b</script> && <!-- & --> <style>&") == "<script>a && b</script> &amp;&amp; <!-- & --> <style>&"
