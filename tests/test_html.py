"""One pass over a page: text, resolved links, term pairs, tables with the context before them."""

import duckdb
from pyspark.sql import functions as F

from sparkloom import queries
from sparkloom.sources.html import PageReader, answers, attachments, read_pages

PAGE = """<!DOCTYPE html><html><head><style>p{}</style><script>var t="</p><a href='/no'>";</script></head><body>
<dl><dt>Written</dt><dd>2024-05-01</dd><dt>Views</dt><dd>12</dd></dl><!-- <p>hidden</p> -->
<p>Round <b>13</b><p>Public   law&nbsp;&amp; more<br>next</p><span></span>
<table><tr><th>No.</th><th>Answer</th></tr><tr><td> 1 </td><td>3</td></tr><tr><td>2</td><td>5</td></tr></table>
<span>Civil</span></div>
<table><tr><td>No.</td><td>Answer</td><td>1</td><td>4</td><td>1</td><td>2</td></tr></table>
<table><tr><td>No.</td><td>7</td></tr></table>
<a href="/f/77/download.do"> File <i>one</i> </a><a href="x/8/download.do">two<a>none</a><a href="#top">top</a></body></html><p"""


def test_page():
    page = PageReader(PAGE)
    assert page.text().split("\n")[:8] == ["Written", "2024-05-01", "Views", "12", "Round", "13", "Public law & more", "next"]
    assert "hidden" not in page.text() and "var t" not in page.text()
    assert page.links("http://h.org/a/b", "download.do") == [("http://h.org/f/77/download.do", "File one"), ("http://h.org/a/x/8/download.do", "two none top")]
    assert page.pairs() == {"Written": "2024-05-01", "Views": "12"}
    assert [cells for _, cells in page.tables()] == [["No.", "Answer", "1", "3", "2", "5"], ["No.", "Answer", "1", "4", "1", "2"], ["No.", "7"]]
    # the first paragraph is never closed, so its text is all that follows
    context = " ".join(page.tables()[1][0].split())
    assert context.startswith("Round 13 Public law & more next No. Answer") and context.endswith("Public law & more next Civil")
    assert PageReader(None).text() == "" and PageReader("<p").tables() == [] and PageReader("</p>a</b>").text() == "a"


def test_context_takes_the_nearest_and_nesting_is_cheap():
    page = PageReader("".join(f"<p>{k}</p>" for k in range(60)) + "<table><td>x<table><td>y</table></table>")
    assert page.tables() == [(" ".join(map(str, range(20, 60))), ["x y", "y"]), (" ".join(map(str, range(20, 60))), ["y"])]
    assert len(PageReader("<p>a" * 20_000).texts) == 20_000


def test_pages_as_rows(spark):
    rows = spark.createDataFrame([(1, "http://h.org/a/b", PAGE), (2, None, None), (3, "http://h.org", "")], "page_id long, url string, html string")
    read = read_pages(rows, ending="download.do")
    assert {r.page_id: len(r.text) > 0 for r in read.collect()} == {1: True, 2: False, 3: False}
    got = {tuple(r) for r in attachments(read, "page_id", r"/(\d+)/download", F.lit("Written")).select("file_id", "label", "dated").collect()}
    assert got == {("77", "File one", "2024-05-01"), ("8", "two none top", "2024-05-01")}
    found = sorted((r.number, r.answer, r.context[-5:]) for r in answers(read, "page_id", ("No.", "Answer")).collect())
    assert found == [(1, "2", "Civil"), (1, "3", " next"), (2, "5", " next"), (3, "2", " next"), (4, "1", "Civil")]


def test_references_without_semicolon_stay_as_in_sql(spark, tmp_path):
    pages = ["<title>a &amp;&amp</title><p>b &lt c &copy;&copy &#39; &#39 x", "<a href='/q?a=1&amp;b=2&lt=3'>&amp;lt; R&D &</a>&nbsp", "<p>\ufdd0 &amp</p>", None, ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("http://h.org")).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url, coalesce(html, '') AS html FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(tuple(r) for r in queries.QUERIES["page_text_lines"](spark, str(tmp_path)).collect()) == sorted(con.execute(queries.ORACLES["page_text_lines"]).fetchall())
    assert PageReader(pages[1], closed=True).links("http://h.org", "") == [("http://h.org/q?a=1&b=2&lt=3", "&lt; R&D &")]
    assert PageReader("a &amp").text() == "a &"
