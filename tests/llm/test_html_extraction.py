from collections import defaultdict
from urllib.parse import urlsplit

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlake.llm.html_extraction import OP11_SQL, host_of, main_text, op11_html_extraction, subtree_counts
from cohortlake.llm.html_tree import Page, parsed

SCHEMA = "page_id long, url string, html string"
FOLDER = "/root/testdata/sf0.001"


def text(html):
    return Page(html).text()


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("", ""),
        ("plain &lt;text&gt; &amp &am; caf&eacute;&nbsp;x", "plain <text> & &am; café x"),
        ("<title>t</title><style>p{}</style><script>var a='</p>';</script><p>one<p>t<b>w</b>o<br>three", "one two three"),
        ("<nav><a>menu</a></nav><article><h1>A</h1><p><b>b<br><p>c</article><footer>f</footer>", "A b c"),
        ('<body class="no-sidebar"><div id="page with-sidebar"><article><p>x</p></article></div>', "x"),
        ('<article><header><p>by me</p><h1>T</h1></header>a<div class="share">s</div><footer>f</footer></article>', "T a"),
        ('<article><p>x</p><section class="comments"><article class="comment">c</article></section></article>', "x"),
        ("<aside><article>teaser</article></aside><article><p>real text</p></article>", "real text"),
        ("<main><p>m<ul><li>a<li>b</ul><form><h2>q</h2><input></form></main><p>out", "m a b"),
        ("<form id=page><h1>T</h1><p>x</p><select><option>1</select></form>", "T x"),
        ("<p hidden>a</p><p style='display: none'>b</p><p aria-hidden=true>c</p><div role=navigation>d</div>e", "e"),
        ("<table><tr><td>1<td>2<tr><td>3</table><dl><dt>a<dd>b</dl>", "1 2 3 a b"),
        ("a<!-- x --!>b<!-->c<!doctype q><?php d ?></ e>f<p title='a>b'>g", "abcf g"),
        ("<p>x < y <3</p><!-- open <p>z", "x < y <3"),
        ("<script>never closed <p>z", ""),
        ("<div class='cookieNotice'>c</div><div id='adBox'>d</div><span class=comment>kept?</span><em class=comment>e</em>", "e"),
    ],
)
def test_text_of_one_page(html, expected):
    assert text(html) == expected


@pytest.mark.parametrize(
    "html",
    ["<b>" * 40_000 + "x", "<div>" * 40_000 + "x" + "</div>" * 40_000, "<" * 100_000, "<i><div>" + "<b></i>" * 40_000 + "x",
     "<p>" * 40_000 + "x", "<article>" * 20_000 + "x", "&" * 100_000, "<a " + "x='" * 30_000 + "><p>x", "<p>x" * 40_000],
    ids=["inline", "nested", "lt", "stray", "p", "articles", "amp", "quotes", "many"],
)
def test_malformed_and_long_pages_take_linear_time(html):
    assert isinstance(text(html), str)


def test_every_tag_makes_one_element():
    assert [e.tag for e in parsed("<A HREF=x><IMG src='>'/><li>1<li>2</A>")] == ["", "a", "img", "li", "li"]


def site(host, n, body):
    return [(f"http://{host}/{i}", body(i)) for i in range(n)]


def test_templates_go_and_prose_stays(spark):
    rows = site("a.org", 20, lambda i: f"<div><div>promo text</div><div>rare {i}</div></div><p>body {i}</p><p>licence</p>")
    rows += site("b.org", 20, lambda i: f"<div>promo text</div><article><p>own {i}</p><p>shared</p><div>box</div></article>")
    rows += site("c.org", 4, lambda i: f"<div>few</div><p>c {i}</p>")  # not on enough pages
    rows += site("d.org", 30, lambda i: "<div>copied</div><p>same page</p>")  # copies are one page
    rows += [(None, "<div>promo text</div>x"), ("nohost", "<div>promo text</div>y"), ("http://a.org", None)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], SCHEMA).withColumn("host", F.lit("clash"))
    got = {r["url"]: (r["text"], r["n_chars"]) for r in main_text(df.repartition(6), least_share=0.3).collect()}
    assert got["http://a.org/3"] == ("rare 3 body 3", 13)
    assert got["http://b.org/3"] == ("own 3 shared", 12)
    assert got["http://c.org/3"][0] == "few c 3"
    assert got["http://d.org/3"][0] == "copied same page"
    assert got[None][0] == "promo text x" and got["nohost"][0] == "promo text y" and got["http://a.org"] == ("", 0)


def test_counts_match_brute_force_with_one_large_host(spark):
    rows = site("hot.org", 300, lambda i: f"<ul><li>m{i % 3}<li>x</ul><div>ad {i % 7}</div><p>p {i // 2}</p>")
    rows += site("WWW.b.org:8080", 9, lambda i: f"<ul><li>m{i % 3}</ul><article><h1>{i}</h1></article>")
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], SCHEMA)
    seen = defaultdict(set)
    for url, html in rows:
        page = Page(html)
        for digest in (0, *page.removable()):
            seen[urlsplit(url).hostname, digest - (1 << 64 if digest >> 63 else 0)].add(page.key())
    counts = subtree_counts(df.withColumn("host", host_of(F.col("url")))).collect()
    assert {(r["host"], r["digest"]): r["n"] for r in counts} == {k: len(v) for k, v in seen.items()}


def test_empty_table_repeated_rows_and_null_identifiers(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (None, None, None), (None, "u", "<p>" + "y " * 300_000)]
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0), (0, 599_999), (1, 1), (1, 1)]


def test_query_matches_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    expected = sorted(duck.execute(OP11_SQL).fetchall())
    got = sorted(tuple(r) for r in op11_html_extraction(spark, FOLDER).select("page_id", "url", "text", "n_chars").collect())
    assert got == expected and len(got) == 50
