"""Main text of web pages: subtrees that recur across the pages of a host are its template and go.

A first pass hashes the element subtrees of every page; Spark counts, per host, how many different
pages hold each. A second pass drops a page's recurring subtrees, then what element names, roles and
class names mark as menus, adverts, comments and the like, and gives the text that remains of the
article.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import scratch_table, table
from cohortlake.llm.html_tree import Page

PAGE = 0  # stands for the page itself among the digests of its subtrees
HOT_SHARE = 1024  # hosts with more than 1 / HOT_SHARE of all pages are split into parts of that size


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    return F.when(host != "", host)


def subtree_counts(pages: DataFrame) -> DataFrame:
    """(host, digest, n): on how many different pages of the host each subtree lies; digest 0 is any page.

    Pages with the same article count once, so that copies of one page do not make its parts a
    template. One row per host, digest and page is counted in two keyed steps with partial sums, so
    a host with a third of all pages is spread over all tasks.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                hosts, digests, keys = [], [], []
                part = batch.slice(at, 500)
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    page = Page(html)
                    own = [PAGE, *page.removable()]
                    hosts += [host] * len(own)
                    digests += own
                    keys += [page.key()] * len(own)
                yield pa.record_batch(
                    [pa.array(hosts, pa.string()), *(pa.array(v, pa.uint64()).view(pa.int64()) for v in (digests, keys))],
                    names=["host", "digest", "page"],
                )

    held = pages.filter("host is not null").select("host", "html").mapInArrow(hashes, "host string, digest long, page long")
    return held.distinct().groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n"))


def templates(counts: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """(host, digests): the subtrees on at least ``least_pages`` pages and that share of the host's pages.

    As each lies on that share of the pages, a host has at most the mean number of subtrees of its
    pages, over the share, of them.
    """
    sizes = counts.filter(F.col("digest") == PAGE).select("host", F.col("n").alias("pages"))
    many = counts.filter((F.col("digest") != PAGE) & (F.col("n") >= least_pages)).join(sizes, "host")
    many = many.filter(F.col("n") >= F.col("pages") * least_share)
    return many.groupBy("host").agg(F.collect_list("digest").alias("digests"))


def main_text(
    pages: DataFrame,
    least_pages: int = 5,
    least_share: float = 0.01,
    html: str = "html",
    url: str = "url",
    ident: str = "page_id",
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars; ``text`` is the main text of the whole html.

    Blocks are joined by a space in page order, white space inside is one space, references are
    decoded. The main text lies in the page's articles (else in ``main``, else in the body). Dropped
    are: block subtrees that lie on at least ``least_pages`` different pages and ``least_share`` of
    all different pages of the host; and whatever its element, role, class or identifier names as
    menu, header (headings inside an article stay), footer, sidebar, notice, advert, form, script,
    style or comment. Prose of an article (paragraphs, headings, lists, tables, quotes) is never a
    template, however many pages share it.

    Null html is empty and gives an empty text. Pages without a host in their URL have no template.
    Rows that repeat, and rows with a null identifier or URL, are all returned. Malformed markup never
    fails: open elements end late, stray tags are dropped. An empty table gives no rows.
    """
    body = pages.select(
        F.col(ident).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
        host_of(F.col(url)).alias("host"),
    )
    counts = scratch_table(subtree_counts(body), "subtrees")
    found = scratch_table(templates(counts, least_pages, least_share), "templates")
    sizes = counts.filter(F.col("digest") == PAGE)
    bound = sizes.agg(F.sum("n")).first()[0] or 0
    # Fewer than HOT_SHARE hosts can be above the bound, so the broadcast is small at any size.
    share = F.ceil(F.col("n") * HOT_SHARE / F.lit(max(bound, 1))).cast("int")
    hot = sizes.filter(F.col("n") * HOT_SHARE > bound).select("host", share.alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = found.join(F.broadcast(hot), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    spread = F.when(F.col("host").isNull(), F.xxhash64("html")).otherwise(F.pmod(F.xxhash64("html", "page_id"), parts))
    rows = body.join(F.broadcast(hot), "host", "left").withColumn("part", spread).drop("parts")
    rows = rows.withColumn("host", F.coalesce("host", F.lit("")))
    joined = rows.join(dealt.withColumn("part", F.col("part").cast("long")), ["host", "part"], "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[object, frozenset[int]] = (None, frozenset())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = []
                for source, digests in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                    own = digests.values.to_numpy().tobytes() if digests.is_valid else None
                    if known[0] != own:
                        values = digests.values.view(pa.uint64()).to_pylist() if own else []
                        known = own, frozenset(values)
                    texts.append(Page(source).text(known[1]))
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return joined.select("page_id", "url", "html", "digests").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, folder, "pages"))


# The given pages hold one ``article`` each, with five kinds of elements; there SQL can cut the text out.
OP11_SQL = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM articles),
decoded AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(
    body, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM decoded
"""
