"""Line dedup by site-relative frequency (DataFrame functions only).

Pages are grouped by host. A line counts once per page; its ratio is the number of
the host's pages that contain it divided by all pages of the host. Lines above
``RATIO`` on hosts with at least ``PAGES`` pages are boilerplate and go, if at least ``COPIES``
pages hold them (on a host of three pages one page is above the ratio already); the rest
of the page stays in order.

Distinct lines of a page are cut and hashed where the page is read, and counted
with partial aggregation, so a hot host or line is summed up before the shuffle. A
host has fewer than (mean lines per page) / RATIO boilerplate lines, so its list is
short however many pages it has. The lists are written and sent to all tasks while
they are small, so pages are not shuffled; beyond that size pages are joined with
them on the host, a join whose hot partitions Spark can split.

Lines: tags that end a block, and line ends, end a line; scripts, styles and comments
and all other tags are taken out; blanks inside a line become one space; empty lines
are no lines.

Defined results: null html: no lines. Null url or one without a host: host null, no
site, so nothing is dropped. Repeated rows: each is a page. A page may lose all
lines (empty text). Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.llm.tables import join_by_size, stored

RATIO = 0.3
PAGES = 3
COPIES = 2

HIDDEN = "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->"
BREAK = "(?i)</?(?:p|div|br|hr|li|ul|ol|nav|header|footer|article|section|aside|main|h[1-6]|table|tr|td|th|title|head|body|html|pre|blockquote|form)\\b[^>]*>|[\\r\\n]+"
TAG = "<[^>]*>"
BLANKS = "[ \\t]+"


def host_of(url: Column) -> Column:
    """Lower-case host name of an absolute URL; null when there is none."""
    host = F.lower(F.regexp_extract(url, "(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def visible_lines(html: Column) -> Column:
    """The non-empty lines of a page in order."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(text, BREAK, "\n")
    text = F.regexp_replace(F.regexp_replace(text, TAG, ""), BLANKS, " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(lines: DataFrame, ratio: float, pages: int, copies: int) -> DataFrame:
    """(host, drop): hashes of the boilerplate lines of each host that has some."""
    on_site = lines.filter("host is not null")
    totals = on_site.groupBy("host").agg(F.count("*").alias("total")).filter(F.col("total") >= pages)
    counts = (
        on_site.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("pages"))
    )
    return (
        counts.join(totals, "host").filter((F.col("pages") > ratio * F.col("total")) & (F.col("pages") >= copies))
        .groupBy("host").agg(F.collect_list("line").alias("drop"))
    )


def without_boilerplate(
    pages: DataFrame, ratio: float = RATIO, least: int = PAGES, copies: int = COPIES
) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) of every page."""
    lines = pages.select("page_id", host_of(F.col("url")).alias("host"), visible_lines(F.col("html")).alias("lines"))
    drop = stored(boilerplate(lines, ratio, least, copies), "lines-boilerplate")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("drop", F.xxhash64(x)))
    )
    return (
        join_by_size(lines, drop, "host", "left", "drop")
        .withColumn("kept", kept)
        .select(
            "page_id", "host", F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.array_join("kept", "\n").alias("text"),
        )
    )


def check_sql(ratio: float = RATIO, least: int = PAGES, copies: int = COPIES) -> str:
    """The same result in DuckDB's SQL."""
    return f"""
WITH cut AS (
  SELECT page_id,
         nullif(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         [trim(x, ' ') FOR x IN string_split(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             coalesce(html, ''), '{HIDDEN}', ' ', 'g'), '{BREAK}', chr(10), 'g'), '{TAG}', '', 'g'), '{BLANKS}', ' ', 'g'),
           chr(10)) IF trim(x, ' ') <> ''] AS lines
  FROM pages),
total AS (SELECT host, count(*) AS n FROM cut WHERE host IS NOT NULL GROUP BY host HAVING count(*) >= {least}),
seen AS (SELECT host, line, count(*) AS n FROM (
  SELECT host, unnest(list_distinct(lines)) AS line FROM cut WHERE host IS NOT NULL) GROUP BY host, line),
dropped AS (SELECT s.host, list(s.line) AS gone FROM seen s JOIN total t USING (host)
  WHERE s.n > {ratio} * t.n AND s.n >= {copies} GROUP BY s.host),
kept AS (SELECT page_id, c.host, lines,
  [x FOR x IN lines IF NOT list_contains(coalesce(gone, []), x)] AS stay
  FROM cut c LEFT JOIN dropped d ON c.host = d.host)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(stay) AS n_dropped,
       coalesce(array_to_string(stay, chr(10)), '') AS text
FROM kept"""
