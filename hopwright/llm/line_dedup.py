"""Line dedup by site-relative frequency.

A page's lines are the trimmed texts between its tags (scripts, styles and comments left out). For each host, the pages that
contain a line are divided by all pages of the host; lines above the boilerplate ratio go from every page of that host. A
host needs ``MIN_PAGES`` pages for any of its lines to count as boilerplate.

Lines are counted by host and line hash with partial sums before the shuffle. A host with P pages of L distinct lines on
average has fewer than L / ratio lines above the ratio, so a host's boilerplate is one short array. Hosts with many pages are dealt
into shares, each with that array; the hosts that need it are few by construction and broadcast.

Null html has no lines; a null url belongs to the host ''. Lines are trimmed of blanks, tabs and carriage returns; tags are told
whatever their letters' case. A page of any length is taken whole. Repeated pages count as pages. Ties do not arise: a line exactly
at the ratio stays. An empty table gives no rows. Only key, url and html are read; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwright.llm.common import SHARE_ROWS, shared_join, split_keys, table, written

RATIO = 0.3
MIN_PAGES = 5
BREAK = r"(?i)<!--[\s\S]*?-->|<script[^>]*>[\s\S]*?</script>|<style[^>]*>[\s\S]*?</style>|<[^>]*>|\n"

BLANKS = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def lines_of(html: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(html, F.lit("")), BREAK), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def boilerplate(pages: DataFrame, totals: DataFrame, split: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(key: host, ``__drop``: hashes of its boilerplate lines) for hosts that have any; ``pages`` has __host and __lines."""
    lines = pages.select("__host", F.explode(F.array_distinct(F.transform("__lines", lambda x: F.xxhash64(x)))).alias("__line"))
    counts = lines.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__n"))
    # No line of a host with min_pages pages can be above the ratio on so few pages; this leaves little to join.
    counts = counts.filter(F.col("__n") > ratio * min_pages)
    above = shared_join(counts, F.col("__host"), F.col("__line"), totals.filter(F.col("n") >= min_pages), split).filter(F.col("__n") > ratio * F.col("n"))
    return above.groupBy(F.col("__host").alias("key")).agg(F.collect_list("__line").alias("__drop"))


def drop_boilerplate_lines(pages: DataFrame, key: str = "page_id", ratio: float = RATIO, min_pages: int = MIN_PAGES, share_rows: int = SHARE_ROWS) -> DataFrame:
    """key, host, n_lines, n_dropped and the text of the lines that stay."""
    rows = pages.select(F.col(key).alias("__key"), host_of(F.col("url")).alias("__host"), lines_of(F.col("html")).alias("__lines"))
    totals = written(pages.groupBy(host_of(F.col("url")).alias("key")).agg(F.count(F.lit(1)).alias("n")), "hosts")
    split = split_keys(totals, totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], share_rows)
    joined = shared_join(rows, F.col("__host"), F.col("__key"), boilerplate(rows.select("__host", "__lines"), totals, split, ratio, min_pages), split)
    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.array_contains("__drop", F.xxhash64(x))))
    return joined.withColumn("__kept", kept).select(
        F.col("__key").alias(key), F.col("__host").alias("host"), F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("bigint").alias("n_dropped"), F.array_join("__kept", "\n").alias("text"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate_lines(table(spark, sf_dir, "pages"))


def op1_sql() -> str:
    return rf"""
    WITH p AS (SELECT row_number() OVER () AS row, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
                      list_filter(list_transform(string_split_regex(coalesce(html, ''), '{BREAK}'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS lines FROM pages),
    t AS (SELECT host, count(*) AS n FROM p GROUP BY host),
    l AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL),
    b AS (SELECT host, list(line) AS lines FROM l JOIN t USING (host) WHERE t.n >= {MIN_PAGES} AND l.n > {RATIO} * t.n GROUP BY host),
    k AS (SELECT p.*, list_filter(p.lines, lambda x: NOT coalesce(list_contains(b.lines, x), false)) AS kept FROM p LEFT JOIN b USING (host))
    SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
    """
