"""Line dedup by site-relative frequency.

Pages are grouped by host. The pages that contain a line, divided by the host's pages, give the line's ratio on that site;
lines above `RATIO` are boilerplate there and are dropped, if at least `PAGES` pages contain them.

Lines are the runs of text between block tags and line breaks, without script, style and comments, trimmed; inline tags are
removed. Counts are combined in map tasks over (host, line), so a host with a third of all pages is no hot key. The
boilerplate lines of a host are few by construction (its mean number of distinct lines per page / RATIO at most), so they are
joined back as one array per host: broadcast when measured small, else on (host, salt).

Null html has no lines. Pages without a host are kept as they are. Repeated rows are pages of their own.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BROADCAST_BYTES, salt_of, salted, sized_join, stage_table, table_bytes

PERCENT, PAGES = 30, 3
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
UNSEEN = r"(?is)<(?:script|style)(?:[ \t\r\n][^>]*)?>.*?</(?:script|style)[ \t\r\n]*>|<!--.*?-->"
INLINE = r"(?i)</?(?:a|b|em|i|small|span|strong|u)(?:[ \t\r\n][^>]*)?>"
TAG, BREAK, EDGE = r"<[^>]*>", r"[\r\n]+", r"^[ \t]+|[ \t]+$"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def lines_of(html: Column) -> Column:
    """Array of the visible lines of a page."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, ""), INLINE, ""), TAG, "\n")
    return F.filter(F.transform(F.split(text, BREAK), lambda x: F.regexp_replace(x, EDGE, "")), lambda x: x != "")


def boilerplate(rows: DataFrame, percent: int = PERCENT, pages: int = PAGES) -> DataFrame:
    """(site, common): per host its boilerplate lines, from rows (host, lines)."""
    rows = rows.filter(F.col("host").isNotNull())
    totals = stage_table(rows.groupBy("host").agg(F.count("*").alias("total")), "hosts")
    counts = rows.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("n") >= pages)
    if table_bytes(totals) <= BROADCAST_BYTES:
        joined = counts.join(F.broadcast(totals), "host")
    else:
        joined = counts.withColumn("salt", salt_of("line")).join(salted(totals), ["host", "salt"])
    return joined.filter(100 * F.col("n") > percent * F.col("total")).groupBy(F.col("host").alias("site")).agg(F.collect_set("line").alias("common"))


def drop_boilerplate(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", percent: int = PERCENT, least: int = PAGES) -> DataFrame:
    """(page_id, host, lines, kept): every page with its lines and those that stay, in order."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines"))
    common = stage_table(boilerplate(rows, percent, least), "boilerplate")
    if table_bytes(common) <= BROADCAST_BYTES:
        joined = sized_join(rows, common, F.col("host") == F.col("site"), "left")
    else:
        joined = rows.withColumn("own", salt_of("page_id")).join(
            salted(common), (F.col("host") == F.col("site")) & (F.col("own") == F.col("salt")), "left")
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("common", x)))
    return joined.select("page_id", "host", "lines", kept.alias("kept"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4."""
    found = drop_boilerplate(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
                        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = rf"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '{UNSEEN}', '', 'g'), '{INLINE}', '', 'g'), '{TAG}', chr(10), 'g'), '{BREAK}'), lambda x: regexp_replace(x, '{EDGE}', '', 'g')),
      lambda x: x <> '') AS lines FROM pages),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host IS NOT NULL) GROUP BY host, line),
t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
b AS (SELECT c.host, list(line) AS common FROM c JOIN t ON c.host = t.host WHERE n >= {PAGES} AND 100 * n > {PERCENT} * total GROUP BY c.host),
k AS (SELECT page_id, p.host, lines, CASE WHEN common IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(common, x)) END AS kept
  FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""
