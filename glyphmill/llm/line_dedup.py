"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize, read

MAX_RATIO = 0.3
MIN_PAGES = 3
#: Lists of boilerplate lines up to so many bytes together are broadcast; more are joined.
BROADCAST_BYTES = 4 << 20
#: Tags that end a line of a web page.
BLOCK = r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|article|section|nav|footer|header|table|tr|title|body|head|html)|br)(?:\s[^>]*)?/?>"
SKIPPED = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"


def html_lines(html: Column) -> Column:
    """Lines of a page: scripts, styles and comments go, block tags end lines, other tags go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), SKIPPED, "")
    return F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), "<[^>]*>", "")


def line_dedup(df: DataFrame, id_col: str = "page_id", text_col: str = "text", host_col: str = "host", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``df`` with the text cleaned, and ``n_lines``, ``n_dropped``. ``df`` is read twice.

    A line is boilerplate of its host if at least ``min_pages`` pages of the host hold it and
    they are more than ``max_ratio`` of the host's pages. Lines compare trimmed of spaces, tabs
    and carriage returns; blank lines are never counted or dropped. Every occurrence of a
    boilerplate line goes, the others stay in order with their own white space.

    Each page gives each line once, so counting needs no distinct; both counts combine on the
    map side. A host has fewer than (mean lines a page) / ``max_ratio`` boilerplate lines, which
    bounds the list that a host carries whatever its size. The lists are written once; if they are
    small they are broadcast and pages stay where they are, else pages join them by host, a join in which a
    host with a third of all pages can be split.

    Null text: empty, no lines. Null host: a host of its own (the empty name). Repeated rows count
    as pages of their own. Empty tables give empty results. Columns of ``df`` named like the
    result's two counts are replaced; names starting with ``_ld_`` are reserved. ``id_col`` is not read.
    """
    trim = lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")
    host = F.coalesce(F.col(host_col), F.lit(""))
    raw = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    distinct = F.array_distinct(F.filter(F.transform(raw, trim), lambda x: x != ""))
    totals = df.groupBy(host.alias("_ld_host")).agg(F.count(F.lit(1)).alias("_ld_pages"))
    counts = df.select(host.alias("_ld_host"), F.explode(distinct).alias("_ld_line")).groupBy("_ld_host", "_ld_line").agg(F.count(F.lit(1)).alias("_ld_n"))
    found = counts.where(F.col("_ld_n") >= min_pages).join(totals, "_ld_host").where(F.col("_ld_n") > max_ratio * F.col("_ld_pages"))
    lists = materialize(found.groupBy("_ld_host").agg(F.collect_list("_ld_line").alias("_ld_drop")), "boilerplate")
    size = lists.agg(F.sum(F.octet_length(F.array_join("_ld_drop", "")) + F.octet_length("_ld_host") + 32)).first()[0]
    lists = F.broadcast(lists) if (size or 0) <= BROADCAST_BYTES else lists
    joined = df.withColumn("_ld_host", host).join(lists, "_ld_host", "left")
    # Trimmed once a line; a page without a list keeps its text as it is.
    lines = F.transform(raw, lambda x: F.struct(x.alias("x"), trim(x).alias("t")))
    joined = joined.withColumn("_ld_lines", F.when(F.col("_ld_drop").isNotNull(), lines))
    kept = F.filter("_ld_lines", lambda x: ~F.array_contains(F.col("_ld_drop"), x["t"]))
    joined = joined.withColumn("_ld_kept", kept)
    filled = F.when(F.col("_ld_drop").isNotNull(), F.size(F.filter("_ld_lines", lambda x: x["t"] != ""))).otherwise(F.size(F.filter(raw, lambda x: F.regexp_like(x, F.lit(r"[^ \t\r]")))))
    result = joined.withColumns({
        "n_lines": filled,
        "n_dropped": F.when(F.col("_ld_drop").isNotNull(), F.size("_ld_lines") - F.size("_ld_kept")).otherwise(0),
        text_col: F.when(F.col("_ld_drop").isNotNull(), F.array_join(F.transform("_ld_kept", lambda x: x["x"]), "\n")).otherwise(F.coalesce(F.col(text_col), F.lit(""))),
    })
    return result.select(*dict.fromkeys([*df.columns, "n_lines", "n_dropped"]))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages``: what is left of its lines, without its site's boilerplate. Mark-up is taken off once and written."""
    pages = read(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    return line_dedup(materialize(pages, "lines")).select("page_id", "host", "n_lines", "n_dropped", "text")


OP9_SQL = rf"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{SKIPPED}', '', 'g'),
        '{BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS ls FROM pages),
l AS (SELECT page_id, host, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM p),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
c AS (SELECT host, k, count(DISTINCT page_id) AS n FROM t WHERE k <> '' GROUP BY ALL),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
d AS (SELECT host, k, true AS gone FROM c JOIN h USING (host) WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * pages)
SELECT page_id, host, CAST(count(*) FILTER (k <> '') AS INTEGER) AS n_lines, CAST(count(gone) AS INTEGER) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone IS NULL), '') AS text
FROM t LEFT JOIN d USING (host, k) GROUP BY page_id, host
"""
