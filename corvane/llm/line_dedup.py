"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate of that host.

Each page counts once for each of its distinct lines. A line of a host is dropped from all its pages if more than
max_ratio of the host's pages have it and at least min_pages do (two: a line of one page is no repetition). A page has L lines on average, so a host has at
most L / max_ratio such lines: the list that meets each page in the join is bounded whatever the host's size. Counts
are pre-aggregated, and the join on the host is one that Spark splits where a host is hot.

Null or empty texts have no lines and stay as empty pages; pages with a null host form one host; repeated rows count
as pages of their own; lines are compared after trimming blanks. An empty table gives no rows. Other columns pass
through; an output whose name is taken gets underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import free_name, written

BLANK_ENDS = " \t\x0b\f\r"


def host_of(url: Column) -> Column:
    """The host of a URL, lower case, without a port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def visible_lines(html: Column) -> Column:
    """Runs of text between tags and line ends, scripts and styles left out, blanks trimmed, empty ones dropped."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>", "")
    return lines_of(text, r"<[^>]*>|\n")


def lines_of(text: Column, cut: str = "\n") -> Column:
    """Non-blank lines of a text, blanks trimmed."""
    return F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), cut), lambda x: F.btrim(x, F.lit(BLANK_ENDS))), "")


def drop_boilerplate(pages: DataFrame, lines: Column, host: Column, max_ratio: float = 0.3, min_pages: int = 2) -> DataFrame:
    """pages with host, lines (the kept ones, in order) and n_lines (before)."""
    names = {n: free_name(pages, n) for n in ("host", "lines", "n_lines", "site_host", "site_common")}
    base = pages.withColumn(names["host"], host).withColumn(names["lines"], lines)
    h, ls = F.col(names["host"]), F.col(names["lines"])
    slim = base.select(h.alias("host"), F.transform(F.array_distinct(ls), lambda x: F.xxhash64(x)).alias("lines"))
    totals = slim.groupBy(F.col("host").alias("t_host")).agg(F.count(F.lit(1)).alias("pages"))
    counts = slim.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(totals, F.col("host").eqNullSafe(F.col("t_host"))).where(F.col("n") > max_ratio * F.col("pages"))
    # written, so that Spark knows its size: it is sent to tasks where small, else the join is one that Spark can split
    common = written(common.groupBy(F.col("host").alias(names["site_host"])).agg(F.collect_list("line").alias(names["site_common"])), "boilerplate")
    out, drop = base.join(common, h.eqNullSafe(F.col(names["site_host"])), "left"), F.col(names["site_common"])
    kept = F.when(drop.isNull(), ls).otherwise(F.filter(ls, lambda x: ~F.array_contains(drop, F.xxhash64(x))))
    return out.withColumn(names["n_lines"], F.size(ls).cast("long")).withColumn(names["lines"], kept).drop(names["site_host"], names["site_common"])
