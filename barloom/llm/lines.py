"""Line deduplication by site-relative frequency.

A line is boilerplate on a host if the share of the host's pages that contain it exceeds a ratio.
Counts are partial aggregates over hashes, so a host with a third of all pages shrinks before the
shuffle. A host has at most (mean distinct lines of a page) / ratio boilerplate lines, however
many pages it has; that bounded list meets its pages in an equi-join that Spark can split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What of a page is not text, and the tags that end a line. Plain patterns that any SQL engine reads.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAGS = r"<[^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def visible_lines(html: Column) -> Column:
    """The text of a page, one line for each block-level element; null stays null."""
    text = F.regexp_replace(html, HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; the empty text if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(text: Column) -> Column:
    """For each line, 128 bits that stand for it without its outer spaces; null for a blank line."""
    return F.transform(_lines(text), lambda x: F.when(F.length(F.trim(x)) > 0, F.struct(F.xxhash64(F.trim(x)).alias("a"), F.xxhash64(F.reverse(F.trim(x))).alias("b"))))


def boilerplate(pages: DataFrame, host: Column, text_col: str, ratio: float) -> DataFrame:
    """(host, keys): the lines on more than ratio of a host's pages. A line on one page alone repeats nowhere and is none."""
    keyed = pages.select(F.coalesce(host, F.lit("")).alias("_host"), F.array_distinct(F.filter(_keys(F.col(text_col)), lambda k: k.isNotNull())).alias("keys"))
    # outer: a plain explode would add a filter that makes the keys twice
    listed = keyed.select("_host", F.explode_outer("keys").alias("k")).where(F.col("k").isNotNull())
    per_line = listed.groupBy("_host", "k.a", "k.b").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    totals = pages.groupBy(F.coalesce(host, F.lit("")).alias("_host")).agg(F.count("*").alias("pages"))
    often = per_line.join(totals, "_host").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("_host").agg(F.collect_set(F.struct("a", "b")).alias("_drop"))


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = 0.1) -> DataFrame:
    """Every row of pages, with text_col without its boilerplate lines, plus n_lines and n_dropped.

    Lines are compared without outer spaces; blank lines are neither counted nor dropped, and the
    order of what stays is kept. Each page counts once for a line, however often it repeats it.
    A null host is the host ''; a null text stays null, with no lines. The ratio decides at every
    size: on a host of fewer than 1 / ratio pages, two that repeat a line are enough. Rows that repeat are
    pages of their own. Columns named n_lines or n_dropped in the input are replaced; _host, _drop and _kept are
    names of this function and do not come back."""
    drop = boilerplate(pages, host, text_col, ratio)
    # a key of its own: both sides are then dealt out for the join alone, and Spark splits hot hosts
    key = lambda h: F.concat(F.lit("host "), h)
    rows = pages.drop("n_lines", "n_dropped", "_drop", "_kept").withColumn("_host", key(F.coalesce(host, F.lit(""))))
    kept = rows.join(drop.withColumn("_host", key(F.col("_host"))), "_host", "left")
    text, lines = F.col(text_col), _lines(F.col(text_col))
    keep = F.filter(
        F.arrays_zip(lines.alias("line"), _keys(text).alias("key")),
        lambda x: x["key"].isNull() | ~F.array_contains(F.col("_drop"), x["key"]),
    )
    out = kept.withColumn("_kept", F.when(F.col("_drop").isNotNull() & text.isNotNull(), F.transform(keep, lambda x: x["line"])))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines))
    out = out.withColumn("n_lines", n).withColumn("n_dropped", F.when(F.col("_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")))
    return out.withColumn(text_col, F.when(F.col("_kept").isNull(), text).otherwise(F.array_join("_kept", "\n"))).drop("_host", "_drop", "_kept")
