"""Line dedup by site-relative frequency.

A line is boilerplate of its host if the pages that hold it are more than ``max_ratio`` of all pages of the host. Lines
are compared without the white space around them; blank lines are never boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import keep, key_of, text_or_empty


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_keys(text: Column) -> Column:
    """128 bits for each line, two 64-bit hashes with different starts; null for blank lines."""
    bare = F.transform(_lines(text), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))
    return F.transform(bare, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))


def host_lines(docs: DataFrame, host: str, text: str, *keys: str) -> DataFrame:
    """Each page's distinct lines as keys: ``keys``, ``host``, ``line`` (struct a, b)."""
    distinct = F.array_distinct(_line_keys(text_or_empty(text)))
    return docs.select(*keys, key_of(F.col(f"`{host}`")).alias("host"), F.explode(distinct).alias("line")).where("line is not null")


def boilerplate(docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 5, host: str = "source", text: str = "text") -> DataFrame:
    """(host, line, pages, host_pages) of the lines on more than ``max_ratio`` of the host's pages and on ``min_pages`` at least.

    Counts are summed before they are shuffled. A host has at most (lines of a page / ``max_ratio``) such lines.
    """
    pages = host_lines(docs, host, text).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = docs.groupBy(key_of(F.col(f"`{host}`")).alias("host")).agg(F.count("*").alias("host_pages"))
    return pages.join(totals, "host").where(F.col("pages") > F.lit(max_ratio) * F.col("host_pages"))


def drop_boilerplate(
    docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 5, host: str = "source", doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Documents without the boilerplate lines of their host, with ``n_lines`` and ``n_dropped``; no document is left out.

    Only keys of lines are shuffled; hot lines are split by the join's skew handling, and the texts are shuffled once, to
    meet the list of what they lose. Text without boilerplate stays as it is, byte for byte; a page of nothing else
    becomes empty. Null text stays null with 0 lines, empty text has one blank line. A null host is a host. Rows equal
    in id, host and text share their decision. Columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    rows = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    t, i, h = F.col(f"`{text}`"), F.col(f"`{doc_id}`"), F.col(f"`{host}`")
    rows = rows.withColumn("__line_row", F.struct(F.xxhash64(i, h, t).alias("a"), F.xxhash64(F.lit(1), t, i, h).alias("b")))
    bad = keep(boilerplate(docs, max_ratio, min_pages, host, text).select("host", "line"), "boilerplate")
    hits = host_lines(rows, host, text, "__line_row").join(bad, ["host", "line"], "left_semi")
    lost = hits.groupBy("__line_row").agg(F.collect_set("line").alias("__line_lost"))
    lines = _lines(t)
    gone = F.col("__line_lost")
    both = F.arrays_zip(lines.alias("line"), _line_keys(t).alias("key"))
    left = F.transform(F.filter(both, lambda x: ~F.coalesce(F.array_contains(gone, x["key"]), F.lit(False))), lambda x: x["line"])
    return (
        rows.join(lost, "__line_row", "left")
        .withColumn("n_lines", F.when(t.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
        .withColumn("__line_left", F.when(gone.isNotNull(), left))
        .withColumn("n_dropped", F.when(gone.isNotNull(), F.size(lines) - F.size("__line_left")).otherwise(F.lit(0)).cast("long"))
        .withColumn(text, F.when(gone.isNotNull(), F.array_join("__line_left", "\n")).otherwise(t))
        .drop("__line_row", "__line_lost", "__line_left")
    )
