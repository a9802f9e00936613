"""Line dedup by site-relative frequency.

Per host, the pages that contain a line (each page once) are divided by the host's pages.
Lines of at least ``max_share`` of the pages, and at least ``min_pages`` pages, are
boilerplate and are dropped from all pages of that host. Lines are compared without blanks
at their ends, by a 64-bit hash; lines without a word are never boilerplate.

Counting is a map-side aggregated groupBy over (host, line), so a line that every page of a
hot host has arrives as one row per task. A host keeps at most (lines per page) / max_share
dropped lines; they go to the pages as one array per host, broadcast if their measured size
allows and by a skew-split join otherwise, so the texts are not shuffled in the first case.

With ``distinct_texts`` a page is a distinct whole text of its host: copies count once, in
a line's pages and in the host's pages, so a text that was copied often does not make its
own lines boilerplate (near-duplicate removal, later, could not tell emptied copies from
other empty texts). The distinct (host, text hash, line hashes) are aggregated map-side, so
copies arrive as one row per task and texts are not shuffled. Without it (the default, and
what the SQL of op10_line_dedup counts) every row is a page.

Edge cases: a null text stays null; null hosts share one host; a text all of whose lines go
becomes empty; rows that repeat an id count as pages of their own (with
``distinct_texts``, if their texts differ); hosts with fewer than
``min_pages`` pages lose nothing. Extra columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedlake.llm.checked import join_lists
from feedlake.session import materialize

MAX_SHARE = 0.05
MIN_PAGES = 10

_BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """Hash of a line without blanks at its ends; null if nothing is left."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate_lines(docs: DataFrame, host: Column, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES,
                      distinct_texts: bool = False) -> DataFrame:
    """__host, __lines (sorted array of line hashes) of every host that has boilerplate."""
    host = F.coalesce(host.cast("string"), F.lit("")).alias("__host")
    lines = F.array_distinct(F.transform(_lines(F.col("text")), _key))
    if distinct_texts:
        rows = docs.select(host, F.xxhash64("text").alias("text"), lines.alias("lines")).distinct()
    else:
        rows = docs.select(host, lines.alias("lines"))
    pages = rows.groupBy("__host").agg(F.count("*").alias("pages"))
    seen = rows.select("__host", F.explode("lines").alias("line")).where("line is not null")
    counts = seen.groupBy("__host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = counts.join(pages, "__host").where(F.col("n") >= F.col("pages") * max_share)
    return over.groupBy("__host").agg(F.sort_array(F.collect_list("line")).alias("__lines"))


def drop_boilerplate(docs: DataFrame, host: Column, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES, counts: bool = False,
                     distinct_texts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; with ``counts``, also n_lines and n_dropped (long)."""
    lists = materialize(boilerplate_lines(docs, host, max_share, min_pages, distinct_texts), "boilerplate")
    columns = docs.columns
    rows = docs.withColumn("__host", F.coalesce(host.cast("string"), F.lit("")))
    joined = join_lists(rows, lists, "__host", "__lines")
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__lines"), _key(x)), F.lit(False)))
    out = joined.withColumn("__kept", F.when(F.col("__lines").isNull(), lines).otherwise(kept))
    text = F.array_join("__kept", "\n")
    extra = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
             F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    return out.select(*(text.alias("text") if c == "text" else F.col(c) for c in columns), *extra)
