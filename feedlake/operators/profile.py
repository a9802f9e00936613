"""Coverage, keyword and constraint profiles.

Every profile is one aggregation job. Keyword counts that the reference
issues as one query per keyword are computed in a single pass: one
conditional sum per keyword in the same aggregate, then unpivoted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions.text import contains_ci, like_any

# Report texts.
STATUS_ENRICHED = "Transform completed"
STATUS_BASIC = "Transform completed (Basic version - no Cortex)"
REPORT_MINUTES = 5


def row_count(df: DataFrame, name: str = "cnt") -> DataFrame:
    """G2."""
    return df.agg(F.count("*").alias(name))


def latest(df: DataFrame, col: str = "updated_at", name: str = "latest_update") -> DataFrame:
    """G3."""
    return df.agg(F.max(col).alias(name))


def chunks_per_article(chunks: DataFrame, k: int = 5) -> DataFrame:
    """Chunks and longest chunk per article URL, most chunks first, top k."""
    g = chunks.groupBy("article_url").agg(F.count("*").alias("chunk_count"),
                                          F.max("chunk_length").alias("max_length"))
    return g.orderBy(F.desc("chunk_count"), F.asc_nulls_first("article_url")).limit(k)


def chunk_post_hits(chunks: DataFrame, posts: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Chunks joined to their post by URL, keeping chunks that mention any keyword."""
    c = chunks.where(like_any("chunk_text", list(keywords)))
    p = posts.select(F.col("url").alias("article_url"), "title")
    return c.join(p, "article_url").select("article_url", "title", "chunk_id", "chunk_index")


def hits_per_article(chunks: DataFrame, posts: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Matching chunks per (url, title)."""
    return (chunk_post_hits(chunks, posts, keywords)
            .groupBy("article_url", "title").agg(F.count("*").alias("match_count")))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Count, average and maximum chunk length."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.avg("chunk_length").alias("avg_length"),
                      F.max("chunk_length").alias("max_length"))


def articles_with_chunks(chunks: DataFrame) -> DataFrame:
    """Distinct articles that have chunks."""
    return chunks.agg(F.countDistinct("article_url").alias("cnt"))


def _unpivot_counts(df: DataFrame, preds: list[tuple[str, str, Column]]) -> DataFrame:
    sums = [F.sum(F.when(p, 1).otherwise(0)).cast("long").alias(f"c{i}") for i, (_, _, p) in enumerate(preds)]
    agg = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("keyword"), F.col(f"c{i}").alias("cnt"))
                     for i, (f, k, _) in enumerate(preds)])
    return agg.select(F.explode(rows).alias("r")).select("r.field", "r.keyword", "r.cnt")


def keyword_df(posts: DataFrame, keywords: Sequence[str], col: str = "body") -> DataFrame:
    """Articles whose ``col`` contains each keyword (case-sensitive LIKE), one pass."""
    preds = [(col, k, F.col(col).like(f"%{k}%")) for k in keywords]
    return _unpivot_counts(posts, preds).select("keyword", "cnt")


def keyword_by_field(posts: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Case-insensitive keyword counts per field, zero counts hidden, one pass."""
    preds = [(f, k, contains_ci(f, k)) for f, ks in fields.items() for k in ks]
    return _unpivot_counts(posts, preds).where(F.col("cnt") > 0)


def keyword_any_count(chunks: DataFrame, keywords: Sequence[str],
                      col: str = "chunk_text") -> DataFrame:
    """G11 (+P15): chunks whose lower-cased text contains any keyword."""
    pred = like_any(F.lower(F.col(col)), [k.lower() for k in keywords])
    return chunks.where(pred).agg(F.count("*").alias("count"))


def transform_report(posts: DataFrame, as_of: Column, status: str = STATUS_BASIC,
                     minutes: int = REPORT_MINUTES, col: str = "updated_at") -> DataFrame:
    """Status, rows updated in the last ``minutes`` minutes, run time."""
    recent = posts.where(F.col(col) >= F.timestamp_add("MINUTE", F.lit(-minutes), as_of))
    return recent.agg(F.count("*").alias("records_processed")).select(
        F.lit(status).alias("status"), "records_processed", as_of.alias("processed_at"))


def table_counts(spark: SparkSession, tables: Mapping[str, DataFrame | str | None]) -> DataFrame:
    """Row count per table; a missing table reports 'N/A'.

    A table is a DataFrame, or the path of one (see
    ``feedlake.sources.tables``); None or an absent path counts as missing.
    """
    from feedlake.sources.tables import read
    parts = []
    for name, t in tables.items():
        df = read(spark, t) if isinstance(t, str) else t
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit("N/A").alias("row_count")))
        else:
            parts.append(df.agg(F.count("*").cast("string").alias("row_count"))
                         .select(F.lit(name).alias("table_name"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------ Q1 constraint audit


def audit_keys(df: DataFrame, key: str) -> DataFrame:
    """Q1 PRIMARY KEY / UNIQUE: keys that occur more than once (NULL keys too)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def audit_fk(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Q1 FOREIGN KEY: child rows whose non-NULL key has no parent (left anti join)."""
    p = parent.select(F.col(pk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(p, fk, "left_anti")


def audit_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q1 PRIMARY KEY / UNIQUE for several columns in one scan: (column, key, n) of values that occur more than once.

    NULL values count as one key; values are compared as text. The counts are
    partial per task, so a value that a third of all rows share is no hot group.
    """
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("key"))
                                 for k in keys])).alias("v")
    return (df.select(values).groupBy("v.column", "v.key").agg(F.count("*").alias("n"))
            .where(F.col("n") > 1))


def audit_length(df: DataFrame, limits: Mapping[str, int], key: str = "id") -> DataFrame:
    """Q1 VARCHAR(n): one row per value longer than its declared length, all columns in one scan."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.length(c).cast("long").alias("length"),
                                F.lit(n).cast("long").alias("max_length")) for c, n in limits.items()])
    over = F.filter(values, lambda v: v["length"] > v["max_length"])
    return df.select(F.col(key).alias("key"), F.inline(over))
