"""The three transforms as callables: raw rows to the source rows of their merge.

Each takes a batch or a streaming frame of raw rows; ``feedlake.streaming.merge_stream`` runs
them over the change stream, the registered queries over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.operators import articles as A
from feedlake.operators import upsert as U
from feedlake.operators.embed import enrich

#: Columns whose change counts, per pipeline.
ARTICLE_VALUES = ["title", "body"]
API_VALUES = ["title", "body_markdown", "level", "tags", "url", "published_at"]
RSS_VALUES = ["title", "body_markdown", "url", "published_at"]


def article_rows(raw: DataFrame) -> DataFrame:
    """Pipeline A: the article view of raw JSON feeds (P1), keyed by url."""
    return A.article_view(raw)


def api_rows(raw: DataFrame, as_of: Column | None = None, lookback_hours: int | None = A.LOOKBACK_HOURS) -> DataFrame:
    """Pipeline B: typed, complete items of raw API JSON (P2, P4-P10), keyed by id."""
    return A.complete(A.parse_api(raw, as_of=as_of, lookback_hours=lookback_hours)).where(F.col("id").isNotNull())


def rss_rows(raw: DataFrame, as_of: Column | None = None, lookback_hours: int | None = A.LOOKBACK_HOURS,
             max_items: int | None = None) -> DataFrame:
    """Pipeline C: items of raw RSS XML that have a title (P3), keyed by id = md5(link)."""
    items = A.parse_rss(raw, max_items)
    if lookback_hours is not None:
        items = A.lookback(items, as_of, lookback_hours)
    return items.where(F.col("title").isNotNull()).select("id", "title", "body_markdown", "url", "published_at", "fetched_at")


def api_posts(rows: DataFrame, as_of: Column, embedder=None, summarizer: Callable | None = None) -> DataFrame:
    """Posts of pipeline B: summary and embedding added."""
    return enrich(rows, embedder, summarizer).withColumns({"created_at": as_of, "updated_at": as_of}).select(*U.POST_COLS)


def rss_posts(rows: DataFrame, as_of: Column) -> DataFrame:
    """Posts of pipeline C: truncated summary, no embedding, constant level and tags."""
    return rows.select(
        "id", "title", "body_markdown", F.lit(A.RSS_LEVEL).alias("level"),
        F.array(*[F.lit(t) for t in A.RSS_TAGS]).alias("tags"),
        A.summary_trunc(F.col("body_markdown")).alias("summary"),
        F.lit(None).cast("array<float>").alias("emb"), "url", "published_at",
        as_of.alias("created_at"), as_of.alias("updated_at"))


def latest_api_posts(raw: DataFrame, as_of: Column, embedder=None, summarizer: Callable | None = None) -> DataFrame:
    """Pipeline B as one batch: one post per id, the latest fetch; only these are enriched."""
    return api_posts(U.latest_per_key(api_rows(raw, as_of), ["id"], ["fetched_at"]), as_of, embedder, summarizer)


def latest_rss_posts(raw: DataFrame, as_of: Column, max_items: int | None = None) -> DataFrame:
    """Pipeline C as one batch: one post per id, the latest fetch."""
    return rss_posts(U.latest_per_key(rss_rows(raw, as_of, max_items=max_items), ["id"], ["fetched_at"]), as_of)
