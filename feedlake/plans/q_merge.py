"""Registered dedup and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import articles as A
from feedlake.operators import pipelines as P
from feedlake.operators import upsert as U
from feedlake.operators.embed import EMBED_DIM
from feedlake.plans.oracle import (AS_OF, ARTICLE_VIEW, ENTRIES, POSTS, RAW_FEEDS, TARGET_CUTOFF,
                                   with_)
from feedlake.plans.q_articles import API, API_TYPED, XML_ITEMS
from feedlake.plans.registry import register
from feedlake.sources import testdata as D

def cutoff():
    """End of what the previous merge saw: rows fetched later are the stream's new offsets."""
    return F.timestamp_add("HOUR", F.lit(-D.TARGET_AGE_HOURS), D.ts_ntz(D.AS_OF))


def stream_rows(spark, sf_dir):
    """Article-view rows appended since the previous merge (the stream's new offsets)."""
    v = A.article_view(D.raw_json_feeds(spark, sf_dir))
    return v.where(F.col("fetched_at") > cutoff())


def merged_by_url(spark, sf_dir):
    return U.merge_by_url(D.posts_by_url(spark, sf_dir), stream_rows(spark, sf_dir), D.ts_ntz(D.AS_OF))


TARGET_BY_URL = f"""tgt AS (
  SELECT id, title, url, TRY_CAST(published_at AS TIMESTAMP) AS published_at,
         replace(body, 'the', 'teh') AS body, CAST(length(replace(body, 'the', 'teh')) AS BIGINT) AS body_length,
         min(fetched_at) OVER (PARTITION BY url) AS first_fetched_at,
         min(fetched_at) OVER (PARTITION BY url) AS last_updated_at
  FROM entries WHERE fetched_at <= {TARGET_CUTOFF}
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, id DESC) = 1)"""

SOURCE_BY_URL = f"""src AS (
  SELECT l.url, e.article_id, l.title, e.published_at, l.body, l.body_length, l.first_fetched_at
  FROM (SELECT url, title, body, CAST(body_length AS BIGINT) AS body_length,
               min(fetched_at) OVER (PARTITION BY url) AS first_fetched_at
        FROM article_view WHERE fetched_at > {TARGET_CUTOFF} AND url IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS FIRST, title DESC NULLS LAST,
                body DESC NULLS LAST, body_length DESC NULLS LAST) = 1) l
  JOIN (SELECT url, article_id, published_at
        FROM article_view WHERE fetched_at > {TARGET_CUTOFF} AND url IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at ASC NULLS LAST, article_id ASC NULLS FIRST,
                published_at ASC NULLS FIRST) = 1) e ON e.url = l.url)"""

MERGED_BY_URL = f"""merged AS (
  SELECT t.id, s.title, t.url, t.published_at, s.body, s.body_length, t.first_fetched_at,
         {AS_OF} AS last_updated_at, 'UPDATE' AS _action
  FROM tgt t JOIN src s ON t.url = s.url WHERE t.title <> s.title OR t.body <> s.body
  UNION ALL
  SELECT t.*, 'MATCHED' FROM tgt t JOIN src s ON t.url = s.url
  WHERE NOT coalesce(t.title <> s.title OR t.body <> s.body, false)
  UNION ALL
  SELECT t.*, 'KEEP' FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.url = t.url)
  UNION ALL
  SELECT s.article_id, s.title, s.url, s.published_at, s.body, s.body_length, s.first_fetched_at,
         {AS_OF}, 'INSERT' FROM src s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.url = s.url))"""

MERGE_BY_URL_SQL = with_(ENTRIES, RAW_FEEDS, ARTICLE_VIEW, TARGET_BY_URL, SOURCE_BY_URL, MERGED_BY_URL) + """
SELECT id, title, url, published_at, md5(body) AS body_md5, body_length, first_fetched_at, last_updated_at, _action
FROM merged"""


@register("merge_by_url", MERGE_BY_URL_SQL)
def merge_by_url(spark, sf_dir):
    """M1 + J11: upsert of new article-view rows into posts_by_url by URL."""
    m = merged_by_url(spark, sf_dir)
    return m.withColumn("body_md5", F.md5("body")).drop("body")


BUCKETS = 64


@register("merge_buckets", with_(ENTRIES, RAW_FEEDS, ARTICLE_VIEW, TARGET_BY_URL, SOURCE_BY_URL, MERGED_BY_URL) + """
SELECT id, title, url, published_at, md5(body) AS body_md5, body_length, first_fetched_at, last_updated_at
FROM merged""")
def merge_buckets(spark, sf_dir):
    """M1 in place on a bucketed posts_by_url table: only buckets touched by the source are rewritten."""
    import uuid
    from feedlake.session import scratch_dir
    from feedlake.sources import tables
    path = scratch_dir(spark, f"posts-by-url-{uuid.uuid4().hex}")
    target = D.posts_by_url(spark, sf_dir).withColumn(U.ACTION, F.lit(None).cast("string"))
    tables.write_bucketed(target, path, "url", BUCKETS)
    U.merge_by_url_into(path, stream_rows(spark, sf_dir), D.ts_ntz(D.AS_OF), BUCKETS)
    t = tables.read(spark, path, U.ARTICLES_TABLE).drop(tables.BUCKET, U.ACTION, U.BATCH)
    return t.withColumn("body_md5", F.md5("body")).drop("body")


@register("merge_report", with_(ENTRIES, RAW_FEEDS, ARTICLE_VIEW, TARGET_BY_URL, SOURCE_BY_URL, MERGED_BY_URL) + """
SELECT CAST(count(*) FILTER (WHERE _action = 'INSERT') AS BIGINT) AS inserted,
       CAST(count(*) FILTER (WHERE _action = 'UPDATE') AS BIGINT) AS updated,
       CAST(count(*) FILTER (WHERE _action = 'MATCHED') AS BIGINT) AS unchanged,
       CAST(count(*) FILTER (WHERE _action = 'KEEP') AS BIGINT) AS untouched,
       'Merge completed: ' || CAST(count(*) FILTER (WHERE _action IN ('INSERT', 'UPDATE')) AS VARCHAR)
         || ' rows affected' AS message
FROM merged""")
def merge_report(spark, sf_dir):
    """The merge procedure's counts and message."""
    return U.merge_report(merged_by_url(spark, sf_dir))


@register("merge_rejects", with_(ENTRIES, RAW_FEEDS, ARTICLE_VIEW, """nourl AS (
  SELECT * EXCLUDE (url), CASE WHEN length(title) % 3 <> 0 THEN url END AS url FROM article_view)""",
                                 TARGET_BY_URL, SOURCE_BY_URL.replace("article_view", "nourl"), MERGED_BY_URL) + f"""
SELECT CAST(count(*) FILTER (WHERE _action = 'INSERT') AS BIGINT) AS inserted,
       CAST(count(*) FILTER (WHERE _action = 'UPDATE') AS BIGINT) AS updated,
       CAST(count(*) FILTER (WHERE _action = 'MATCHED') AS BIGINT) AS unchanged,
       CAST(count(*) FILTER (WHERE _action = 'KEEP') AS BIGINT) AS untouched,
       (SELECT count(*) FROM (SELECT DISTINCT article_id, title, published_at, body, body_length FROM nourl
                              WHERE url IS NULL AND fetched_at > {TARGET_CUTOFF})) AS rejected,
       'Merge completed: ' || CAST(count(*) FILTER (WHERE _action IN ('INSERT', 'UPDATE')) AS VARCHAR)
         || ' rows affected' AS message
FROM merged""")
def merge_rejects(spark, sf_dir):
    """The merge's report with the source rows that have no URL (those whose title has a length divisible by 3)."""
    rows = stream_rows(spark, sf_dir)
    rows = rows.withColumn("url", F.when(F.length("title") % 3 != 0, F.col("url")))
    merged = U.merge_by_url(D.posts_by_url(spark, sf_dir), rows, D.ts_ntz(D.AS_OF))
    return U.merge_report(merged, U.rejected_rows(rows, "url"))


@register("dedup_min_fetch", with_(ENTRIES, RAW_FEEDS, ARTICLE_VIEW) + """
SELECT article_id, title, url, published_at, md5(body) AS body_md5, CAST(body_length AS BIGINT) AS body_length,
       min(fetched_at) AS first_fetched_at
FROM article_view GROUP BY article_id, title, url, published_at, body, body_length""")
def dedup_min_fetch(spark, sf_dir):
    """G1: identical article rows collapse, earliest fetch kept."""
    v = A.article_view(D.raw_json_feeds(spark, sf_dir))
    g = U.dedup_min_fetch(v, ["article_id", "title", "url", "published_at", "body", "body_length"])
    return g.withColumn("body_md5", F.md5("body")).drop("body")


@register("latest_per_id", with_(ENTRIES) + """
SELECT md5(body) AS id, doc_id, fetched_at FROM entries
QUALIFY row_number() OVER (PARTITION BY md5(body) ORDER BY fetched_at DESC NULLS FIRST, doc_id DESC) = 1""")
def latest_per_id(spark, sf_dir):
    """Latest row per id (id = md5 of the text, so natural copies share an id)."""
    e = D.feed_entries(spark, sf_dir).select(F.md5("body").alias("id"), "fetched_at", "doc_id")
    return U.latest_per_key(e, ["id"], ["fetched_at"]).select("id", "doc_id", "fetched_at")


# ------------------------------------------------------------ M2 (API JSON + enrichment)

PRIOR_POSTS = f"""prior AS (
  SELECT * REPLACE (replace(body_markdown, 'the', 'teh') AS body_markdown, NULL::FLOAT[] AS emb)
  FROM posts WHERE updated_at <= {TARGET_CUTOFF})"""

SRC_BY_ID = f"""src AS (
  SELECT id, title, body_markdown, level, tags, left(body_markdown, 200) || '...' AS summary,
         {EMBED_DIM} AS emb_dims, url, published_at, {AS_OF} AS created_at, {AS_OF} AS updated_at
  FROM api_typed
  WHERE fetched_at >= {AS_OF} - INTERVAL 24 HOUR AND type = 'TextNote'
    AND title IS NOT NULL AND length(trim(body_markdown)) > 0 AND id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS FIRST, title DESC NULLS LAST,
          body_markdown DESC NULLS LAST, level DESC NULLS LAST, tags DESC NULLS LAST, url DESC NULLS LAST,
          published_at DESC NULLS LAST) = 1)"""

MERGED_POSTS = """merged AS (
  SELECT t.id, s.title, s.body_markdown, s.level, s.tags, s.summary, s.emb_dims, s.url, s.published_at,
         t.created_at, s.updated_at, 'UPDATE' AS _action
  FROM prior t JOIN src s ON t.id = s.id
  UNION ALL
  SELECT t.id, t.title, t.body_markdown, t.level, t.tags, t.summary, CAST(len(t.emb) AS INTEGER), t.url,
         t.published_at, t.created_at, t.updated_at, 'KEEP'
  FROM prior t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.id = t.id)
  UNION ALL
  SELECT s.id, s.title, s.body_markdown, s.level, s.tags, s.summary, s.emb_dims, s.url, s.published_at,
         s.created_at, s.updated_at, 'INSERT'
  FROM src s WHERE NOT EXISTS (SELECT 1 FROM prior t WHERE t.id = s.id))"""

MERGED_POSTS_OUT = """
SELECT id, title, md5(body_markdown) AS body_md5, level, array_to_string(tags, ',') AS tags,
       md5(summary) AS summary_md5, CAST(emb_dims AS BIGINT) AS emb_dims, url, published_at, created_at,
       updated_at, _action
FROM merged"""


def _posts_out(m):
    return m.select("id", "title", F.md5("body_markdown").alias("body_md5"), "level", "tags",
                    F.md5("summary").alias("summary_md5"), F.size("emb").cast("long").alias("emb_dims"),
                    "url", "published_at", "created_at", "updated_at", U.ACTION)


def _emb_dims_null(m):
    return m.withColumn("emb_dims", F.when(F.col("emb_dims") >= 0, F.col("emb_dims")))


@register("merge_by_id", with_(POSTS, API, API_TYPED, PRIOR_POSTS, SRC_BY_ID, MERGED_POSTS) + MERGED_POSTS_OUT)
def merge_by_id(spark, sf_dir):
    """M2: API JSON transform with enrichment, upsert by id (unconditional update)."""
    as_of = D.ts_ntz(D.AS_OF)
    src = P.latest_api_posts(D.raw_api_feeds(spark, sf_dir), as_of)
    m = U.merge_posts(D.prior_posts(spark, sf_dir), src)
    return _emb_dims_null(_posts_out(m))


SRC_BASIC = f"""src AS (
  SELECT id, title, body_markdown, 'free' AS level, ['note.com', 'rss'] AS tags,
         left(body_markdown, 200) || '...' AS summary, NULL::INTEGER AS emb_dims, url, published_at,
         {AS_OF} AS created_at, {AS_OF} AS updated_at
  FROM xml_items
  WHERE fetched_at >= {AS_OF} - INTERVAL 24 HOUR AND idx < 50 AND title IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS FIRST, title DESC NULLS LAST,
          body_markdown DESC NULLS LAST, url DESC NULLS LAST, published_at DESC NULLS LAST) = 1)"""

PRIOR_BASIC = f"""prior AS (
  SELECT * REPLACE (md5(url) AS id, replace(body_markdown, 'the', 'teh') AS body_markdown, NULL::FLOAT[] AS emb)
  FROM posts WHERE updated_at <= {TARGET_CUTOFF})"""


@register("merge_basic", with_(POSTS, XML_ITEMS, PRIOR_BASIC, SRC_BASIC, MERGED_POSTS) + MERGED_POSTS_OUT)
def merge_basic(spark, sf_dir):
    """M3: RSS XML transform without models, upsert by id = md5(link)."""
    as_of = D.ts_ntz(D.AS_OF)
    src = P.latest_rss_posts(D.raw_xml_feeds(spark, sf_dir), as_of)
    m = U.merge_posts(D.prior_posts(spark, sf_dir, id_rule="md5url"), src)
    return _emb_dims_null(_posts_out(m))


# ------------------------------------------------------------ M2, M3 in place

PARTITIONS = 8

POSTS_TABLE_OUT = """
SELECT id, title, md5(body_markdown) AS body_md5, level, array_to_string(tags, ',') AS tags,
       md5(summary) AS summary_md5, CAST(emb_dims AS BIGINT) AS emb_dims, url, published_at, created_at, updated_at
FROM merged"""


def posts_table_out(t):
    return _emb_dims_null(_posts_out(t.withColumn(U.ACTION, F.lit(None).cast("string"))).drop(U.ACTION))


def _merged_in_place(spark, prior, source):
    import uuid
    from feedlake.session import scratch_dir
    from feedlake.sources import tables
    name = f"posts_{uuid.uuid4().hex}"
    tables.create_bucketed_table(prior, name, "id", scratch_dir(spark, name), PARTITIONS, PARTITIONS)
    U.merge_posts_into(source, name, PARTITIONS, PARTITIONS)
    return posts_table_out(spark.table(name))


@register("merge_by_id_into", with_(POSTS, API, API_TYPED, PRIOR_POSTS, SRC_BY_ID, MERGED_POSTS) + POSTS_TABLE_OUT)
def merge_by_id_into(spark, sf_dir):
    """M2 in place: the target's scan keeps its bucketing by id (no exchange), touched partitions are rewritten."""
    source = P.latest_api_posts(D.raw_api_feeds(spark, sf_dir), D.ts_ntz(D.AS_OF))
    return _merged_in_place(spark, D.prior_posts(spark, sf_dir), source)


@register("merge_basic_into", with_(POSTS, XML_ITEMS, PRIOR_BASIC, SRC_BASIC, MERGED_POSTS) + POSTS_TABLE_OUT)
def merge_basic_into(spark, sf_dir):
    """M3 in place."""
    source = P.latest_rss_posts(D.raw_xml_feeds(spark, sf_dir), D.ts_ntz(D.AS_OF))
    return _merged_in_place(spark, D.prior_posts(spark, sf_dir, id_rule="md5url"), source)
