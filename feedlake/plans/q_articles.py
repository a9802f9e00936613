"""Registered flatten/typing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import articles as A
from feedlake.plans.oracle import (AS_OF, ARTICLE_VIEW, ENTRIES, EPOCH, FETCHED, NL, PUBLISHED,
                                   RAW_FEEDS, with_)
from feedlake.plans.registry import register
from feedlake.sources import testdata as D

API = f"""api AS (
  SELECT doc_id, source,
         CASE WHEN lang <> 'en' THEN 'n' || CAST(doc_id AS VARCHAR) END AS key,
         CASE WHEN source <> 'src0' THEN CAST(doc_id AS VARCHAR) END AS id,
         split_part(text, {NL}, 1) AS name, text AS body,
         CASE WHEN n_chars >= 5000 THEN 300.0 WHEN lang = 'fr' THEN 0.6 ELSE 0.0 END AS price,
         lang = 'de' AS is_membership, '#' || lang AS hashtag, source || '/x' AS urlname,
         strftime({PUBLISHED}, '%Y-%m-%dT%H:%M:%S') AS published,
         CASE WHEN n_chars < 200 THEN 'ImageNote' ELSE 'TextNote' END AS type,
         {FETCHED} AS fetched_at
  FROM documents)"""

API_TYPED = """api_typed AS (
  SELECT COALESCE(key, id, md5(name || published)) AS id, name AS title, body AS body_markdown,
         CASE WHEN round(price) > 0 THEN 'premium' WHEN is_membership THEN 'membership' ELSE 'free' END AS level,
         [hashtag, 'note.com', split_part(urlname, '/', 1)] AS tags,
         'https://note.com/' || urlname || '/n/' || key AS url,
         CAST(published AS TIMESTAMP) AS published_at, type, fetched_at
  FROM api)"""

LOOKBACK = f"fetched_at >= {AS_OF} - INTERVAL 24 HOUR"


def _api(spark, sf_dir, **kw):
    return A.parse_api(D.raw_api_feeds(spark, sf_dir), as_of=D.ts_ntz(D.AS_OF), **kw)


@register("article_view", with_(ENTRIES, RAW_FEEDS, ARTICLE_VIEW) + """
SELECT raw_id, source_url, fetched_at, article_id, title, url, published_at, md5(body) AS body_md5,
       CAST(body_length AS BIGINT) AS body_length FROM article_view""")
def article_view(spark, sf_dir):
    """P1 + J7: article view over RAW JSON feed rows."""
    v = A.article_view(D.raw_json_feeds(spark, sf_dir))
    return v.withColumn("body_md5", F.md5("body")).drop("body")


@register("array_counts", with_(ENTRIES, RAW_FEEDS) + """
SELECT id, CAST(json_array_length(raw_data) AS BIGINT) AS article_count FROM raw_feeds""")
def array_counts(spark, sf_dir):
    """Element count of each raw feed row's array."""
    raw = D.raw_json_feeds(spark, sf_dir)
    return raw.select("id", A.array_size(raw).alias("article_count"))


@register("api_articles", with_(API, API_TYPED) + f"""
SELECT id, title, md5(body_markdown) AS body_md5, level, array_to_string(tags, ',') AS tags, url,
       published_at, fetched_at
FROM api_typed WHERE {LOOKBACK} AND type = 'TextNote'""")
def api_articles(spark, sf_dir):
    """P2 (+P8, P9): API JSON articles of the last 24 hours, TextNote only."""
    a = _api(spark, sf_dir)
    return a.withColumn("body_md5", F.md5("body_markdown")).drop("body_markdown")


@register("levels", with_(API, API_TYPED) + "SELECT id, level FROM api_typed")
def levels(spark, sf_dir):
    """Access level of every API article."""
    return _api(spark, sf_dir, lookback_hours=None, item_type=None).select("id", "level")


@register("tags", with_(API, API_TYPED) + "SELECT id, array_to_string(tags, ',') AS tags FROM api_typed")
def tags(spark, sf_dir):
    """P5: tag arrays of every API article."""
    return _api(spark, sf_dir, lookback_hours=None, item_type=None).select("id", "tags")


@register("urls", with_(API, API_TYPED) + "SELECT id, url FROM api_typed")
def urls(spark, sf_dir):
    """Article URLs (NULL where the key is missing)."""
    return _api(spark, sf_dir, lookback_hours=None, item_type=None).select("id", "url")


@register("ids", with_(API) + """
SELECT key, id AS raw_id, COALESCE(key, id, md5(name || published)) AS id FROM api""")
def ids(spark, sf_dir):
    """Id derivation key -> id -> md5(name || publishedAt)."""
    raw = D.raw_api_feeds(spark, sf_dir)
    c = A.api_contents(raw)
    a = F.col("article")

    def s(p):
        return F.try_variant_get(a, p, "string")
    return c.select(s("$.key").alias("key"), s("$.id").alias("raw_id"),
                    A.api_id(s("$.key"), s("$.id"), s("$.name"), s("$.publishedAt")).alias("id"))


@register("lookback", with_(API, API_TYPED) + f"SELECT id, fetched_at FROM api_typed WHERE {LOOKBACK}")
def lookback(spark, sf_dir):
    """API articles fetched in the 24 hours before the run."""
    return _api(spark, sf_dir, item_type=None).select("id", "fetched_at")


@register("type_filter", with_(API, API_TYPED) + "SELECT id, title FROM api_typed WHERE type = 'TextNote'")
def type_filter(spark, sf_dir):
    """API articles of type TextNote."""
    return _api(spark, sf_dir, lookback_hours=None).select("id", "title")


@register("complete_filter", with_(API, API_TYPED) + """
SELECT id FROM api_typed WHERE title IS NOT NULL AND length(trim(body_markdown)) > 0""")
def complete_filter(spark, sf_dir):
    """P10: title present and non-blank body."""
    return A.complete(_api(spark, sf_dir, lookback_hours=None, item_type=None)).select("id")


@register("summary_trunc", with_(API, API_TYPED) + """
SELECT id, left(body_markdown, 200) || '...' AS summary FROM api_typed""")
def summary_trunc(spark, sf_dir):
    """P11 / default E3: truncation summary."""
    a = _api(spark, sf_dir, lookback_hours=None, item_type=None)
    return a.select("id", A.summary_trunc(F.col("body_markdown")).alias("summary"))


@register("prompt", with_(API, API_TYPED) + f"""
SELECT id, md5('Summarize this blog post in 2-3 sentences in Japanese. ' ||
               'Focus on the main topic and key takeaways:' || {NL} || {NL} ||
               'Title: ' || title || {NL} || {NL} || 'Content: ' || left(body_markdown, 2000)) AS prompt_md5,
       length('Summarize this blog post in 2-3 sentences in Japanese. ' ||
               'Focus on the main topic and key takeaways:' || {NL} || {NL} ||
               'Title: ' || title || {NL} || {NL} || 'Content: ' || left(body_markdown, 2000)) AS prompt_length
FROM api_typed""")
def prompt(spark, sf_dir):
    """Summarisation prompt (compared by md5 and length)."""
    a = _api(spark, sf_dir, lookback_hours=None, item_type=None)
    p = A.summary_prompt(F.col("title"), F.col("body_markdown"), A.PROMPT_CHARS)
    return a.select("id", F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_length"))


@register("embed_input", with_(API, API_TYPED) + """
SELECT id, title || ' ' || COALESCE(left(body_markdown, 1000), '') AS embed_input FROM api_typed""")
def embed_input_q(spark, sf_dir):
    """Embedding input text."""
    a = _api(spark, sf_dir, lookback_hours=None, item_type=None)
    return a.select("id", A.embed_input(F.col("title"), F.col("body_markdown"), A.EMBED_CHARS).alias("embed_input"))


XML_ITEMS = f"""xml_items AS (
  SELECT md5('https://example.com/' || source || '/n/' || CAST(doc_id AS VARCHAR)) AS id,
         split_part(text, {NL}, 1) AS title, text AS body_markdown,
         'https://example.com/' || source || '/n/' || CAST(doc_id AS VARCHAR) AS url,
         ({EPOCH} + to_minutes(CAST(doc_id AS BIGINT))) AS published_at,
         CAST(row_number() OVER (PARTITION BY source, {FETCHED}, doc_id // 12000 ORDER BY doc_id) - 1 AS BIGINT) AS idx,
         {FETCHED} AS fetched_at
  FROM documents)"""


@register("xml_articles", with_(XML_ITEMS) + """
SELECT id, title, md5(body_markdown) AS body_md5, 'free' AS level, 'note.com,rss' AS tags, url,
       published_at, idx, fetched_at FROM xml_items WHERE idx < 50""")
def xml_articles(spark, sf_dir):
    """P3 + J6: RSS XML items (at most 50 per feed) as typed articles."""
    r = A.parse_rss(D.raw_xml_feeds(spark, sf_dir))
    return r.withColumn("body_md5", F.md5("body_markdown")).drop("body_markdown")


@register("variant_path", """
SELECT event_id, event_type, CAST(round(TRY_CAST(json_extract(props, '$.k') AS DOUBLE)) AS BIGINT) AS k
FROM events""")
def variant_path(spark, sf_dir):
    """§2.11 path access: events.props parsed to a variant, ``props:k::INT`` for every event."""
    from feedlake.functions.variant import as_int
    e = D.table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", as_int(F.try_parse_json("props"), "k").alias("k"))


_WALL = f"({EPOCH} + to_minutes(CAST(doc_id AS BIGINT)))"
_EAST = "[540, 0, 0, -300, -210, 0][CAST(doc_id % 6 AS INT) + 1]"


@register("zoned_dates", f"""
SELECT doc_id, {_WALL} - to_minutes({_EAST}) AS rss_utc, {_WALL} - to_minutes({_EAST}) AS iso_utc,
       {_WALL} AS iso_wall, CASE WHEN doc_id % 6 = 2 THEN {_WALL} END AS rss_reference
FROM documents""")
def zoned_dates(spark, sf_dir):
    """Dates with and without an offset as UTC, and as the warehouse reads them."""
    from feedlake.functions.dates import iso_utc, rss_utc
    return D.zoned_dates(spark, sf_dir).select(
        "doc_id", rss_utc(F.col("rss")).alias("rss_utc"), iso_utc(F.col("iso")).alias("iso_utc"),
        iso_utc(F.col("iso"), wall_clock=True).alias("iso_wall"), rss_utc(F.col("rss"), reference=True).alias("rss_reference"))
