"""Registered profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.text import like_any, preview
from feedlake.operators import articles as A
from feedlake.operators import profile as PR
from feedlake.plans.oracle import AS_OF, ARTICLE_VIEW, ENTRIES, POSTS, RAW_FEEDS, with_
from feedlake.plans.q_merge import (API, API_TYPED, MERGED_POSTS, PRIOR_BASIC, PRIOR_POSTS, SRC_BASIC, SRC_BY_ID, merge_basic,
                                     merge_by_id)
from feedlake.plans.q_articles import XML_ITEMS
from feedlake.plans.q_vectors import CHUNKS_SQL, VECTORS_SQL, chunks
from feedlake.plans.registry import register
from feedlake.sources import testdata as D

# Parameters of the registered profiles: words that occur in the test prose
# (the reference's own lists, kept in operators.profile, name Japanese music terms).
KEYWORDS = ["the", "and", "tion", "des", "les", "sch", "ment", "eaux"]
FIELDS = {"title": ["the", "les", "und", "ment", "tion", "ing", "eaux", "ier", "ach"],
          "body": ["and", "des", "sch", "qui", "ung"]}
CHUNK_WORDS = ["mic", "tion", "eaux"]
HIT_WORDS = ["the", "ment", "sch"]

PB = "posts_b AS (SELECT * EXCLUDE (body_markdown), body_markdown AS body FROM posts)"


def posts_b(spark, sf_dir):
    return D.posts(spark, sf_dir, with_emb=False).withColumnRenamed("body_markdown", "body")


def _like_any_sql(col: str, words: list[str], lower: bool = False) -> str:
    c = f"lower({col})" if lower else col
    return "(" + " OR ".join(f"{c} LIKE '%{w.lower() if lower else w}%'" for w in words) + ")"


@register("post_count", with_(POSTS) + "SELECT count(*) AS cnt FROM posts")
def post_count(spark, sf_dir):
    """Total posts."""
    return PR.row_count(D.posts(spark, sf_dir, with_emb=False))


@register("latest_update", with_(POSTS) + "SELECT max(updated_at) AS latest_update FROM posts")
def latest_update(spark, sf_dir):
    """Latest update time."""
    return PR.latest(D.posts(spark, sf_dir, with_emb=False))


@register("chunks_per_article", with_(POSTS, CHUNKS_SQL) + """
SELECT article_url, count(*) AS chunk_count, CAST(max(chunk_length) AS BIGINT) AS max_length
FROM chunks GROUP BY article_url ORDER BY chunk_count DESC, article_url NULLS FIRST LIMIT 5""")
def chunks_per_article(spark, sf_dir):
    """Chunks per article, top 5."""
    return PR.chunks_per_article(chunks(spark, sf_dir))


@register("chunk_post_hits", with_(POSTS, CHUNKS_SQL) + f"""
SELECT c.article_url, p.title, c.chunk_id, CAST(c.chunk_index AS BIGINT) AS chunk_index
FROM chunks c JOIN posts p ON c.article_url = p.url WHERE {_like_any_sql('c.chunk_text', HIT_WORDS)}""")
def chunk_post_hits(spark, sf_dir):
    """Chunks joined to posts by URL with a keyword filter."""
    return PR.chunk_post_hits(chunks(spark, sf_dir), D.posts(spark, sf_dir, with_emb=False), HIT_WORDS)


@register("hits_per_article", with_(POSTS, CHUNKS_SQL) + f"""
SELECT c.article_url, p.title, count(*) AS match_count
FROM chunks c JOIN posts p ON c.article_url = p.url WHERE {_like_any_sql('c.chunk_text', HIT_WORDS)}
GROUP BY c.article_url, p.title""")
def hits_per_article(spark, sf_dir):
    """Matching chunks per (url, title)."""
    return PR.hits_per_article(chunks(spark, sf_dir), D.posts(spark, sf_dir, with_emb=False), HIT_WORDS)


@register("chunk_stats", with_(POSTS, CHUNKS_SQL) + """
SELECT count(*) AS total_chunks, round(avg(chunk_length), 6) AS avg_length,
       CAST(max(chunk_length) AS BIGINT) AS max_length FROM chunks""")
def chunk_stats(spark, sf_dir):
    """Chunk count, average and maximum length."""
    return PR.chunk_stats(chunks(spark, sf_dir))


@register("articles_with_chunks", with_(POSTS, CHUNKS_SQL) + "SELECT count(DISTINCT article_url) AS cnt FROM chunks")
def articles_with_chunks(spark, sf_dir):
    """Distinct articles with chunks."""
    return PR.articles_with_chunks(chunks(spark, sf_dir))


@register("keyword_df", with_(POSTS, PB) + " UNION ALL ".join(
    f"SELECT '{k}' AS keyword, count(*) FILTER (WHERE body LIKE '%{k}%') AS cnt FROM posts_b" for k in KEYWORDS))
def keyword_df(spark, sf_dir):
    """Per-keyword article counts (case-sensitive), in one pass."""
    return PR.keyword_df(posts_b(spark, sf_dir), KEYWORDS)


@register("keyword_by_field", with_(POSTS, PB) + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, '{k}' AS keyword, count(*) FILTER (WHERE lower({f}) LIKE lower('%{k}%')) AS cnt FROM posts_b"
    for f, ks in FIELDS.items() for k in ks) + ") WHERE cnt > 0")
def keyword_by_field(spark, sf_dir):
    """Case-insensitive keyword counts per field, zeros hidden."""
    return PR.keyword_by_field(posts_b(spark, sf_dir), FIELDS)


@register("keyword_any_count", with_(POSTS, CHUNKS_SQL) + f"""
SELECT count(*) AS count FROM chunks WHERE {_like_any_sql('chunk_text', CHUNK_WORDS, lower=True)}""")
def keyword_any_count(spark, sf_dir):
    """Chunks mentioning any keyword."""
    return PR.keyword_any_count(chunks(spark, sf_dir), CHUNK_WORDS)


@register("keyword_any", with_(POSTS, PB) + f"SELECT id FROM posts_b WHERE {_like_any_sql('body', KEYWORDS[:3])}")
def keyword_any(spark, sf_dir):
    """Posts whose body contains any of the keywords."""
    return posts_b(spark, sf_dir).where(like_any("body", KEYWORDS[:3])).select("id")


@register("short_posts", with_(POSTS, PB) + """
SELECT id, url, title, CAST(length(body) AS BIGINT) AS body_length FROM posts_b WHERE length(body) < 500
ORDER BY published_at DESC NULLS FIRST, id LIMIT 5""")
def short_posts(spark, sf_dir):
    """The newest short articles (length < 500), top 5."""
    p = posts_b(spark, sf_dir).where(F.length("body") < 500)
    return (p.orderBy(F.desc_nulls_first("published_at"), F.asc("id")).limit(5)
            .select("id", "url", "title", F.length("body").alias("body_length")))


@register("previews", with_(POSTS, PB) + """
SELECT id, title, url, substring(body, 1, 200) AS body_preview, CAST(length(body) AS BIGINT) AS body_length FROM posts_b""")
def previews(spark, sf_dir):
    """200-character previews with lengths."""
    p = posts_b(spark, sf_dir)
    return p.select("id", "title", "url", preview("body", 200).alias("body_preview"),
                    F.length("body").alias("body_length"))


@register("longest", with_(POSTS, PB) + """
SELECT title, url, CAST(length(body) AS BIGINT) AS body_length, substring(body, 1, 200) AS body_preview
FROM posts_b ORDER BY body_length DESC, url LIMIT 5""")
def longest(spark, sf_dir):
    """T4: longest articles first, top 5."""
    p = posts_b(spark, sf_dir)
    return (p.select("title", "url", F.length("body").alias("body_length"), preview("body", 200).alias("body_preview"))
            .orderBy(F.desc("body_length"), F.asc("url")).limit(5))


@register("newest", with_(POSTS) + """
SELECT title FROM posts ORDER BY published_at DESC NULLS FIRST, id LIMIT 10""")
def newest(spark, sf_dir):
    """T5: titles of the latest 10 posts."""
    p = D.posts(spark, sf_dir, with_emb=False)
    return p.orderBy(F.desc_nulls_first("published_at"), F.asc("id")).limit(10).select("title")


@register("sample")
def sample(spark, sf_dir):
    """Plain sample limit (rows only)."""
    return D.posts(spark, sf_dir, with_emb=False).select("id", "title").limit(10)


@register("sample_rows", with_(POSTS) + """
SELECT least(count(*), 10) AS rows, least(count(*), 10) AS different, least(count(*), 10) AS of_the_table FROM posts""")
def sample_rows(spark, sf_dir):
    """A sample holds as many rows as it may, different ones, all of them the table's."""
    p = D.posts(spark, sf_dir, with_emb=False).select("id", "title")
    taken = sample(spark, sf_dir).withColumn("taken", F.lit(1))
    own = p.withColumn("own", F.lit(1)).distinct()
    return taken.join(own, ["id", "title"], "left").agg(
        F.count("taken").alias("rows"), F.count_distinct("id").alias("different"), F.count("own").alias("of_the_table"))


@register("transform_report", with_(POSTS, XML_ITEMS, PRIOR_BASIC, SRC_BASIC, MERGED_POSTS) + f"""
SELECT 'Transform completed (Basic version - no Cortex)' AS status, count(*) AS records_processed,
       {AS_OF} AS processed_at FROM merged WHERE updated_at >= {AS_OF} - INTERVAL 5 MINUTE""")
def transform_report(spark, sf_dir):
    """Report of the basic transform (rows updated in the last 5 minutes)."""
    return PR.transform_report(merge_basic(spark, sf_dir), D.ts_ntz(D.AS_OF))


@register("transform_report_enriched", with_(POSTS, API, API_TYPED, PRIOR_POSTS, SRC_BY_ID, MERGED_POSTS) + f"""
SELECT 'Transform completed' AS status, count(*) AS records_processed,
       {AS_OF} AS processed_at FROM merged WHERE updated_at >= {AS_OF} - INTERVAL 5 MINUTE""")
def transform_report_enriched(spark, sf_dir):
    """Report of the enriched transform (rows updated in the last 5 minutes)."""
    return PR.transform_report(merge_by_id(spark, sf_dir), D.ts_ntz(D.AS_OF), PR.STATUS_ENRICHED)


@register("audit_unique", with_(POSTS) + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {c} AS key, count(*) AS n FROM posts GROUP BY {c} HAVING count(*) > 1"
    for c in ("id", "url", "title")))
def audit_unique(spark, sf_dir):
    """Q1: values that occur more than once in the columns declared or expected to be unique, in one scan."""
    return PR.audit_unique(D.posts(spark, sf_dir, with_emb=False), ["id", "url", "title"])


@register("table_counts", with_(ENTRIES, RAW_FEEDS, POSTS, CHUNKS_SQL, VECTORS_SQL) + """
SELECT 'raw.feed_raw' AS table_name, CAST(count(*) AS VARCHAR) AS row_count FROM raw_feeds
UNION ALL SELECT 'core.posts', CAST(count(*) AS VARCHAR) FROM posts
UNION ALL SELECT 'stg.chunks', CAST(count(*) AS VARCHAR) FROM chunks
UNION ALL SELECT 'stg.embeddings', CAST(count(*) AS VARCHAR) FROM vectors
UNION ALL SELECT 'stg.rejects', 'N/A'""")
def table_counts(spark, sf_dir):
    """Row counts of the tables, 'N/A' for a table that does not exist."""
    from feedlake.session import scratch_dir
    import uuid
    return PR.table_counts(spark, {
        "raw.feed_raw": D.raw_json_feeds(spark, sf_dir),
        "core.posts": D.posts(spark, sf_dir, with_emb=False),
        "stg.chunks": chunks(spark, sf_dir),
        "stg.embeddings": D.chunk_vectors(spark, sf_dir),
        "stg.rejects": scratch_dir(spark, f"absent-{uuid.uuid4().hex}"),
    })


@register("audit_keys", with_(ENTRIES, RAW_FEEDS, ARTICLE_VIEW) + """
SELECT article_id, count(*) AS n FROM article_view GROUP BY article_id HAVING count(*) > 1""")
def audit_keys(spark, sf_dir):
    """Q1: article ids that occur more than once in the article view."""
    return PR.audit_keys(A.article_view(D.raw_json_feeds(spark, sf_dir)), "article_id")


@register("audit_fk", with_(POSTS, CHUNKS_SQL, VECTORS_SQL) + """
SELECT embedding_id, chunk_id, model_name FROM vectors v WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = v.chunk_id)""")
def audit_fk(spark, sf_dir):
    """Q1: embeddings whose chunk does not exist."""
    v = D.chunk_vectors(spark, sf_dir).select("embedding_id", "chunk_id", "model_name")
    return PR.audit_fk(v, chunks(spark, sf_dir), "chunk_id", "chunk_id")


@register("audit_length", with_(POSTS) + " UNION ALL ".join(
    f"SELECT id AS key, '{c}' AS column, CAST(length({c}) AS BIGINT) AS length, CAST({n} AS BIGINT) AS max_length "
    f"FROM posts WHERE length({c}) > {n}" for c, n in {"id": 36, "title": 500, "url": 500}.items()))
def audit_length(spark, sf_dir):
    """Q1: values longer than their declared VARCHAR(n)."""
    return PR.audit_length(D.posts(spark, sf_dir, with_emb=False), {"id": 36, "title": 500, "url": 500})
