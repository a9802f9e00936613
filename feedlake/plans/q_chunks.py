"""Registered chunking and refresh queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedlake.operators import chunks as C
from feedlake.operators import upsert as U
from feedlake.plans.oracle import AS_OF, NL, POSTS, with_
from feedlake.plans.registry import register
from feedlake.session import scratch_dir
from feedlake.sources import tables
from feedlake.sources import testdata as D

SEP = "\n"   # the test prose separates paragraphs by single newlines (no blank lines occur)


def _out(c):
    return c.select("chunk_id", "article_id", "article_url", "chunk_index",
                    F.md5("chunk_text").alias("chunk_md5"), "chunk_length")


def recursive(text_sql: str, source: str, key: str, filtered: bool = True) -> str:
    """The reference's recursive chunk generator, applied per row (DuckDB)."""
    where = "WHERE chunk_text IS NOT NULL AND length(chunk_text) > 50" if filtered else ""
    return f"""chunks AS (
  WITH RECURSIVE r AS (
    SELECT {key} AS k, 0 AS chunk_index, substr(t, 1, 1000) AS chunk_text, 800 AS next_pos,
           length(t) AS text_length, t
    FROM (SELECT *, {text_sql} AS t FROM {source})
    UNION ALL
    SELECT k, chunk_index + 1, substr(t, next_pos + 1, 1000), next_pos + 800, text_length, t
    FROM r WHERE next_pos < text_length)
  SELECT k, chunk_index, chunk_text, next_pos, text_length FROM r {where})"""


@register("chunks_window", with_(recursive("text", "documents", "doc_id")) + """
SELECT k AS doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, md5(chunk_text) AS chunk_md5,
       CAST(length(chunk_text) AS BIGINT) AS chunk_length FROM chunks""")
def chunks_window(spark, sf_dir):
    """SPLIT_TEXT_TO_CHUNKS(text, 1000, 200) over every document."""
    d = D.documents(spark, sf_dir, spread=True).select("doc_id", "text")
    c = C.window_chunks(d, "text")
    return c.select("doc_id", "chunk_index", F.md5("chunk_text").alias("chunk_md5"),
                    F.length("chunk_text").alias("chunk_length"))


@register("chunk_sequence", with_(recursive("text", "documents", "doc_id", filtered=False)) + """
SELECT k AS doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(next_pos - 800 + 1 AS BIGINT) AS start_pos,
       CAST(next_pos AS BIGINT) AS next_pos, CAST(text_length AS BIGINT) AS text_length FROM chunks""")
def chunk_sequence(spark, sf_dir):
    """The positions the recursive generator visits, closed form."""
    d = D.documents(spark, sf_dir, spread=True).select("doc_id", "text")
    return C.chunk_steps(d, "text").drop("text")


CHUNK_ID = "md5(article_id || '#' || CAST(chunk_index AS VARCHAR))"

POST_CHUNKS_SQL = with_(POSTS, recursive(f"title || {NL} || {NL} || body_markdown", "posts", "id")) + f"""
SELECT md5(k || '#' || CAST(chunk_index AS VARCHAR)) AS chunk_id, k AS article_id,
       (SELECT url FROM posts p WHERE p.id = k) AS article_url, CAST(chunk_index AS BIGINT) AS chunk_index,
       md5(chunk_text) AS chunk_md5, CAST(length(chunk_text) AS BIGINT) AS chunk_length FROM chunks"""


@register("chunks_posts", POST_CHUNKS_SQL)
def chunks_posts(spark, sf_dir):
    """CREATE_ARTICLE_CHUNKS over all posts (title, blank line, body)."""
    return _out(C.post_chunks(D.posts(spark, sf_dir, with_emb=False), D.ts_ntz(D.AS_OF)))


@register("chunk_lateral", with_(POSTS) + """
SELECT p.id, CAST(r.k AS BIGINT) AS chunk_index, md5(substr(p.body_markdown, CAST(r.k * 800 + 1 AS BIGINT), 1000)) AS chunk_md5
FROM posts p, range(0, CAST(greatest(1, ceil(length(p.body_markdown) / 800.0)) AS BIGINT)) r(k)
WHERE length(substr(p.body_markdown, CAST(r.k * 800 + 1 AS BIGINT), 1000)) > 50""")
def chunk_lateral(spark, sf_dir):
    """Lateral table-function call per row (sequence + substring form)."""
    p = D.posts(spark, sf_dir, with_emb=False).select("id", "body_markdown")
    c = C.window_chunks_closed_form(p, "body_markdown")
    return c.select("id", "chunk_index", F.md5("chunk_text").alias("chunk_md5"))


def _paragraph_sql(min_len: int, trimmed: bool) -> str:
    txt = "trim(v)" if trimmed else "v"
    return with_(POSTS, f"""pieces AS (
  SELECT id, url, unnest(string_split(body_markdown, {NL})) AS v,
         generate_subscripts(string_split(body_markdown, {NL}), 1) - 1 AS pos FROM posts)""") + f"""
SELECT md5(id || '#' || CAST(pos AS VARCHAR)) AS chunk_id, id AS article_id, url AS article_url,
       CAST(pos AS BIGINT) AS chunk_index, md5({txt}) AS chunk_md5, CAST(length({txt}) AS BIGINT) AS chunk_length
FROM pieces WHERE length(trim(v)) > {min_len}"""


@register("chunks_paragraph", _paragraph_sql(100, True))
def chunks_paragraph(spark, sf_dir):
    """Trimmed paragraphs longer than 100 characters."""
    return _out(C.paragraph_chunks(D.posts(spark, sf_dir, with_emb=False), sep=SEP, min_len=100,
                                   trim_output=True, as_of=D.ts_ntz(D.AS_OF)))


@register("chunks_loose", _paragraph_sql(50, False))
def chunks_loose(spark, sf_dir):
    """C4: untrimmed paragraphs whose trimmed length exceeds 50."""
    return _out(C.paragraph_chunks(D.posts(spark, sf_dir, with_emb=False), sep=SEP, min_len=50,
                                   trim_output=False, as_of=D.ts_ntz(D.AS_OF)))


@register("split_lateral", with_(POSTS) + f"""
SELECT id, CAST(generate_subscripts(string_split(body_markdown, {NL}), 1) - 1 AS BIGINT) AS pos,
       md5(unnest(string_split(body_markdown, {NL}))) AS value_md5 FROM posts""")
def split_lateral(spark, sf_dir):
    """Lateral split of the body on a literal separator."""
    s = C.split_lateral(D.posts(spark, sf_dir, with_emb=False), sep=SEP)
    return s.select("id", "pos", F.md5("value").alias("value_md5"))


@register("chunks_labelled", with_(POSTS) + f"""
SELECT md5(id || '#1') AS chunk_id, id AS article_id, url AS article_url, CAST(1 AS BIGINT) AS chunk_index,
       md5('【タイトル】' || title || {NL} || {NL} || '【内容】' || body_markdown || {NL} || {NL} || '【URL】' || url) AS chunk_md5,
       CAST(length(title || body_markdown) AS BIGINT) AS chunk_length FROM posts""")
def chunks_labelled(spark, sf_dir):
    """One labelled chunk per article."""
    return _out(C.labelled_chunks(D.posts(spark, sf_dir, with_emb=False), D.ts_ntz(D.AS_OF)))


@register("full_refresh", POST_CHUNKS_SQL)
def full_refresh(spark, sf_dir):
    """TRUNCATE + INSERT of the chunk table, read back."""
    path = scratch_dir(spark, f"chunks-{uuid.uuid4().hex}")
    old = C.paragraph_chunks(D.posts(spark, sf_dir, with_emb=False), sep=SEP, as_of=D.ts_ntz(D.AS_OF))
    tables.overwrite(old, path)
    tables.overwrite(C.post_chunks(D.posts(spark, sf_dir, with_emb=False), D.ts_ntz(D.AS_OF)), path)
    return _out(tables.read(spark, path))


@register("partial_refresh", with_(POSTS, f"""old_posts AS (
  SELECT * REPLACE (replace(body_markdown, 'the', 'teh') AS body_markdown) FROM posts)""", f"""new_posts AS (
  SELECT * FROM posts WHERE updated_at >= {AS_OF} - INTERVAL 24 HOUR)""", f"""old_pieces AS (
  SELECT id, url, unnest(string_split(body_markdown, {NL})) AS v,
         generate_subscripts(string_split(body_markdown, {NL}), 1) - 1 AS pos FROM old_posts)""", f"""new_pieces AS (
  SELECT id, url, unnest(string_split(body_markdown, {NL})) AS v,
         generate_subscripts(string_split(body_markdown, {NL}), 1) - 1 AS pos FROM new_posts)""") + """
SELECT md5(id || '#' || CAST(pos AS VARCHAR)) AS chunk_id, id AS article_id, url AS article_url,
       CAST(pos AS BIGINT) AS chunk_index, md5(trim(v)) AS chunk_md5, CAST(length(trim(v)) AS BIGINT) AS chunk_length
FROM old_pieces WHERE length(trim(v)) > 100 AND url NOT IN (SELECT url FROM new_posts)
UNION ALL
SELECT md5(id || '#' || CAST(pos AS VARCHAR)), id, url, CAST(pos AS BIGINT), md5(trim(v)), CAST(length(trim(v)) AS BIGINT)
FROM new_pieces WHERE length(trim(v)) > 100""")
def partial_refresh(spark, sf_dir):
    """S13 + J10: delete chunks of re-fetched posts (IN subquery), insert their new chunks."""
    as_of = D.ts_ntz(D.AS_OF)
    posts = D.posts(spark, sf_dir, with_emb=False)
    old_posts = posts.withColumn("body_markdown", D.revised_old(F.col("body_markdown")))
    new_posts = posts.where(F.col("updated_at") >= F.timestamp_add("HOUR", F.lit(-24), as_of))
    old = C.paragraph_chunks(old_posts, sep=SEP, as_of=as_of)
    new = C.paragraph_chunks(new_posts, sep=SEP, as_of=as_of)
    return _out(U.partial_refresh(old, new, new_posts))
