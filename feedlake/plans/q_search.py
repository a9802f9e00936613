"""Registered search and recommendation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedlake.operators import recommend as R
from feedlake.operators import search as S
from feedlake.plans.oracle import POSTS, text_score, with_
from feedlake.plans.registry import register
from feedlake.session import scratch_dir
from feedlake.sources import testdata as D

# Parameters of the registered queries (the query words occur in the test prose).
QUERY = "the"
QUERY_RARE = "tion"
SEED = 7


@register("search_text", with_(POSTS) + f"""
SELECT id, title, summary, url, published_at, array_to_string(tags, ',') AS tags,
       {text_score(QUERY)} AS similarity_score
FROM posts WHERE lower(title) LIKE '%{QUERY}%' OR lower(summary) LIKE '%{QUERY}%'
   OR lower(body_markdown) LIKE '%{QUERY}%'
ORDER BY similarity_score DESC, published_at DESC NULLS FIRST, id LIMIT 5""")
def search_text(spark, sf_dir):
    """Scored text search over posts (UI variant)."""
    return S.search_text(D.posts(spark, sf_dir, with_emb=False), QUERY, limit=5)


@register("topk_score", with_(POSTS) + f"""
SELECT id, title, published_at, {text_score(QUERY_RARE)} AS similarity_score
FROM posts WHERE {text_score(QUERY_RARE)} > 0
ORDER BY similarity_score DESC, published_at DESC NULLS FIRST, id LIMIT 20""")
def topk_score(spark, sf_dir):
    """Score DESC, published_at DESC, limit 20."""
    r = S.search_text(D.posts(spark, sf_dir, with_emb=False), QUERY_RARE, limit=20)
    return r.select("id", "title", "published_at", "similarity_score")


@register("search_api", with_(POSTS) + f"""
SELECT id AS article_id, CAST({text_score(QUERY_RARE)} AS DOUBLE) AS score, title, summary, url
FROM posts WHERE summary IS NOT NULL AND {text_score(QUERY_RARE)} > 0
ORDER BY score DESC, published_at DESC NULLS FIRST, article_id LIMIT 10""")
def search_api(spark, sf_dir):
    """R2: API text search, summary required, response columns."""
    return S.search_api(D.posts(spark, sf_dir, with_emb=False), QUERY_RARE, limit=10)


@register("text_match", with_(POSTS) + f"""
SELECT id, {text_score(QUERY_RARE)} AS score FROM posts
WHERE lower(title) LIKE lower('%{QUERY_RARE}%') OR lower(summary) LIKE lower('%{QUERY_RARE}%')
   OR lower(body_markdown) LIKE lower('%{QUERY_RARE}%')""")
def text_match(spark, sf_dir):
    """Every post matching the case-insensitive substring predicate, with its score."""
    p = D.posts(spark, sf_dir, with_emb=False)
    return (p.select("id", S.text_score(QUERY_RARE).alias("score"))
            .where(F.col("score") > 0))


@register("not_null_gate", with_(POSTS) + """
SELECT id, title FROM posts WHERE summary IS NOT NULL AND emb IS NOT NULL""")
def not_null_gate(spark, sf_dir):
    """Posts that carry both a summary and an embedding."""
    p = D.posts(spark, sf_dir)
    return p.where(F.col("summary").isNotNull() & F.col("emb").isNotNull()).select("id", "title")


@register("stable_random", with_(POSTS) + f"""
SELECT id AS article_id, 1.0 AS score, title, summary, url FROM posts
WHERE summary IS NOT NULL ORDER BY md5(id || '#{SEED}'), id LIMIT 10""")
def stable_random(spark, sf_dir):
    """Random order, stable twin (md5 of id and seed)."""
    return S.recommend_random(D.posts(spark, sf_dir, with_emb=False), limit=10, seed=SEED)


@register("recommend_random", with_(POSTS) + f"""
SELECT id AS article_id, 1.0 AS score, title, summary, url FROM posts
WHERE summary IS NOT NULL ORDER BY md5(id || '#{SEED + 1}'), id LIMIT 5""")
def recommend_random(spark, sf_dir):
    """Random recommendations with score 1.0 (stable seed so it can be checked)."""
    return S.recommend_random(D.posts(spark, sf_dir, with_emb=False), limit=5, seed=SEED + 1)


REQUESTS_SQL = """requests AS (
  SELECT conv_id AS request_id, CASE WHEN conv_id % 97 <> 5 THEN 's' || CAST(conv_id % 100 AS VARCHAR) END AS student_id,
         CASE WHEN conv_id % 10 = 3 THEN NULL
              WHEN regexp_extract(arg_min(text, turn), '([A-Za-z]{7,})', 1) <> ''
              THEN lower(regexp_extract(arg_min(text, turn), '([A-Za-z]{7,})', 1)) END AS query,
         CASE WHEN conv_id % 8 = 5 THEN 5 ELSE CAST(count(*) AS INTEGER) END AS "limit"
  FROM conversations GROUP BY conv_id)"""

RECOMMEND_SQL = with_(POSTS, REQUESTS_SQL, """valid AS (
  SELECT * FROM requests WHERE "limit" BETWEEN 1 AND 20 AND student_id IS NOT NULL)""", """text_hits AS (
  SELECT v.request_id, p.id AS article_id,
         CAST(CASE WHEN lower(p.title) LIKE '%' || v.query || '%' THEN 1.0
                   WHEN lower(p.summary) LIKE '%' || v.query || '%' THEN 0.7
                   WHEN lower(p.body_markdown) LIKE '%' || v.query || '%' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score,
         p.published_at, v."limit"
  FROM valid v JOIN posts p ON p.summary IS NOT NULL AND (
       lower(p.title) LIKE '%' || v.query || '%' OR lower(p.summary) LIKE '%' || v.query || '%'
       OR lower(p.body_markdown) LIKE '%' || v.query || '%')
  WHERE v.query IS NOT NULL)""", """ranked AS (
  SELECT request_id, article_id, score, "limit",
         row_number() OVER (PARTITION BY request_id ORDER BY score DESC, published_at DESC NULLS FIRST, article_id) AS rank
  FROM text_hits)""", f"""rnd AS (
  SELECT id AS article_id, row_number() OVER (ORDER BY md5(id || '#{SEED}'), id) AS rank
  FROM posts WHERE summary IS NOT NULL)""", """hits AS (
  SELECT request_id, rank, article_id, score FROM ranked WHERE rank <= "limit"
  UNION ALL
  SELECT v.request_id, r.rank, r.article_id, 1.0 FROM valid v JOIN rnd r ON r.rank <= v."limit"
  WHERE v.query IS NULL)""") + """
SELECT v.request_id, v.student_id, h.rank, h.article_id, h.score, count(h.article_id) OVER (PARTITION BY v.request_id) AS total_count,
       CASE WHEN v.student_id IS NULL THEN 'no student_id' WHEN "limit" BETWEEN 1 AND 20 THEN 'ok' ELSE 'limit outside 1..20' END AS status
FROM requests v LEFT JOIN hits h ON h.request_id = v.request_id"""


def _flat(out):
    """One row per recommendation; a request without any has one row."""
    each = out.select("request_id", "student_id", "total_count", "status", F.posexplode_outer("recommendations").alias("i", "r"))
    return each.select("request_id", "student_id", (F.col("i") + 1).cast("long").alias("rank"), F.col("r.article_id").alias("article_id"),
                       F.col("r.score").alias("score"), "total_count", "status")


@register("recommend_batch", RECOMMEND_SQL)
def recommend_batch(spark, sf_dir):
    """Batch of requests from conversations; one row per recommendation."""
    out = R.recommend_batch(D.requests(spark, sf_dir), D.posts(spark, sf_dir, with_emb=False), seed=SEED, as_of=D.ts_ntz(D.AS_OF))
    return _flat(out)


def _updated_index(spark, sf_dir):
    """An index built for the posts as they were, then told the posts that are new or changed since."""
    path = scratch_dir(spark, f"search-index-{uuid.uuid4().hex}")
    before, now = D.prior_posts(spark, sf_dir), D.posts(spark, sf_dir, with_emb=False)
    R.build_index(before, path)
    same = before.select("id", F.col("body_markdown").alias("old"))
    R.update_index(path, now.join(same, "id", "left").where(~F.col("old").eqNullSafe(F.col("body_markdown"))).drop("old"))
    return R.read_index(spark, path)


@register("recommend_kept_index", RECOMMEND_SQL)
def recommend_kept_index(spark, sf_dir):
    """R6 over a stored index that was updated with a merge's changed rows."""
    out = R.recommend_batch(D.requests(spark, sf_dir), D.posts(spark, sf_dir, with_emb=False), seed=SEED, as_of=D.ts_ntz(D.AS_OF),
                            index=_updated_index(spark, sf_dir))
    return _flat(out)


@register("index_postings", with_(POSTS, """fields AS (
  SELECT id, published_at, 1.0 AS w, title AS t FROM posts WHERE summary IS NOT NULL
  UNION ALL SELECT id, published_at, 0.7, summary FROM posts WHERE summary IS NOT NULL
  UNION ALL SELECT id, published_at, 0.5, body_markdown FROM posts WHERE summary IS NOT NULL)""", """tokens AS (
  SELECT id, published_at, w, unnest(list_distinct(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'))) AS token FROM fields)""") + """
SELECT token, count(*) AS posts, CAST(sum(score) AS DOUBLE) AS weight, max(published_at) AS latest
FROM (SELECT token, id, max(w) AS score, max(published_at) AS published_at FROM tokens WHERE token <> '' GROUP BY token, id) GROUP BY token""")
def index_postings(spark, sf_dir):
    """The postings of the updated index, by token."""
    return _updated_index(spark, sf_dir).groupBy("token").agg(
        F.count("*").alias("posts"), F.sum(F.col("score").cast("decimal(18,1)")).cast("double").alias("weight"), F.max("published_at").alias("latest"))


_COS = "list_cosine_similarity(CAST(p.emb AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


@register("recommend_similar", with_(POSTS, REQUESTS_SQL, """valid AS (
  SELECT * FROM requests WHERE "limit" BETWEEN 1 AND 20 AND student_id IS NOT NULL)""", f"""near AS (
  SELECT a.query, p.id AS article_id, {_COS} AS score,
         row_number() OVER (PARTITION BY a.query ORDER BY {_COS} DESC, p.id) AS rank
  FROM (SELECT DISTINCT query FROM valid WHERE query IS NOT NULL) a JOIN embeddings e ON e.vec_id = length(a.query)
  JOIN posts p ON p.emb IS NOT NULL AND p.summary IS NOT NULL)""", f"""rnd AS (
  SELECT id AS article_id, row_number() OVER (ORDER BY md5(id || '#{SEED}'), id) AS rank
  FROM posts WHERE summary IS NOT NULL)""", """hits AS (
  SELECT v.request_id, n.rank, n.article_id, n.score FROM valid v JOIN near n ON n.query = v.query AND n.rank <= v."limit"
  UNION ALL
  SELECT v.request_id, r.rank, r.article_id, 1.0 FROM valid v JOIN rnd r ON r.rank <= v."limit" WHERE v.query IS NULL)""") + """
SELECT v.request_id, v.student_id, h.rank, h.article_id, round(h.score, 6) AS score,
       count(h.article_id) OVER (PARTITION BY v.request_id) AS total_count,
       CASE WHEN v.student_id IS NULL THEN 'no student_id' WHEN "limit" BETWEEN 1 AND 20 THEN 'ok' ELSE 'limit outside 1..20' END AS status
FROM requests v LEFT JOIN hits h ON h.request_id = v.request_id""")
def recommend_similar(spark, sf_dir):
    """R6 by vectors: the model is a stand-in that SQL can repeat, the stored vector whose id is the query's length."""
    stored = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("__n"), "embedding")

    def embedder(df, text, out):
        n = F.length(text).cast("long")
        return df.withColumn("__n", n).join(stored, "__n", "left").drop("__n").withColumnRenamed("embedding", out)

    out = R.recommend_similar(D.requests(spark, sf_dir), D.posts(spark, sf_dir), embedder, seed=SEED, as_of=D.ts_ntz(D.AS_OF))
    return _flat(out).withColumn("score", F.round("score", 6))
