"""Registered vector, join and semantic-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.vectors import cosine, dot
from feedlake.operators import chunks as C
from feedlake.operators import search as S
from feedlake.operators.embed import EMBED_DIM, embed_backlog, hashing_embedder, refresh_vectors, vector_status
from feedlake.plans.oracle import AS_OF, NL, POSTS, with_
from feedlake.plans.registry import register
from feedlake.sources import testdata as D

QUERY_VEC_ID = 0


def query_vector(spark, sf_dir, vec_id: int = QUERY_VEC_ID) -> list[float]:
    """The query vector: one stored embedding, fetched as a literal (one bounded row)."""
    row = (D.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id)
           .select("embedding").head(1))
    return list(row[0][0]) if row else []


QV = f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {QUERY_VEC_ID})"


def _cos_sql(a: str, b: str = QV) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), {b})"


def chunks(spark, sf_dir):
    return C.post_chunks(D.posts(spark, sf_dir, with_emb=False), D.ts_ntz(D.AS_OF))


CHUNKS_SQL = f"""chunks AS (
  WITH RECURSIVE r AS (
    SELECT id AS article_id, url AS article_url, 0 AS chunk_index, substr(t, 1, 1000) AS chunk_text,
           800 AS next_pos, length(t) AS text_length, t
    FROM (SELECT *, title || {NL} || {NL} || body_markdown AS t FROM posts)
    UNION ALL
    SELECT article_id, article_url, chunk_index + 1, substr(t, next_pos + 1, 1000), next_pos + 800, text_length, t
    FROM r WHERE next_pos < text_length)
  SELECT md5(article_id || '#' || CAST(chunk_index AS VARCHAR)) AS chunk_id, article_id, article_url,
         chunk_index, chunk_text, length(chunk_text) AS chunk_length
  FROM r WHERE chunk_text IS NOT NULL AND length(chunk_text) > 50)"""

VECTORS_SQL = f"""vectors AS (
  SELECT 'e' || CAST(vec_id AS VARCHAR) AS embedding_id, md5(CAST(vec_id AS VARCHAR) || '#0') AS chunk_id,
         embedding AS embedding_vector, 'm' || CAST(label AS VARCHAR) AS model_name, {AS_OF} AS created_at
  FROM embeddings)"""


@register("cosine_v1", f"SELECT vec_id, round({_cos_sql('embedding')}, 6) AS cosine FROM embeddings")
def cosine_v1(spark, sf_dir):
    """V1: cosine of every stored vector with the query vector (JS variant: empty -> 0)."""
    e = D.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", cosine("embedding", query_vector(spark, sf_dir)).alias("cosine"))


@register("cosine_v2", f"""SELECT vec_id, CASE WHEN len(embedding) = 0 THEN NULL
  ELSE round({_cos_sql('embedding')}, 6) END AS cosine FROM embeddings""")
def cosine_v2(spark, sf_dir):
    """V2: as V1, an empty array gives NULL."""
    e = D.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", cosine("embedding", query_vector(spark, sf_dir), empty="null").alias("cosine"))


@register("cosine_v3", f"""SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), {QV}) /
  (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) *
   sqrt(list_dot_product({QV}, {QV}))), 6) AS cosine FROM embeddings""")
def cosine_v3(spark, sf_dir):
    """V3: SQL variant (empty -> NULL, zero norm -> division error)."""
    e = D.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", cosine("embedding", query_vector(spark, sf_dir), empty="null",
                                     zero="error").alias("cosine"))


@register("dot_products", f"""SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), {QV}), 6) AS dot
FROM embeddings""")
def dot_products(spark, sf_dir):
    """SUM of element products with the query vector, per stored vector."""
    e = D.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", dot("embedding", query_vector(spark, sf_dir)).alias("dot"))


@register("vector_dims", """SELECT CAST(len(embedding) AS BIGINT) AS vector_size, count(*) AS n
FROM embeddings GROUP BY 1""")
def vector_dims(spark, sf_dir):
    """P20: vector dimension profile."""
    e = D.table(spark, sf_dir, "embeddings")
    return e.groupBy(F.size("embedding").alias("vector_size")).agg(F.count("*").alias("n"))


@register("topk_similarity", f"""SELECT vec_id, round({_cos_sql('embedding')}, 6) AS similarity
FROM embeddings ORDER BY {_cos_sql('embedding')} DESC, vec_id LIMIT 10""")
def topk_similarity(spark, sf_dir):
    """The 10 stored vectors most similar to the query vector."""
    e = D.table(spark, sf_dir, "embeddings")
    s = e.select("vec_id", cosine("embedding", query_vector(spark, sf_dir)).alias("similarity"))
    return s.orderBy(F.desc_nulls_last("similarity"), F.asc("vec_id")).limit(10)


@register("query_vector_cross", with_(POSTS) + f"""
SELECT id, round({_cos_sql('emb')}, 6) AS score FROM posts WHERE emb IS NOT NULL""")
def query_vector_cross(spark, sf_dir):
    """Every post against the one-row query vector (a literal array, no join)."""
    p = D.posts(spark, sf_dir).where(F.col("emb").isNotNull())
    return p.select("id", cosine("emb", query_vector(spark, sf_dir)).alias("score"))


@register("search_vector", with_(POSTS) + f"""
SELECT id AS article_id, round({_cos_sql('emb')}, 6) AS score, title, summary, url
FROM posts WHERE emb IS NOT NULL AND summary IS NOT NULL
ORDER BY {_cos_sql('emb')} DESC, id LIMIT 10""")
def search_vector(spark, sf_dir):
    """Vector search over posts, top 10."""
    return S.search_vector(D.posts(spark, sf_dir), query_vector(spark, sf_dir), limit=10)


SEARCHABLE_SQL = """searchable AS (
  SELECT c.chunk_id, c.article_id, c.chunk_index, c.chunk_text, e.embedding_vector, p.title, p.url, p.published_at
  FROM chunks c JOIN vectors e ON c.chunk_id = e.chunk_id JOIN posts p ON c.article_id = p.id)"""


@register("chunk_emb_post_id", with_(POSTS, CHUNKS_SQL, VECTORS_SQL, SEARCHABLE_SQL) + """
SELECT chunk_id, article_id, CAST(chunk_index AS BIGINT) AS chunk_index, md5(chunk_text) AS chunk_md5,
       CAST(len(embedding_vector) AS BIGINT) AS dims, title, url, published_at FROM searchable""")
def chunk_emb_post_id(spark, sf_dir):
    """SEARCHABLE_ARTICLES (chunk ⋈ embedding ⋈ post by id)."""
    s = S.searchable_articles(chunks(spark, sf_dir), D.chunk_vectors(spark, sf_dir),
                              D.posts(spark, sf_dir, with_emb=False), by="id")
    return s.select("chunk_id", "article_id", "chunk_index", F.md5("chunk_text").alias("chunk_md5"),
                    F.size("embedding_vector").alias("dims"), "title", "url", "published_at")


@register("chunk_emb_post_url", with_(POSTS, CHUNKS_SQL, VECTORS_SQL) + """
SELECT c.chunk_id, c.article_id, c.article_url, CAST(c.chunk_index AS BIGINT) AS chunk_index, p.title,
       p.published_at, e.model_name
FROM chunks c JOIN vectors e ON c.chunk_id = e.chunk_id JOIN posts p ON c.article_url = p.url""")
def chunk_emb_post_url(spark, sf_dir):
    """ARTICLE_SEARCH (join through the article URL, with model_name)."""
    s = S.searchable_articles(chunks(spark, sf_dir), D.chunk_vectors(spark, sf_dir),
                              D.posts(spark, sf_dir, with_emb=False), by="url")
    return s.select("chunk_id", "article_id", "article_url", "chunk_index", "title", "published_at", "model_name")


@register("chunk_emb_left", with_(POSTS, CHUNKS_SQL, VECTORS_SQL) + """
SELECT c.chunk_id, e.embedding_id FROM chunks c LEFT JOIN vectors e ON c.chunk_id = e.chunk_id""")
def chunk_emb_left(spark, sf_dir):
    """Chunk LEFT JOIN embedding."""
    v = D.chunk_vectors(spark, sf_dir).select("chunk_id", "embedding_id")
    return chunks(spark, sf_dir).select("chunk_id").join(v, "chunk_id", "left")


@register("coverage", with_(POSTS, CHUNKS_SQL, VECTORS_SQL) + """
SELECT count(DISTINCT c.chunk_id) AS total_chunks, count(DISTINCT e.chunk_id) AS chunks_with_embeddings,
       count(*) AS total_embeddings
FROM chunks c LEFT JOIN vectors e ON c.chunk_id = e.chunk_id""")
def coverage(spark, sf_dir):
    """Distinct chunks, distinct chunks with embeddings, joined rows."""
    v = D.chunk_vectors(spark, sf_dir).select(F.col("chunk_id").alias("e_chunk_id"))
    j = chunks(spark, sf_dir).select("chunk_id").join(v, F.col("chunk_id") == F.col("e_chunk_id"), "left")
    return j.agg(F.countDistinct("chunk_id").alias("total_chunks"),
                 F.countDistinct("e_chunk_id").alias("chunks_with_embeddings"),
                 F.count("*").alias("total_embeddings"))


@register("embed_backlog", with_(POSTS, CHUNKS_SQL, VECTORS_SQL) + f"""
SELECT c.chunk_id, 'text-embedding-3-small' AS model_name, CAST({EMBED_DIM} AS BIGINT) AS dims
FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM vectors e WHERE e.chunk_id = c.chunk_id)""")
def embed_backlog_q(spark, sf_dir):
    """J12 + E2: chunks without a vector, embedded and ready to append."""
    rows = embed_backlog(chunks(spark, sf_dir), D.chunk_vectors(spark, sf_dir), as_of=D.ts_ntz(D.AS_OF))
    return rows.select("chunk_id", "model_name", F.size("embedding_vector").alias("dims"))


OLD_CHUNKS = CHUNKS_SQL.replace("chunks AS (", "old_chunks AS (").replace("FROM posts)", "FROM prior)")
PRIOR = f"""prior AS (
  SELECT * REPLACE (replace(body_markdown, 'the', 'teh') AS body_markdown) FROM posts
  WHERE updated_at <= {AS_OF} - INTERVAL 12 HOUR)"""


@register("embed_refresh", with_(POSTS, PRIOR, CHUNKS_SQL, OLD_CHUNKS) + f"""
SELECT coalesce(c.chunk_id, o.chunk_id) AS chunk_id,
       CASE WHEN c.chunk_id IS NULL THEN 'gone' WHEN o.chunk_id IS NULL THEN 'new'
            WHEN c.chunk_text = o.chunk_text THEN 'kept' ELSE 'replaced' END AS status,
       CASE WHEN c.chunk_id IS NOT NULL THEN 'kept' END AS status_after, md5(c.chunk_text) AS text_hash,
       CASE WHEN c.chunk_id IS NOT NULL THEN CAST({EMBED_DIM} AS BIGINT) END AS dims
FROM chunks c FULL JOIN old_chunks o ON c.chunk_id = o.chunk_id""")
def embed_refresh(spark, sf_dir):
    """Vectors of the table's earlier texts refreshed by content and written; what each id became, then and on a second run."""
    import uuid
    from feedlake.session import materialize, scratch_dir
    from feedlake.sources import tables
    as_of = D.ts_ntz(D.AS_OF)
    now = materialize(chunks(spark, sf_dir), "chunks")
    old = materialize(C.post_chunks(D.prior_posts(spark, sf_dir), as_of), "chunks-before")
    path = scratch_dir(spark, f"vectors-{uuid.uuid4().hex}")
    none = old.limit(0).select(F.lit("").alias("embedding_id"), "chunk_id",
                               F.array(F.lit(0.0).cast("float")).alias("embedding_vector"),
                               F.lit("").alias("model_name"), "created_at", F.lit("").alias("text_hash"))
    tables.overwrite(refresh_vectors(old, none, as_of=as_of), path)
    before = vector_status(now, tables.read(spark, path)).select("chunk_id", "status")
    before = materialize(before, "vector-status")
    tables.overwrite(refresh_vectors(now, tables.read(spark, path), as_of=as_of), path)
    vectors = tables.read(spark, path)
    after = vector_status(now, vectors).select("chunk_id", F.col("status").alias("status_after"))
    dims = vectors.select("chunk_id", "text_hash", F.size("embedding_vector").cast("long").alias("dims"))
    return before.join(after, "chunk_id", "left").join(dims, "chunk_id", "left")


@register("embed_default", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN text IS NOT NULL THEN CAST({EMBED_DIM} AS BIGINT) END AS dims
FROM documents""")
def embed_default(spark, sf_dir):
    """E1 default embedder over every post (the length of each vector: values are model-specific)."""
    p = D.posts(spark, sf_dir, with_emb=False).select("id", "title", "body_markdown")
    from feedlake.operators.articles import embed_input
    p = p.withColumn("t", embed_input(F.col("title"), F.col("body_markdown")))
    out = hashing_embedder()(p, "t", "emb")
    return out.select("id", F.size("emb").alias("dims"))


@register("search_chunks", with_(POSTS, CHUNKS_SQL, VECTORS_SQL, SEARCHABLE_SQL) + f"""
SELECT chunk_id, article_id, CAST(chunk_index AS BIGINT) AS chunk_index, title, url,
       round({_cos_sql('embedding_vector')}, 6) AS similarity
FROM searchable ORDER BY {_cos_sql('embedding_vector')} DESC, chunk_id LIMIT 10""")
def search_chunks(spark, sf_dir):
    """Chunk-level semantic search, top 10."""
    s = S.searchable_articles(chunks(spark, sf_dir), D.chunk_vectors(spark, sf_dir),
                              D.posts(spark, sf_dir, with_emb=False), by="id")
    return S.search_chunks(s, query_vector(spark, sf_dir), limit=10)


@register("search_vector_batch", with_(POSTS, """q AS (
  SELECT CAST(label AS VARCHAR) AS query_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label)""") + f"""
SELECT q.query_id, p.id AS article_id, round({_cos_sql('p.emb', 'CAST(q.qv AS DOUBLE[])')}, 6) AS score,
       CAST(row_number() OVER (PARTITION BY q.query_id
            ORDER BY {_cos_sql('p.emb', 'CAST(q.qv AS DOUBLE[])')} DESC, p.id) AS BIGINT) AS rank
FROM posts p, q WHERE p.emb IS NOT NULL AND p.summary IS NOT NULL
QUALIFY rank <= 5""")
def search_vector_batch(spark, sf_dir):
    """R3 batch: one query vector per label (its first stored vector), top 5 posts each."""
    e = D.table(spark, sf_dir, "embeddings")
    queries = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_vector")).select(
        F.col("label").alias("query_id"), "query_vector")
    out = S.search_vector_batch(D.posts(spark, sf_dir), queries, limit=5)
    return out.select("query_id", F.col("id").alias("article_id"), "score", "rank")
