"""Independent DuckDB SQL for every registered query (the correctness oracle).

The adapters of ``feedlake.sources.testdata`` are restated here as SQL common
table expressions, and each key is answered the way the reference's SQL
states it (QUALIFY, recursive CTE, MERGE-equivalent joins, LIKE on every
row), not the way the Spark plan computes it.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
HOST = "https://example.com"
NL = "chr(10)"

FETCHED = f"({AS_OF} - to_hours(CAST(doc_id % 48 AS BIGINT)))"
PUBLISHED = f"({EPOCH} + to_minutes(CAST(doc_id AS BIGINT)))"
TARGET_CUTOFF = f"({AS_OF} - INTERVAL 12 HOUR)"
FIRST_LINE = f"split_part(text, {NL}, 1)"
LEVEL = ("CASE WHEN round(CASE WHEN n_chars >= 5000 THEN 300.0 WHEN lang = 'fr' THEN 0.6 ELSE 0.0 END) > 0 "
         "THEN 'premium' WHEN lang = 'de' THEN 'membership' ELSE 'free' END")

POSTS = f"""posts AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, split_part(d.text, {NL}, 1) AS title, d.text AS body_markdown,
         {LEVEL} AS level, ['#' || d.lang, 'example.com', d.source] AS tags,
         left(d.text, 200) || '...' AS summary, e.embedding AS emb,
         '{HOST}/' || d.source || '/n/' || CAST(d.doc_id AS VARCHAR) AS url,
         ({EPOCH} + to_minutes(CAST(d.doc_id AS BIGINT))) AS published_at,
         ({AS_OF} - to_hours(CAST(d.doc_id % 48 AS BIGINT))) AS created_at,
         ({AS_OF} - to_hours(CAST(d.doc_id % 48 AS BIGINT))) AS updated_at
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

ENTRIES = f"""entries AS (
  SELECT doc_id, source, 'e' || CAST(doc_id AS VARCHAR) AS id, {FIRST_LINE} AS title,
         '{HOST}/n/' || md5(text) AS url,
         strftime({PUBLISHED}, '%Y-%m-%dT%H:%M:%S') AS published_at,
         text AS body, {FETCHED} AS fetched_at, doc_id // 12000 AS feed_no
  FROM documents)"""

# the article view P1 over RAW feed rows: raw rows are rebuilt from entries and flattened again
RAW_FEEDS = f"""raw_feeds AS (
  SELECT md5(source || '|' || strftime(fetched_at, '%Y-%m-%d %H:%M:%S') || '|' || CAST(feed_no AS VARCHAR)) AS id,
         '{HOST}/feed/' || source AS source_url, fetched_at,
         to_json(list({{'id': id, 'title': title, 'url': url, 'published_at': published_at, 'body': body}}
                 ORDER BY doc_id)) AS raw_data
  FROM (SELECT * EXCLUDE (fetched_at), unnest([fetched_at, fetched_at - INTERVAL 24 HOUR]) AS fetched_at
        FROM entries)
  GROUP BY source, fetched_at, feed_no)"""

ARTICLE_VIEW = """article_view AS (
  SELECT r.id AS raw_id, r.source_url, r.fetched_at,
         json_extract_string(f.value, '$.id') AS article_id,
         json_extract_string(f.value, '$.title') AS title,
         json_extract_string(f.value, '$.url') AS url,
         TRY_CAST(json_extract_string(f.value, '$.published_at') AS TIMESTAMP) AS published_at,
         json_extract_string(f.value, '$.body') AS body,
         length(json_extract_string(f.value, '$.body')) AS body_length
  FROM raw_feeds r, LATERAL (SELECT unnest(json_extract(r.raw_data, '$[*]')) AS value) f)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def text_score(q: str, title="title", summary="summary", body="body_markdown") -> str:
    return (f"CASE WHEN lower({title}) LIKE lower('%{q}%') THEN 1.0 "
            f"WHEN lower({summary}) LIKE lower('%{q}%') THEN 0.7 "
            f"WHEN lower({body}) LIKE lower('%{q}%') THEN 0.5 ELSE 0.0 END")
