"""Registered source and sink queries.

Each query lands data derived from the driver tables in a fresh scratch
folder under the session's checkpoint folder, loads it back with the
operator under test, and returns the loaded rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.operators import articles as A
from feedlake.operators import upsert as U
from feedlake.plans.oracle import ENTRIES, EPOCH, FETCHED, NL, POSTS, RAW_FEEDS, with_
from feedlake.plans.registry import register
from feedlake.session import scratch_dir
from feedlake.sources import feeds as FD
from feedlake.sources import testdata as D

def feed_key():
    return F.regexp_extract(F.col("file_path"), r"feed=([^/]+)", 1)


def _scratch(spark, name):
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- HTML in DuckDB: tokens and windows over them

# entities that occur in the given pages (all others are held by fixtures); & comes last
_SQL_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "''", "nbsp": " ", "copy": "©", "middot": "·", "amp": "&"}
_TOKEN = (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<head\b.*?</head\s*>"
          r"|<[a-z/!?][^<>]*>|[^<]+|<")
_SQL_BLOCKS = ("p div h1 h2 h3 h4 h5 h6 li ul ol article section nav br tr table header footer main body html "
               "blockquote pre").split()


def _sql_unescape(x: str) -> str:
    for name, char in _SQL_ENTITIES.items():
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def html_text_cte(table: str, key: str, col: str) -> str:
    """CTE ``plain`` (key, text): the page as tokens, each written out on its own, links closed by a window."""
    blocks = ", ".join(f"'{b}'" for b in _SQL_BLOCKS)
    return rf"""tok AS (
  SELECT {key} AS k, unnest(toks) AS t, generate_subscripts(toks, 1) AS i
  FROM (SELECT {key}, regexp_extract_all({col}, '{_TOKEN}') AS toks FROM {table})),
named AS (
  SELECT *, lower(regexp_extract(t, '^</?([A-Za-z0-9]+)', 1)) AS tag, t LIKE '</%' AS closes,
         regexp_extract(t, '(?i)^<a\s.*?href="([^"]*)"', 1) AS href FROM tok),
linked AS (
  SELECT *, last_value(nullif(href, '') IGNORE NULLS) OVER (PARTITION BY k ORDER BY i) AS last_href FROM named),
said AS (
  SELECT k, i, CASE WHEN t LIKE '<!--%' OR tag IN ('script', 'style', 'head', 'img') THEN ''
                    WHEN tag = 'a' AND closes THEN '](' || last_href || ')'
                    WHEN href <> '' THEN '[' WHEN tag IN ({blocks}) THEN {NL}
                    WHEN regexp_matches(t, '^<[A-Za-z/!?]') THEN '' ELSE t END AS o FROM linked),
joined AS (SELECT k, {_sql_unescape("string_agg(o, '' ORDER BY i)")} AS x FROM said GROUP BY k),
plain AS (
  SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(x, '[ \x{{a0}}\t\r\f]+', ' ', 'g'),
                                ' ?\n[ \n]*', {NL}, 'g'), '^\n+|\n+$', '', 'g')) AS text FROM joined)"""


def sql_article(x: str) -> str:
    """Text nodes of the page's article, each stripped (the given pages have one article, without class)."""
    nodes = f"regexp_split_to_array(regexp_extract({x}, '(?is)<article>(.*?)</article>', 1), '<[A-Za-z/!?][^<>]*>')"
    return f"coalesce(array_to_string(list_transform({nodes}, lambda n: trim({_sql_unescape('n')}, ' ' || chr(10) || chr(9))), ''), '')"


PAGE_CONTAINERS = FD.CONTAINERS + [FD.ARTICLE_TAG]


@register("html_text", with_(html_text_cte("pages", "page_id", "html")) + """
SELECT k AS page_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS text_length FROM plain""")
def html_text(spark, sf_dir):
    """HTML pages to text, links kept, images dropped."""
    p = D.table(spark, sf_dir, "pages", spread=True)
    out = p.select("page_id", FD.html_to_text(F.col("html")).alias("t"))
    return out.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("text_length"))


ARTICLE_OUT = f"""
SELECT page_id, url, md5({sql_article('html')}) AS text_md5,
       CAST(length({sql_article('html')}) AS BIGINT) AS text_length FROM pages"""


def _article_texts(pages):
    out = pages.select("page_id", "url", FD.extract_article(F.col("html"), PAGE_CONTAINERS).alias("t"))
    return out.select("page_id", "url", F.md5("t").alias("text_md5"), F.length("t").alias("text_length"))


@register("article_extract", ARTICLE_OUT)
def article_extract(spark, sf_dir):
    """Article text of each page (first matching content container, else '')."""
    return _article_texts(D.table(spark, sf_dir, "pages", spread=True))


@register("article_nested", ARTICLE_OUT)
def article_nested(spark, sf_dir):
    """Every page's article put into nested containers (quoted in three ways, after a decoy) comes out whole."""
    return _article_texts(D.container_pages(spark, sf_dir))


@register("longer_body", f"""
WITH pp AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, pg.url, d.text AS body, {sql_article('pg.html')} AS fetched
            FROM documents d LEFT JOIN pages pg ON pg.page_id = d.doc_id),
     dec AS (SELECT id, url, body, coalesce(length(body) < 500 AND length(fetched) > 0
                    AND length(fetched) > length(body), false) AS replaced, fetched FROM pp)
SELECT id, url, md5(CASE WHEN replaced THEN fetched ELSE body END) AS body_md5,
       CAST(length(CASE WHEN replaced THEN fetched ELSE body END) AS BIGINT) AS body_length, replaced
FROM dec""")
def longer_body(spark, sf_dir):
    """M4: short articles take the page's extracted text when it is longer (one join); articles without a page stay."""
    d = D.documents(spark, sf_dir)
    pages = D.table(spark, sf_dir, "pages", spread=True)
    posts = d.join(pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), "url", F.col("text").alias("body"),
        D.published_at(F.col("doc_id")).alias("published_at"))
    fetched = pages.select("url", FD.extract_article(F.col("html"), PAGE_CONTAINERS).alias("text"))
    out = U.longer_body(posts, fetched)
    return out.select("id", "url", F.md5("body").alias("body_md5"), "body_length", F.coalesce("replaced", F.lit(False)).alias("replaced"))


# ---------------------------------------------------------------- landed feeds

def _landed_json(spark, sf_dir):
    raw = D.raw_json_feeds(spark, sf_dir)
    return FD.land(raw, _scratch(spark, "landing-json"), F.to_json("raw_data"), by="id")


@register("raw_json_rows", with_(ENTRIES, RAW_FEEDS) + """
SELECT id AS feed, CAST(json_array_length(raw_data) AS BIGINT) AS article_count FROM raw_feeds""")
def raw_json_rows(spark, sf_dir):
    """Landed JSON feeds loaded one row per file, arrays kept whole."""
    rows, _rejects = FD.load_json_feeds(spark, _landed_json(spark, sf_dir))
    return rows.select(feed_key().alias("feed"), A.array_size(rows).alias("article_count"))


@register("json_elements", with_(ENTRIES) + """
SELECT id, title, url, published_at, md5(body) AS body_md5
FROM (SELECT * FROM entries UNION ALL SELECT * FROM entries)""")
def json_elements(spark, sf_dir):
    """Landed JSON arrays read with the outer array stripped (one row per element)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "url", "published_at", "body")])
    r = FD.read_json_array(spark, _landed_json(spark, sf_dir), schema)
    return r.select("id", "title", "url", "published_at", F.md5("body").alias("body_md5"))


def _xml_escape_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


XML_DOCS = f"""xml_docs AS (
  SELECT '<rss version="2.0"><channel><title>' || source || '</title>' ||
         string_agg('<item><title>' || {_xml_escape_sql(f"split_part(text, {NL}, 1)")} || '</title><link>' ||
                    'https://example.com/' || source || '/n/' || CAST(doc_id AS VARCHAR) ||
                    '</link><description>' || {_xml_escape_sql('text')} || '</description><pubDate>' ||
                    strftime({EPOCH} + to_minutes(CAST(doc_id AS BIGINT)), '%a, %d %b %Y %H:%M:%S') ||
                    '</pubDate></item>', '' ORDER BY doc_id) || '</channel></rss>' AS xml,
         count(*) AS n_items
  FROM documents GROUP BY source, {FETCHED}, doc_id // 12000)"""


def _landed_xml(spark, sf_dir):
    raw = D.raw_xml_feeds(spark, sf_dir).withColumn("key", F.md5("xml"))
    return FD.land(raw, _scratch(spark, "landing-xml"), F.col("xml"), by="key")


@register("raw_xml_rows", with_(XML_DOCS) + """
SELECT md5(xml) AS feed, CAST(n_items AS BIGINT) AS n_items, CAST(length(xml) AS BIGINT) AS xml_length FROM xml_docs""")
def raw_xml_rows(spark, sf_dir):
    """Landed XML feeds loaded one row per file, validated in FAILFAST mode."""
    rows = FD.load_xml_feeds(spark, _landed_xml(spark, sf_dir))
    doc = F.regexp_replace("xml", "\n$", "")   # the text writer ends each landed file with a newline
    return rows.select(feed_key().alias("feed"), "n_items", F.length(doc).alias("xml_length"))


@register("feed_entries", with_(html_text_cte("documents", "doc_id", "text")) + f"""
SELECT md5('https://example.com/' || source || '/n/' || CAST(doc_id AS VARCHAR)) AS id,
       split_part(d.text, {NL}, 1) AS title, 'https://example.com/' || source || '/n/' || CAST(doc_id AS VARCHAR) AS url,
       strftime({EPOCH} + to_minutes(CAST(doc_id AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS published_at,
       md5(coalesce(plain.text, '')) AS body_md5
FROM documents d LEFT JOIN plain ON k = doc_id""")
def feed_entries(spark, sf_dir):
    """S3: landed RSS items normalised to (id, title, url, published_at, body)."""
    raw = FD.load_xml_feeds(spark, _landed_xml(spark, sf_dir), validate=False)
    items = A.parse_rss(raw.withColumn("fetched_at", D.ts_ntz(D.AS_OF)), max_items=None, with_content=True)
    items = items.select(F.col("title"), F.col("url"), F.col("body_markdown").alias("description"), "content",
                         "published_at")
    out = FD.normalise_entries(items, now=D.ts_ntz(D.AS_OF), id_col=F.md5(F.col("url")))
    return out.select("id", "title", "url", "published_at", F.md5("body").alias("body_md5"))


POST_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("published_at", T.TimestampNTZType()),
    T.StructField("body", T.StringType()),
])


@register("append_counts", with_(POSTS) + """
SELECT 1 AS batch, count(*) AS appended, count(*) AS total FROM posts
UNION ALL SELECT 2, count(*), 2 * count(*) FROM posts""")
def append_counts(spark, sf_dir):
    """Typed appends return their row counts; the table grows by each."""
    path = _scratch(spark, "append")
    p = D.posts(spark, sf_dir, with_emb=False).withColumnRenamed("body_markdown", "body")
    rows = []
    for b in (1, 2):
        n = FD.append_typed(p, path, POST_SCHEMA)
        total = spark.read.schema(POST_SCHEMA).parquet(path).count()
        rows.append((b, n, total))
    return spark.createDataFrame(rows, "batch long, appended long, total long")


@register("landed_roundtrip", with_(POSTS) + """
SELECT id, title, url, published_at, md5(body_markdown) AS body_md5 FROM posts""")
def landed_roundtrip(spark, sf_dir):
    """Posts landed as JSON files in a timestamped folder and read back."""
    p = D.posts(spark, sf_dir, with_emb=False)
    value = F.struct("id", "title", "url", "published_at", "body_markdown")
    out = FD.land(p.withColumn("feed", F.substring(F.md5("id"), 1, 2)), _scratch(spark, "landing-posts"),
                  value, by="feed", fmt="json")
    schema = "value struct<id string, title string, url string, published_at timestamp_ntz, body_markdown string>"
    back = spark.read.schema(schema).json(out).select("value.*")
    return back.select("id", "title", "url", "published_at", F.md5("body_markdown").alias("body_md5"))
