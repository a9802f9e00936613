"""Registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlake.llm import (decontamination, fill_middle, html_extract, jaccard_join, line_dedup, packing, quality_rules, secret_scan,
                          sharding, ship, suffix_dedup, token_files, url_filter, vector_codes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_quality_rules")
def _op1(spark, sf_dir):
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op2_suffix_dedup")
def _op2(spark, sf_dir):
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


@_query("op3_jaccard_join")
def _op3(spark, sf_dir):
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


@_query("op4_decontamination")
def _op4(spark, sf_dir):
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op5_html_extraction")
def _op5(spark, sf_dir):
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the fetch time follows from the page id, within the year 2024."""
    return pages.select("page_id", "url", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id * 37 % 360 as int), cast(page_id % 24 as int))")
                        .alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries derived from the hosts of ``pages``: hosts are blocked, and some taken off
    the list or allowed again later; their domains and sections have entries of their own."""
    host = F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#:]*)", 1)
    hosts = pages.select(host.alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    day = lambda e: F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast({e} as int))")
    row = lambda df, kind, value, action, at: df.select(F.lit(kind).alias("kind"), F.expr(value).alias("value"), F.lit(action).alias("action"), day(at).alias("listed_at"))
    return (row(hosts.where("n % 2 = 0"), "host", "host", "block", "length(host) * 7 % 180")
            .union(row(hosts.where("n % 4 = 0"), "host", "host", "remove", "length(host) * 7 % 180 + 60"))
            .union(row(hosts.where("n % 3 = 0"), "host", "host", "allow", "length(host) * 7 % 180 + 120"))
            .union(row(hosts.where("n % 5 = 0"), "domain", "substring_index(host, '.', -2)", "block", "length(host) * 11 % 300").distinct())
            .union(row(hosts.where("n % 3 = 1"), "prefix", "concat(host, '/en/')", "allow", "length(host) * 5 % 200"))
            .union(row(hosts.where("n % 3 = 2"), "prefix", "concat(host, '/fr/')", "block", "length(host) * 5 % 200")))


_OP6_SQL = """
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id * 37 % 360 AS INTEGER)) + to_hours(CAST(page_id % 24 AS INTEGER)) AS fetched_at
  FROM pages),
hosts AS (
  SELECT host, count(*) AS n, length(host) AS l FROM (SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages) WHERE host <> '' GROUP BY host),
entries AS (
  SELECT 'host' AS kind, host AS value, 'block' AS action, l * 7 % 180 AS d FROM hosts WHERE n % 2 = 0
  UNION ALL SELECT 'host', host, 'remove', l * 7 % 180 + 60 FROM hosts WHERE n % 4 = 0
  UNION ALL SELECT 'host', host, 'allow', l * 7 % 180 + 120 FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT 'domain', regexp_extract(host, '([^.]*[.][^.]*)$', 1), 'block', l * 11 % 300 FROM hosts WHERE n % 5 = 0
  UNION ALL SELECT 'prefix', host || '/en/', 'allow', l * 5 % 200 FROM hosts WHERE n % 3 = 1
  UNION ALL SELECT 'prefix', host || '/fr/', 'block', l * 5 % 200 FROM hosts WHERE n % 3 = 2),
dated AS (
  SELECT kind, value, min(action) AS action, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d AS INTEGER)) AS valid_from FROM entries GROUP BY kind, value, d),
intervals AS (
  SELECT kind, value, action, valid_from, lead(valid_from) OVER (PARTITION BY kind, value ORDER BY valid_from) AS valid_to FROM dated),
parsed AS (
  SELECT page_id, url, fetched_at, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[a-zA-Z]+://[^/?#:]*(?::[0-9]*)?([^?#]*)', 1) AS path FROM captures),
hits AS (
  SELECT p.page_id, i.kind, i.value, i.action, i.valid_from,
         row_number() OVER (PARTITION BY p.page_id ORDER BY CASE i.kind WHEN 'prefix' THEN 2 WHEN 'host' THEN 1 ELSE 0 END DESC, length(i.value) DESC) AS r
  FROM parsed p JOIN intervals i ON i.action <> 'remove' AND i.valid_from <= p.fetched_at AND (i.valid_to IS NULL OR p.fetched_at < i.valid_to)
   AND ((i.kind = 'host' AND p.host = i.value) OR (i.kind = 'domain' AND (p.host = i.value OR ends_with(p.host, '.' || i.value)))
     OR (i.kind = 'prefix' AND starts_with(p.host || p.path, i.value))))
SELECT c.page_id, c.url, c.fetched_at, coalesce(h.action, 'none') AS verdict, h.kind AS matched_kind, h.value AS matched_value, h.valid_from AS listed_at
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1
"""


@_query("op6_url_filter", _OP6_SQL)
def _op6(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(captures(pages), list_entries(pages))


@_query("op7_token_files")
def _op7(spark, sf_dir):
    return token_files.token_file_round_trip(_table(spark, sf_dir, "documents"))


@_query("op8_secret_scan")
def _op8(spark, sf_dir):
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


@_query("op9_packing")
def _op9(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


_OP10_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS b FROM lines),
totals AS (SELECT coalesce(source, '') AS host, count(*) AS pages FROM documents GROUP BY 1),
frequent AS (
  SELECT host, b FROM (SELECT host, b, count(DISTINCT doc_id) AS n FROM bare WHERE b <> '' GROUP BY host, b) JOIN totals USING (host)
  WHERE n >= 10 AND n >= pages * 0.05),
marked AS (SELECT x.doc_id, x.line, x.i, f.b IS NOT NULL AS gone FROM bare x LEFT JOIN frequent f ON x.host = f.host AND x.b = f.b),
texts AS (
  SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_dropped,
         string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(t.n_lines, 0) AS n_lines, CAST(coalesce(t.n_dropped, 0) AS BIGINT) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id
"""


@_query("op10_line_dedup", _OP10_SQL)
def _op10(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, F.col("source"), counts=True)


def _op11_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds of codebook and assignment as a chain of common table expressions."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT x.vec_id, x.p, arg_min(b.k, (list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.v, b.v)]), b.k)) AS k,
         min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.v, b.v)])) AS d
  FROM parts x JOIN book{i} b ON x.p = b.p GROUP BY x.vec_id, x.p)""")
        if i < rounds:
            steps.append(f"""means{i} AS (
  SELECT p, k, list(m ORDER BY j) AS v FROM (
    SELECT n.p, n.k, t.j, CAST(floor(sum(x.v[t.j]) / count(*)) AS BIGINT) AS m
    FROM near{i} n JOIN parts x ON n.vec_id = x.vec_id AND n.p = x.p CROSS JOIN (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM parts))) AS j) t GROUP BY n.p, n.k, t.j) GROUP BY p, k),
book{i + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN means{i} m ON b.p = m.p AND b.k = m.k)""")
    chain = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, [CAST(floor(1024 * CAST(e[p * (len(e) // 4) + i + 1] AS DOUBLE)) AS BIGINT) for i in range(len(e) // 4)] AS v
  FROM kept, (SELECT unnest(range(4)) AS p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < 256),
book0 AS MATERIALIZED (SELECT p, k, v FROM parts JOIN first USING (vec_id)),
{chain},
coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds})
SELECT c.vec_id, c.code, c.error, s.label_error, (SELECT codebooks_sha256 FROM digest) AS codebooks_sha256
FROM coded c JOIN kept x ON c.vec_id = x.vec_id JOIN sums s ON x.label IS NOT DISTINCT FROM s.label
"""


@_query("op11_vector_codes", _op11_sql())
def _op11(spark, sf_dir):
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


@_query("op12_sharding")
def _op12(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


_OP13_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
         sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
numbers AS (
  SELECT doc_id, text, t, len(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(t) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(t) + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM units),
formed AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain'
                               WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(t[1:least(a, b)], '') AS p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(t[greatest(a, b) + 1:], '') AS s FROM numbers)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM formed
"""


@_query("op13_fill_middle", _OP13_SQL)
def _op13(spark, sf_dir):
    return fill_middle.digests(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))
