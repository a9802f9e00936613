"""Registered streaming queries (ST1-ST6, S14)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedlake.operators import pipelines as P
from feedlake.operators import upsert as U
from feedlake.plans.oracle import ARTICLE_VIEW, ENTRIES, POSTS, RAW_FEEDS, TARGET_CUTOFF, with_
from feedlake.plans.q_articles import API, API_TYPED, XML_ITEMS
from feedlake.plans.q_merge import (MERGE_BY_URL_SQL, MERGED_BY_URL, MERGED_POSTS, PARTITIONS, POSTS_TABLE_OUT, PRIOR_BASIC,
                                    PRIOR_POSTS, SOURCE_BY_URL, SRC_BASIC, SRC_BY_ID, TARGET_BY_URL, cutoff, posts_table_out,
                                    stream_rows)
from feedlake.plans.registry import register
from feedlake.session import scratch_dir
from feedlake.sources import tables
from feedlake.sources import testdata as D
from feedlake.streaming import merge_stream as MS
from feedlake.streaming.changes import change_stream as change_rows


def _paths(spark):
    base = scratch_dir(spark, f"stream-{uuid.uuid4().hex}")
    return f"{base}/raw", f"{base}/target", f"{base}/_checkpoint"


def _as_of():
    return D.ts_ntz(D.AS_OF)


def _drain(spark, raw_path, target_path, ckpt) -> int:
    q = MS.start_merge_stream(spark, raw_path, target_path, ckpt, as_of=_as_of())
    q.awaitTermination()
    return MS.batches_run(q)


def _run_stream(spark, sf_dir):
    raw_path, target_path, ckpt = _paths(spark)
    # the raw rows fetched since the previous merge are the new files of the stream
    D.raw_json_feeds(spark, sf_dir).where(F.col("fetched_at") > cutoff()).write.mode("overwrite").parquet(raw_path)
    tables.write_bucketed(D.posts_by_url(spark, sf_dir), target_path, "url", MS.BUCKETS)
    return raw_path, target_path, ckpt, _drain(spark, raw_path, target_path, ckpt)


@register("stream_merge", MERGE_BY_URL_SQL)
def stream_merge(spark, sf_dir):
    """ST1-ST5: raw table -> article view -> change stream -> M1 in foreachBatch.

    Equals the batch merge ``merge_by_url``; rows of buckets that no batch touched are kept.
    """
    _, target_path, _, _ = _run_stream(spark, sf_dir)
    t = tables.read(spark, target_path, U.ARTICLES_TABLE).drop(tables.BUCKET, U.BATCH)
    return t.withColumns({"body_md5": F.md5("body"), U.ACTION: F.coalesce(U.ACTION, F.lit(U.KEEP))}).drop("body")


@register("stream_idle", """
SELECT CAST(CASE WHEN (SELECT count(*) FROM documents) > 0 THEN 1 ELSE 0 END AS BIGINT) AS batches_first_run, CAST(0 AS BIGINT) AS batches_second_run""")
def stream_idle(spark, sf_dir):
    """ST6: a second run over no new files fires no batch."""
    raw_path, target_path, ckpt, first = _run_stream(spark, sf_dir)
    return spark.createDataFrame([(first, _drain(spark, raw_path, target_path, ckpt))], "batches_first_run long, batches_second_run long")


def _source(raw):
    """What the change stream passes on for raw rows that it has not seen: one row per url."""
    return U.source_by_key(P.article_rows(raw).where(F.col("url").isNotNull()), "url", first=["article_id", "published_at"],
                           latest=["title", "body", "body_length"])


@register("stream_into_existing", with_(ENTRIES, RAW_FEEDS, ARTICLE_VIEW, TARGET_BY_URL, SOURCE_BY_URL, MERGED_BY_URL) + """
SELECT id, title, url, published_at, md5(body) AS body_md5, body_length, first_fetched_at, last_updated_at FROM merged""")
def stream_into_existing(spark, sf_dir):
    """ST5 + S12: a fresh checkpoint on a filled table, a replayed batch, and a merge that is cut off between its two writes.

    The raw rows come as two batches, in the order of their fetch times; the result is the single merge's.
    """
    raw_path, target_path, ckpt = _paths(spark)
    raw = D.raw_json_feeds(spark, sf_dir).where(F.col("fetched_at") > cutoff())
    later = F.timestamp_add("HOUR", F.lit(-D.TARGET_AGE_HOURS // 2), _as_of())
    tables.write_bucketed(D.posts_by_url(spark, sf_dir), target_path, "url", MS.BUCKETS)
    raw.where(F.col("fetched_at") <= later).write.mode("append").parquet(raw_path)
    _drain(spark, raw_path, target_path, ckpt)
    # the first batch once more, as after a driver lost before the offsets were committed
    first = _source(raw.where(F.col("fetched_at") <= later))
    MS.merge_articles_fn(target_path, _as_of(), stream=ckpt)(first, 0)
    # the second batch stops after its first write, then comes again from the stream
    raw.where(F.col("fetched_at") > later).write.mode("append").parquet(raw_path)
    second = _source(raw.where(F.col("fetched_at") > later))
    MS.merge_articles_fn(target_path, _as_of(), stream=ckpt, finish=False)(second, 1)
    _drain(spark, raw_path, target_path, ckpt)
    t = tables.read(spark, target_path, U.ARTICLES_TABLE).drop(tables.BUCKET, U.BATCH, U.ACTION)
    return t.withColumn("body_md5", F.md5("body")).drop("body")


CHANGES_SQL = with_(ENTRIES) + f"""
SELECT 0 AS batch, doc_id AS n, 'INSERT' AS _action, FALSE AS _is_update, md5(coalesce(replace(body, 'the', 'teh'), '')) AS body_md5
FROM entries WHERE fetched_at <= {TARGET_CUTOFF}
UNION ALL
SELECT 1, doc_id, 'INSERT', FALSE, md5(coalesce(body, '')) FROM entries WHERE fetched_at > {TARGET_CUTOFF}
UNION ALL
SELECT 1, doc_id, 'UPDATE', TRUE, md5(coalesce(body, '')) FROM entries
WHERE fetched_at <= {TARGET_CUTOFF} AND fetched_at > {TARGET_CUTOFF} - INTERVAL 24 HOUR AND replace(body, 'the', 'teh') <> body"""


@register("change_stream", CHANGES_SQL)
def change_stream(spark, sf_dir):
    """ST3: two batches of feeds; in the second one some articles are new, some changed and some as they were.

    The first batch has the older fetches with bodies in their earlier revision, the second one the
    newer fetches; articles are keyed by their id, and equal ones pass nothing on.
    """
    raw_path, out_path, ckpt = _paths(spark)
    old = F.col("fetched_at") <= F.timestamp_add("HOUR", F.lit(-24), cutoff())

    def write(batch, batch_id):                        # one folder per batch: a replay overwrites its own
        (batch.select(F.lit(batch_id).alias("batch"), "article_id", "body", "_action", "_is_update")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path))

    for part in (D.raw_json_feeds(spark, sf_dir, earlier=True).where(old), D.raw_json_feeds(spark, sf_dir).where(~old)):
        part.write.mode("append").parquet(raw_path)
        changes = change_rows(P.article_rows(MS.raw_stream(spark, raw_path)), "article_id", ["title", "body"])
        changes.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(out_path)
    return out.select("batch", F.substring("article_id", 2, 30).cast("long").alias("n"), "_action", "_is_update",
                      F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"))


def _posts_stream(spark, raw, prior, start):
    """A stream of all raw rows into a filled bucketed table; its rows."""
    raw_path, target_path, ckpt = _paths(spark)
    name = f"posts_{uuid.uuid4().hex}"
    raw.write.mode("append").parquet(raw_path)
    tables.create_bucketed_table(prior, name, "id", target_path, PARTITIONS, PARTITIONS)
    start(spark, raw_path, name, ckpt, _as_of(), partitions=PARTITIONS, buckets=PARTITIONS).awaitTermination()
    return posts_table_out(spark.table(name))


@register("stream_posts_api", with_(POSTS, API, API_TYPED, PRIOR_POSTS, SRC_BY_ID, MERGED_POSTS) + POSTS_TABLE_OUT)
def stream_posts_api(spark, sf_dir):
    """ST3 + ST5 + M2: pipeline B as a stream into a bucketed table; equals the batch merge."""
    return _posts_stream(spark, D.raw_api_feeds(spark, sf_dir), D.prior_posts(spark, sf_dir), MS.start_api_stream)


@register("stream_posts_rss", with_(POSTS, XML_ITEMS, PRIOR_BASIC, SRC_BASIC, MERGED_POSTS) + POSTS_TABLE_OUT)
def stream_posts_rss(spark, sf_dir):
    """ST3 + ST5 + M3: pipeline C as a stream into a bucketed table; equals the batch merge."""
    return _posts_stream(spark, D.raw_xml_feeds(spark, sf_dir), D.prior_posts(spark, sf_dir, id_rule="md5url"), MS.start_rss_stream)


@register("batch_snapshot", with_(ENTRIES, RAW_FEEDS, ARTICLE_VIEW) + f"""
SELECT raw_id, article_id, url FROM article_view WHERE fetched_at > {TARGET_CUTOFF}""")
def batch_snapshot(spark, sf_dir):
    """The stream's content materialised once as a temporary table."""
    snap = MS.snapshot(stream_rows(spark, sf_dir), f"processed_stream_records_{uuid.uuid4().hex[:8]}")
    return snap.select("raw_id", "article_id", "url")
