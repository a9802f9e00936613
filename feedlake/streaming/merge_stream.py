"""The change stream and the recurring merge (ST1-ST6, S14).

A raw table is a folder of parquet files that only grows. A Structured Streaming file source
over it is the append-only stream: the checkpoint records which files were consumed, so each
run sees only new rows. The rows go through the same transforms as in a batch
(``feedlake.operators.pipelines``) and the keyed change stream (``feedlake.streaming.changes``);
``foreachBatch`` merges what is new or changed into the target, rewriting touched buckets only.

Exactly once: offsets are committed after the merge. A batch that is replayed finds its name
in the rows it has merged and changes nothing; a merge that was cut off between its two writes
is finished by the next one (``feedlake.sources.tables``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feedlake.operators import pipelines as P
from feedlake.operators import upsert as U
from feedlake.streaming.changes import change_stream

RAW_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("raw_data", T.VariantType()),
])
API_SCHEMA = T.StructType([T.StructField("xml", T.VariantType()), T.StructField("fetched_at", T.TimestampNTZType())])
RSS_SCHEMA = T.StructType([T.StructField("xml", T.StringType()), T.StructField("fetched_at", T.TimestampNTZType())])
MERGE_INTERVAL = "5 minutes"   # fixed value: the reference's task schedule
BUCKETS = 64


def raw_stream(spark: SparkSession, raw_path: str, schema: T.StructType = RAW_SCHEMA,
               max_files: int | None = None) -> DataFrame:
    """ST2: append-only stream over the raw table's files."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(raw_path)


def article_changes(raw: DataFrame) -> DataFrame:
    """ST1: the article view over the append-only stream, with the metadata columns of such a stream.

    The flatten is the batch one and stateless; every row is an INSERT and none an update.
    ``article_change_stream`` tells changed articles from new ones.
    """
    return P.article_rows(raw).withColumns({"_action": F.lit("INSERT"), "_is_update": F.lit(False)})


def inserts_only(changes: DataFrame) -> DataFrame:
    """ST4: METADATA$ACTION = 'INSERT'."""
    return changes.where(F.col("_action") == "INSERT")


def article_change_stream(raw: DataFrame) -> DataFrame:
    """ST3, pipeline A: new and changed articles, keyed by url; id and date are those of the first fetch."""
    return change_stream(P.article_rows(raw), "url", P.ARTICLE_VALUES, first=["article_id", "published_at"])


def api_change_stream(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """ST3, pipeline B: new and changed API items, keyed by id."""
    return change_stream(P.api_rows(raw, as_of), "id", P.API_VALUES)


def rss_change_stream(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """ST3, pipeline C: new and changed RSS items, keyed by id."""
    return change_stream(P.rss_rows(raw, as_of), "id", P.RSS_VALUES)


def snapshot(df: DataFrame, name: str = "processed_stream_records") -> DataFrame:
    """Materialise a micro-batch once (persist) and expose it as a temp view."""
    df = df.persist()
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def _now(as_of: Column | None) -> Column:
    return as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz")


def merge_articles_fn(target_path: str, as_of: Column | None = None, buckets: int = BUCKETS, stream: str = "",
                      on_merged: Callable[[list[int], int], None] | None = None, finish: bool = True):
    """ST5: the ``foreachBatch`` body of pipeline A: merge one micro-batch of changes by URL.

    ``stream`` names the stream (its checkpoint), so that batch 0 of another one is not taken
    for a replay. A missing table starts empty.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = snapshot(batch)
        try:
            touched = U.merge_articles_into(target_path, rows, _now(as_of), buckets, f"{stream}#{batch_id}", finish=finish)
        finally:
            rows.unpersist()
        if on_merged is not None:
            on_merged(touched, batch_id)
    return run


def merge_posts_fn(table: str, posts: Callable[[DataFrame, Column], DataFrame], as_of: Column | None = None,
                   partitions: int = 16, buckets: int = 16):
    """ST5 of pipelines B and C: changes are made posts (enriched) and merged by id into a bucketed catalog table."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = snapshot(batch)
        try:
            U.merge_posts_into(posts(rows, _now(as_of)), table, partitions, buckets)
        finally:
            rows.unpersist()
    return run


def _start(changes: DataFrame, fn: Callable, checkpoint: str, available_now: bool, interval: str) -> StreamingQuery:
    """ST6: ``available_now`` drains what is there and stops (a scheduled run); otherwise the merge
    fires every ``interval``, and an interval with no new files runs no batch (SYSTEM$STREAM_HAS_DATA)."""
    w = changes.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def start_merge_stream(spark: SparkSession, raw_path: str, target_path: str, checkpoint: str,
                       as_of: Column | None = None, available_now: bool = True,
                       interval: str = MERGE_INTERVAL, max_files: int | None = None,
                       buckets: int = BUCKETS) -> StreamingQuery:
    """ST5 + ST6, pipeline A: stream the raw table into the bucketed target by URL."""
    changes = article_change_stream(raw_stream(spark, raw_path, max_files=max_files))
    return _start(changes, merge_articles_fn(target_path, as_of, buckets, checkpoint), checkpoint, available_now, interval)


def start_api_stream(spark: SparkSession, raw_path: str, table: str, checkpoint: str, as_of: Column | None = None,
                     embedder=None, summarizer: Callable | None = None, available_now: bool = True,
                     interval: str = MERGE_INTERVAL, partitions: int = 16, buckets: int = 16) -> StreamingQuery:
    """ST5 + ST6, pipeline B: only new and changed items reach the models and the merge by id."""
    changes = api_change_stream(raw_stream(spark, raw_path, API_SCHEMA), as_of)
    fn = merge_posts_fn(table, lambda rows, now: P.api_posts(rows, now, embedder, summarizer), as_of, partitions, buckets)
    return _start(changes, fn, checkpoint, available_now, interval)


def start_rss_stream(spark: SparkSession, raw_path: str, table: str, checkpoint: str, as_of: Column | None = None,
                     available_now: bool = True, interval: str = MERGE_INTERVAL,
                     partitions: int = 16, buckets: int = 16) -> StreamingQuery:
    """ST5 + ST6, pipeline C."""
    changes = rss_change_stream(raw_stream(spark, raw_path, RSS_SCHEMA), as_of)
    return _start(changes, merge_posts_fn(table, P.rss_posts, as_of, partitions, buckets), checkpoint, available_now, interval)


def batches_run(q: StreamingQuery) -> int:
    """Number of micro-batches a finished query ran (0 when the stream had no data)."""
    return sum(1 for p in q.recentProgress if p.get("numInputRows", 0) > 0)
