"""Parquet tables that are replaced, whole or by touched buckets, without a lost row.

Spark's overwrite removes old files before the new ones are in place, so a driver that dies in
between would leave a table without them. A replacement is therefore written twice: first
beside the table, into ``<path>_pending``, which is complete once Spark's own ``_SUCCESS`` file
is in it; then its files are moved over the table (all of it, or only the buckets it has; a
catalog table's rows are inserted); then the rest goes. Whoever opens the table next finishes a replacement that
was interrupted, or drops a pending copy that is not complete. One writer at a time is assumed,
as ``foreachBatch`` gives.

Two layouts follow a key:

* folders ``bucket=<hash of the key>`` (``bucketed_merge``), for tables known by their path;
* catalog tables partitioned the same way and, within a partition, bucketed by the key
  (``create_bucketed_table``, ``merge_into_table``): the target of a merge then comes out of
  its scan hash-partitioned by the key and is not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"
_WHOLE = "whole"
_CLEARED = "_CLEARED"         # the table's files beside this pending folder are gone, those there now are its own
TASK_BYTES = 64 << 20         # stored bytes of a table that one task of a merge takes
TASK_ROWS = 1 << 16           # and rows of a merge's source


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _pending(path: str, kind: str = "") -> str:
    return f"{path.rstrip('/')}_pending" + (f"/{kind}" if kind else "")


# ------------------------------------------------------------ replacement


def stage(df: DataFrame, path: str, by: str | None = None) -> None:
    """First write of a replacement: the new content, whole or (``by``) the partitions it has."""
    spark = df.sparkSession
    _drop(spark, _pending(path))
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(_pending(path, by or _WHOLE))


def _move(spark: SparkSession, pending: str, path: str) -> None:
    """Put the files of a pending folder in the place of a table's or bucket's; may be cut off anywhere and called again."""
    fs, target = _fs(spark, path)
    if not exists(spark, f"{pending}/{_CLEARED}"):
        fs.delete(target, True)
        fs.mkdirs(target)
        fs.create(_fs(spark, f"{pending}/{_CLEARED}")[1], True).close()
    for f in fs.listStatus(_fs(spark, pending)[1]):
        name = f.getPath().getName()
        if not name.startswith(("_", ".")):
            to = _fs(spark, f"{path}/{name}")[1]
            fs.delete(to, False)                                         # a copy that was cut off
            if not fs.rename(f.getPath(), to):
                raise OSError(f"cannot move {f.getPath().toString()} to {path}")


def recover(spark: SparkSession, path: str, by: str = BUCKET) -> bool:
    """Second step: move the files of a complete pending copy over the table. False if there is none."""
    path = path.rstrip("/")
    for kind in (_WHOLE, by):
        pending = _pending(path, kind)
        if exists(spark, f"{pending}/_SUCCESS"):
            if kind == by:
                fs, p = _fs(spark, pending)
                for f in fs.listStatus(p):
                    if f.isDirectory() and f.getPath().getName().startswith(f"{by}="):
                        _move(spark, f.getPath().toString(), f"{path}/{f.getPath().getName()}")
            else:
                _move(spark, pending, path)
            spark.catalog.refreshByPath(path)
            _drop(spark, _pending(path))
            return True
    _drop(spark, _pending(path))
    return False


def overwrite(df: DataFrame, path: str) -> None:
    """The full refresh (TRUNCATE, then INSERT) of the table at ``path``."""
    stage(df, path)
    recover(df.sparkSession, path)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table, after any interrupted replacement is finished; None if there is none.

    With ``schema`` no file is asked for its columns, and files that lack one have nulls in it."""
    recover(spark, path)
    if not exists(spark, path):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


# ------------------------------------------------------------ folders by bucket


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched_buckets(source: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that the source's keys lie in (a collect of at most ``buckets`` numbers)."""
    return sorted(r[0] for r in source.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect())


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write a table in the ``bucket=<b>`` layout that ``bucketed_merge`` maintains.

    A large bucket is written by several tasks (a rebalance splits it), so none holds all of one."""
    (df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).hint("rebalance", BUCKET)
     .write.mode("overwrite").partitionBy(BUCKET).parquet(path))


def stage_merge(target_path: str, source: DataFrame, key: str, merge: Callable, buckets: int = 64, schema: str | None = None) -> list[int]:
    """First write of ``bucketed_merge``; the second is ``recover``."""
    spark = source.sparkSession
    target = read(spark, target_path, schema)
    touched = touched_buckets(source, key, buckets)
    if touched:
        if target is not None:
            target = target.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        merged = merge(target, source).withColumn(BUCKET, bucket_of(F.col(key), buckets))
        stage(merged.hint("rebalance", BUCKET), target_path, BUCKET)     # one file per bucket, more of a large one
    return touched


def bucketed_merge(target_path: str, source: DataFrame, key: str, merge: Callable, buckets: int = 64, schema: str | None = None) -> list[int]:
    """Merge ``source`` into a table stored as ``bucket=<b>`` folders, rewriting touched buckets only.

    ``merge(target_rows, source_rows) -> rows`` is the upsert (e.g. M1). Only the buckets that
    the source's keys lie in are read (partition pruning), merged and written back, so a merge
    costs the size of the source's buckets, not of the table. Returns the touched buckets.
    """
    touched = stage_merge(target_path, source, key, merge, buckets, schema)
    recover(source.sparkSession, target_path)
    return touched


# ------------------------------------------------------------ bucketed catalog tables


def _located(spark: SparkSession, name: str) -> str:
    return next(r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect() if r["col_name"] == "Location")


def create_bucketed_table(df: DataFrame, name: str, key: str, path: str, partitions: int = 16, buckets: int = 16) -> None:
    """Catalog table ``name`` at ``path`` with the rows of ``df``: partitions by the key's hash, each bucketed by the key."""
    (_by_file(df.withColumn(BUCKET, bucket_of(F.col(key), partitions)), key, buckets)
     .write.mode("overwrite").format("parquet").option("path", path)
     .partitionBy(BUCKET).bucketBy(buckets, key).saveAsTable(name))


def _by_file(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows dealt as the files of a bucketed table; those of a large file go to several tasks, each with a file of its own."""
    return df.withColumn("__file", F.pmod(F.hash(key), F.lit(buckets))).hint("rebalance", BUCKET, "__file").drop("__file")


def recover_table(spark: SparkSession, name: str, key: str, buckets: int = 16) -> bool:
    """Put a complete pending copy over the partitions of ``name`` that it has."""
    pending = _pending(_located(spark, name), BUCKET)
    done = exists(spark, f"{pending}/_SUCCESS")
    if done:
        rows = _by_file(spark.read.parquet(pending).select(*spark.table(name).columns), key, buckets)
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            rows.write.mode("overwrite").insertInto(name)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    _drop(spark, _pending(_located(spark, name)))
    return done


def merged_partitions(source: DataFrame, name: str, key: str, merge: Callable, partitions: int,
                      buckets: int | None = None) -> tuple[list[int], DataFrame]:
    """The touched partitions of ``name`` and their merged rows.

    With ``buckets``, the table's, both sides are shuffled to more tasks than it has buckets once a
    bucket of the table or of the source is more than one task should hold."""
    spark = source.sparkSession
    keyed = source.where(F.col(key).isNotNull()).groupBy(bucket_of(F.col(key), partitions).alias("b")).count().collect()   # at most ``partitions`` rows
    touched = sorted(r["b"] for r in keyed)
    target = spark.table(name).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    if buckets:
        fs, p = _fs(spark, _located(spark, name))
        tasks = max(-(-fs.getContentSummary(p).getLength() // TASK_BYTES), -(-sum(r["count"] for r in keyed) // TASK_ROWS))
        if tasks > buckets:
            target, source = target.repartition(tasks, key), source.repartition(tasks, key)
    return touched, merge(target, source).withColumn(BUCKET, bucket_of(F.col(key), partitions))


def merge_into_table(source: DataFrame, name: str, key: str, merge: Callable, partitions: int = 16, buckets: int = 16) -> list[int]:
    """Merge ``source`` into a table of ``create_bucketed_table``; ``merge`` must join on the key itself.

    The scan of the touched partitions is hash-partitioned by the key, so only the source is
    shuffled, unless a bucket has outgrown what one task should hold (``TASK_BYTES``, ``TASK_ROWS``).
    Returns the touched partitions, the only ones that are rewritten.
    """
    spark = source.sparkSession
    recover_table(spark, name, key, buckets)
    touched, merged = merged_partitions(source, name, key, merge, partitions, buckets)
    if touched:
        stage(merged.hint("rebalance", BUCKET), _located(spark, name), BUCKET)
        recover_table(spark, name, key, buckets)
    return touched
