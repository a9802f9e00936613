"""Spark session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "feedlake") -> SparkSession:
    """Build (or reuse) a session with UTC time, AQE and Arrow enabled.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the
    submit configuration; the defaults here only matter for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is read from the session and
    never replaced. Only when the setting is absent (local tests) a scratch
    folder is made so ``DataFrame.checkpoint()`` works.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="feedlake-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


_scratch_paths: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder for written intermediate tables, under the checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, name) if "://" not in base else f"{base.rstrip('/')}/{name}"
    _scratch_paths.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders this process made. Call it only once every
    DataFrame that reads them has been consumed. Returns the number removed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _scratch_paths:
        p = jvm.org.apache.hadoop.fs.Path(_scratch_paths.pop())
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            removed += 1
    return removed


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a parquet table under the checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` but computes the plan once (an
    eager reliable checkpoint computes it twice) and stores columnar data on
    the shared folder, so it survives the loss of any executor.
    """
    import uuid
    spark = df.sparkSession
    path = scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


SMALL_INPUT_BYTES = 256 << 20
_sizes: dict[str, int] = {}


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (Hadoop file system, any scheme)."""
    if path not in _sizes:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        _sizes[path] = int(fs.getContentSummary(p).getLength())
    return _sizes[path]


def spread_small(df: DataFrame, path: str) -> DataFrame:
    """Spread a small input over all cores.

    A small table stored as one row group is read by a single task, which then
    does all the per-row text work alone. Below SMALL_INPUT_BYTES a
    round-robin repartition is a cheap shuffle that spreads the work; larger
    inputs span many row groups and files, so the scan already splits them and
    nothing is added.
    """
    spark = df.sparkSession
    size = input_bytes(spark, path)
    if size <= SMALL_INPUT_BYTES:
        # about one partition per MiB of input, never more than there are cores
        n = max(1, min(spark.sparkContext.defaultParallelism, -(-size // (1 << 20))))
        return df.repartition(n)
    return df
