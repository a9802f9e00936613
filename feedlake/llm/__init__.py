"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Bytes of rows that are handed to a Python worker at once, unless the session says otherwise
#: (Spark's default of 64 MiB is held by the JVM and by the worker of every running task).
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application (as ``--py-files`` would).

    The archive is made on the driver; Spark's own file server hands it to the executors."""
    context = spark.sparkContext
    if spark.conf.get(BATCH[0]) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(*BATCH)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="feedlake-")) / "feedlake_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
