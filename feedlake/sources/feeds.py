"""Landing, loading and HTML sources.

Feeds land as files in a landing folder (one file per fetched feed); loads
read the folder with Spark's file sources, so the work is split by file
across the cluster, and every row keeps its source file path.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions import html as H
from feedlake.functions.html import html_to_text
from feedlake.operators.articles import RSS_SCHEMA

def _file_path():
    return F.col("_metadata.file_path")


# ------------------------------------------------------------ S8 landing


def land(df: DataFrame, landing_dir: str, value: Column, by: str, fmt: str = "text",
         stamp: str | None = None) -> str:
    """Write the fetched feeds under ``landing_dir/<stamp>/feed=<name>/``; returns that folder.

    ``value`` is the file content (a JSON array or an XML document) and ``by``
    the column naming the feed. As text, every row becomes a file of its own
    (a feed fetched twice gives two), wherever the rows lie and without a
    shuffle, so no file ever holds two documents.
    """
    stamp = stamp or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    out = f"{landing_dir.rstrip('/')}/{stamp}"
    rows = df.select(F.col(by).alias("feed"), value.alias("value"))
    if fmt == "text":
        rows.write.mode("errorifexists").option("maxRecordsPerFile", 1).partitionBy("feed").text(out)
    else:
        rows.write.mode("errorifexists").partitionBy("feed").format(fmt).save(out)
    return out


# ------------------------------------------------------------ S1, S2, S5


def load_json_feeds(spark: SparkSession, path: str, source_url: Column | str | None = None,
                    fetched_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One RAW row per landed JSON file, the whole array kept as a variant.

    Files that do not parse go to the rejects frame instead of failing the
    load (the reference's ON_ERROR='CONTINUE'). Returns ``(rows, rejects)``.
    """
    files = spark.read.text(path, wholetext=True).select("value", _file_path().alias("file_path"))
    parsed = files.select("file_path", F.try_parse_json("value").alias("raw_data"), "value")
    src = F.lit(source_url) if isinstance(source_url, str) else (source_url if source_url is not None
                                                                else F.col("file_path"))
    fetched = fetched_at if fetched_at is not None else F.current_timestamp().cast("timestamp_ntz")
    rows = parsed.where(F.col("raw_data").isNotNull()).select(
        F.md5("file_path").alias("id"), src.alias("source_url"), fetched.alias("fetched_at"), "raw_data",
        "file_path")
    rejects = parsed.where(F.col("raw_data").isNull()).select("file_path", F.col("value").alias("content"))
    return rows, rejects


def load_xml_feeds(spark: SparkSession, path: str, fetched_at: Column | None = None,
                   validate: bool = True) -> DataFrame:
    """One RAW row per landed XML file, kept as text.

    With ``validate`` each document is parsed in FAILFAST mode, so a malformed
    file fails the whole load (the reference's COPY aborts on error).
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("xml"), _file_path().alias("file_path"))
    fetched = fetched_at if fetched_at is not None else F.current_timestamp().cast("timestamp_ntz")
    rows = files.select("xml", fetched.alias("fetched_at"), "file_path")
    if validate:
        check = F.from_xml("xml", RSS_SCHEMA, {"rowTag": "rss", "mode": "FAILFAST"})
        n_items = F.size(check["channel"]["item"]).cast("long")
        # true for every row that parses; a filter is never pruned, so count() or a narrow select checks, too
        rows = rows.where(F.coalesce(n_items, F.lit(0)) >= -1).withColumn("n_items", n_items)
    return rows


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON files holding arrays; every array element becomes a row (STRIP_OUTER_ARRAY).

    Compression is picked from the file extension.
    """
    r = spark.read.option("multiLine", "true")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


# ------------------------------------------------------------ S6


def append_typed(df, path: str, schema: T.StructType, spark: SparkSession | None = None) -> int:
    """Cast a frame to the table schema, append it, return the appended row count.

    ``df`` is a Spark DataFrame, or a client-side pandas frame (the reference's
    input), which is converted with the table schema via Arrow. The count is
    taken with ``observe`` on the write itself, so the data is read once.
    """
    from pyspark.sql import Observation
    if not isinstance(df, DataFrame):
        spark = spark or SparkSession.getActiveSession()
        df = spark.createDataFrame(df.astype(object).where(df.notna(), None),
                                   T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    obs = Observation("append")
    typed.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return int(obs.get["rows"])


# ------------------------------------------------------------ S11

# The content containers the reference's page fetcher looks for, in order.
CONTAINERS = [("div", ("note-common-styles__textnote-body",)), ("div", ("p-article__content", "note-body"))]
ARTICLE_TAG = ("article", ())


def extract_article(html: Column, containers: list[tuple] | None = None) -> Column:
    """Text of the first container found, whole and with all that is nested in it, else ''.

    A container is a tag and the classes of which it must have one (any, if none is named). They
    are tried in order; one that is found but empty gives ''. Text nodes are stripped and joined.
    """
    containers = containers if containers is not None else CONTAINERS
    found = []
    for tag, classes in containers:
        text = H.node_text(H.element(html, tag, classes))
        for_any = reduce(or_, [F.contains(html, F.lit(c)) for c in classes]) if classes else None
        found.append(text if for_any is None else F.when(for_any, text))      # most pages need no search
    return F.coalesce(*found, F.lit(""))


# ------------------------------------------------------------ S3


def normalise_entries(items: DataFrame, now: Column | None = None, id_col: Column | None = None) -> DataFrame:
    """S3: feed items to (id, title, url, published_at, body).

    Title and link default to ''; published_at is the item's date (UTC) in ISO form
    or, where it has none that parses, the run time; the body is the summary (description), else the first
    content value, converted from HTML to text. ``id`` is a uuid unless a
    reproducible ``id_col`` is given.
    """
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    summary = F.nullif(F.col("description"), F.lit(""))
    content = F.col("content") if "content" in items.columns else F.lit(None).cast("string")
    body = F.coalesce(summary, content, F.lit(""))
    pub = F.coalesce(F.col("published_at"), now)
    return items.select(
        (id_col if id_col is not None else F.expr("uuid()")).alias("id"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.date_format(pub, "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
        html_to_text(body).alias("body"),
    )
