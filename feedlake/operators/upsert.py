"""Dedup, latest-per-key and MERGE-equivalent upserts.

Spark has no MERGE INTO on parquet tables, so an upsert is one full outer
equi-join of the target with the deduplicated source, followed by a per-row
choice of the update, keep or insert value of each column, tagged with an
``_action`` column. Scale notes:

* Dedup and latest-per-key are aggregations (``max`` of a struct), not
  windows: Spark pre-aggregates them map-side, so a key that holds a third of
  all rows is reduced within each input partition before the shuffle and no
  task ever holds the whole group.
* After the dedup the join is one-to-one on the key, so there is no join
  skew; rows with a NULL key never match and would all hash to one
  partition, so they join on a per-row hash that cannot match instead, and
  the target is still read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T_
from pyspark.sql import functions as F

ACTION = "_action"
INSERT, UPDATE, MATCHED, KEEP, REJECT = "INSERT", "UPDATE", "MATCHED", "KEEP", "REJECT"


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   nulls_first: bool = True) -> DataFrame:
    """Keep the row with the greatest ``order`` per key (QUALIFY ROW_NUMBER() = 1).

    Order is DESC on ``order`` with NULLs first (the warehouse's DESC default)
    when ``nulls_first``; remaining ties are broken by the rest of the row, so
    the result is deterministic. Implemented as ``max(struct)`` per key.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    rank = []
    for c in order:
        if nulls_first:
            rank.append(F.col(c).isNull().alias(f"__null_{c}"))
        rank.append(F.col(c).alias(f"__ord_{c}"))
    comparable = [c for c in rest if _orderable(df, c)]
    carried = [c for c in rest if c not in comparable]
    parts = rank + [F.col(c) for c in comparable] + [F.col(c) for c in order]
    if not carried:
        agg = df.groupBy(*keys).agg(F.max(F.struct(*parts)).alias("__w"))
    else:
        # maps and variants have no order: their JSON breaks ties, and they ride along as the value of max_by
        text = F.to_json(F.struct(*[F.col(c) for c in carried])).alias("__json")
        value = F.struct(*[F.col(c) for c in [*comparable, *order, *carried]])
        agg = df.groupBy(*keys).agg(F.max_by(value, F.struct(*parts, text)).alias("__w"))
    cols = [F.col(k) for k in keys] + [F.col(f"__w.{c}").alias(c) for c in df.columns if c not in keys]
    return agg.select(*cols).select(*df.columns)


def _has_no_order(t: T_.DataType) -> bool:
    if isinstance(t, T_.StructType):
        return any(_has_no_order(f.dataType) for f in t.fields)
    if isinstance(t, T_.ArrayType):
        return _has_no_order(t.elementType)
    return isinstance(t, (T_.MapType, T_.VariantType))


def _orderable(df: DataFrame, c: str) -> bool:
    return not _has_no_order(df.schema[c].dataType)


def dedup_min_fetch(rows: DataFrame, group_cols: Sequence[str], ts: str = "fetched_at",
                    out: str = "first_fetched_at") -> DataFrame:
    """G1: identical rows collapse to one, keeping the earliest fetch time."""
    return rows.groupBy(*group_cols).agg(F.min(ts).alias(out))


def source_by_key(rows: DataFrame, key: str, first: list[str], latest: list[str],
                  ts: str = "fetched_at", out: str = "first_fetched_at") -> DataFrame:
    """G1 followed by W1 in one aggregation, for a source with repeated keys.

    Per key: the ``first`` columns come from the earliest fetch (the values
    the row got when it was first inserted), the ``latest`` columns from the
    latest fetch (NULL fetch times count as latest), and ``out`` is the
    earliest fetch time. Merging the result equals merging the fetches one by
    one in fetch order, so a batch merge and a stream of micro-batches agree.
    Ties are broken by the row's other values, so the result is deterministic.
    """
    isnull = F.col(ts).isNull()
    lw = F.max(F.struct(isnull.alias("__n"), F.col(ts).alias("__t"), *[F.col(c) for c in latest]))
    ew = F.min(F.struct(isnull.alias("__n"), F.col(ts).alias("__t"), *[F.col(c) for c in first]))
    agg = rows.groupBy(key).agg(lw.alias("__l"), ew.alias("__e"), F.min(ts).alias(out))
    return agg.select(key, *[F.col(f"__e.{c}").alias(c) for c in first],
                      *[F.col(f"__l.{c}").alias(c) for c in latest], out)


def T(c: str) -> Column:
    """Target-side column inside an upsert expression."""
    return F.col(f"__t_{c}")


def S(c: str) -> Column:
    """Source-side column inside an upsert expression."""
    return F.col(f"__s_{c}")


def upsert(target: DataFrame, source: DataFrame, key: str,
           update: dict[str, Column], insert: dict[str, Column],
           when_changed: Column | None = None, source_key: str | None = None,
           null_keys: str = "reject", on_key: bool = False) -> DataFrame:
    """MERGE INTO target USING source ON t.key = s.key as a DataFrame.

    ``update`` maps target columns to their new value for matched rows (other
    columns keep the target value); ``insert`` maps target columns to values
    for unmatched source rows (others are NULL). ``when_changed`` is the extra
    MATCHED condition; a NULL result does not update (three-valued logic, as
    in SQL). Source keys must be unique (use ``latest_per_key`` first).

    ``on_key``: join on the key column itself, so that a target that is already hash-partitioned
    by it (a bucketed table) is not shuffled; NULL keys should then be rare in the target.

    ``null_keys``: ``"reject"`` drops source rows with a NULL key (they can
    never match), ``"insert"`` inserts them on every run as the warehouse does.
    Returns the whole new target with an ``_action`` column:
    INSERT, UPDATE, MATCHED (matched, unchanged) or KEEP (not in the source).
    """
    skey = source_key or key
    t = target.select(*[F.col(c).alias(f"__t_{c}") for c in target.columns]).withColumn("__in_t", F.lit(True))
    s = source.select(*[F.col(c).alias(f"__s_{c}") for c in source.columns]).withColumn("__in_s", F.lit(True))
    if null_keys != "insert":
        s = s.where(S(skey).isNotNull())
    # One join, one pass over the target. A NULL key never matches, but all NULL
    # keys would hash to one reducer; they join on a per-row hash instead, tagged
    # by side so that it cannot match anything (deterministic, so task retries
    # place every row the same way).
    t_key = F.coalesce(T(key).cast("string"),
                       F.concat(F.lit("\u0000t"), F.xxhash64(*[T(c) for c in target.columns if _orderable(target, c)]).cast("string")))
    t = t.withColumn("__k", t_key)
    if on_key:
        joined = t.join(s, T(key) == S(skey), "full_outer")
    elif null_keys != "insert" and isinstance(source.schema[skey].dataType, T_.StringType):
        # no NULL source keys: join on the source key itself, so a source that is
        # already hash-partitioned by its key (the dedup aggregation) is not shuffled again
        joined = t.join(s, F.col("__k") == S(skey), "full_outer")
    else:
        s_key = F.coalesce(S(skey).cast("string"),
                           F.concat(F.lit("\u0000s"), F.xxhash64(*[S(c) for c in source.columns if _orderable(source, c)]).cast("string")))
        joined = t.join(s.withColumn("__k", s_key), "__k", "full_outer")

    in_t = F.coalesce(F.col("__in_t"), F.lit(False))
    in_s = F.coalesce(F.col("__in_s"), F.lit(False))
    matched = in_t & in_s
    changed = F.lit(True) if when_changed is None else F.coalesce(when_changed, F.lit(False))
    is_update = matched & changed
    action = (F.when(is_update, F.lit(UPDATE)).when(matched, F.lit(MATCHED))
              .when(in_t, F.lit(KEEP)).otherwise(F.lit(INSERT)))
    cols = []
    for c in target.columns:
        dtype = target.schema[c].dataType
        upd = update.get(c, T(c))
        ins = insert.get(c, F.lit(None).cast(dtype))
        cols.append(F.when(is_update, upd.cast(dtype)).when(in_t, T(c)).otherwise(ins.cast(dtype)).alias(c))
    return joined.select(*cols, action.alias(ACTION))


def rejected_rows(rows: DataFrame, key: str, ts: str = "fetched_at") -> DataFrame:
    """The source rows that a merge rejects for want of a key, equal ones once (G1), with their number of fetches."""
    cols = [c for c in rows.columns if c != ts]
    return rows.where(F.col(key).isNull()).groupBy(*cols).agg(F.min(ts).alias("first_fetched_at"), F.count("*").alias("fetches"))


def merge_report(merged: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Counts by action and the procedure's message, in one aggregation.

    With the ``rejected`` rows of the source, their number is a column, too; they are not among the rows affected."""
    n = lambda a: F.sum(F.when(F.col(ACTION) == a, 1).otherwise(0)).cast("long")
    actions, more = merged.select(ACTION), []
    if rejected is not None:
        actions = actions.unionByName(rejected.select(F.lit(REJECT).alias(ACTION)))
        more = [n(REJECT).alias("rejected")]
    agg = actions.agg(n(INSERT).alias("inserted"), n(UPDATE).alias("updated"),
                      n(MATCHED).alias("unchanged"), n(KEEP).alias("untouched"), *more)
    return agg.withColumn("message", F.concat(
        F.lit("Merge completed: "), (F.col("inserted") + F.col("updated")).cast("string"),
        F.lit(" rows affected")))


# ------------------------------------------------------------ the three merges


POSTS_BY_URL_SCHEMA = ("id string, title string, url string, published_at timestamp_ntz, body string, "
                       "body_length long, first_fetched_at timestamp_ntz, last_updated_at timestamp_ntz")


def merge_by_url(target: DataFrame, stream_rows: DataFrame, as_of: Column,
                 null_keys: str = "reject") -> DataFrame:
    """M1: upsert of article-view rows into ``core.posts_by_url`` by URL.

    Source: G1, then one row per URL (``source_by_key``): id and published_at
    of the first fetch, title and body of the latest, earliest fetch time.
    Update only when title or body differ (NULL on either side does not
    update): title, body, body_length and last_updated_at; id, published_at
    and first_fetched_at are kept. Insert otherwise, with last_updated_at =
    ``as_of``.
    """
    first, latest = ["article_id", "published_at"], ["title", "body", "body_length"]
    src = source_by_key(stream_rows.where(F.col("url").isNotNull()), "url", first=first, latest=latest)
    if null_keys == "insert":                        # rows without a key are no group: each distinct one is inserted
        src = src.unionByName(dedup_min_fetch(stream_rows.where(F.col("url").isNull()), ["url", *first, *latest]).select(*src.columns))
    return merge_articles(target, src, as_of, null_keys)


def merge_articles(target: DataFrame, src: DataFrame, as_of: Column, null_keys: str = "reject") -> DataFrame:
    """M1 from source rows that are one per URL already (``first_fetched_at`` included)."""
    changed = (T("title") != S("title")) | (T("body") != S("body"))
    update = {"title": S("title"), "body": S("body"), "body_length": S("body_length"),
              "last_updated_at": as_of}
    insert = {"id": S("article_id"), "title": S("title"), "url": S("url"), "published_at": S("published_at"),
              "body": S("body"), "body_length": S("body_length"),
              "first_fetched_at": S("first_fetched_at"), "last_updated_at": as_of}
    return upsert(target, src, "url", update, insert, when_changed=changed, null_keys=null_keys)


BATCH = "_batch"
#: The table as it is stored: files written before the first merge lack the last two columns of a merge.
ARTICLES_TABLE = f"{POSTS_BY_URL_SCHEMA}, {ACTION} string, {BATCH} string, bucket int"


def merge_articles_into(target_path: str, source: DataFrame, as_of: Column, buckets: int = 64,
                        batch: str | None = None, schema=POSTS_BY_URL_SCHEMA, finish: bool = True) -> list[int]:
    """M1 applied in place to a bucketed ``posts_by_url`` table (touched buckets only).

    ``source`` has one row per URL (``source_by_key`` or the change stream); rows without a URL
    are rejected. A table that does not exist yet is made with ``schema``. Every row keeps the
    action of the last merge that touched it (``_action``) and, with ``batch``, its name
    (``_batch``): the same batch merged again changes nothing, its own actions included.
    ``finish=False`` stops after the first of the two writes; the next one to open the table does
    the second. Returns the touched buckets.
    """
    from feedlake.sources.tables import bucketed_merge, stage_merge

    def merge(target, src):
        if target is None:
            target = src.sparkSession.createDataFrame([], schema)
            target = target.withColumns({c: F.lit(None).cast("string") for c in (ACTION, BATCH)})
        merged = merge_articles(target.withColumnRenamed(ACTION, "__was"), src, as_of)
        here = F.lit(batch).cast("string")
        again = (F.col(ACTION) == MATCHED) & F.coalesce(F.col(BATCH) == here, F.lit(False))
        return merged.withColumns({
            ACTION: F.when(again, F.col("__was")).otherwise(F.col(ACTION)),
            BATCH: F.when(F.col(ACTION) == KEEP, F.col(BATCH)).otherwise(here)}).drop("__was")

    run = bucketed_merge if finish else stage_merge
    return run(target_path, source.where(F.col("url").isNotNull()), "url", merge, buckets,
               f"{schema}, {ACTION} string, {BATCH} string, bucket int")


def merge_by_url_into(target_path: str, stream_rows: DataFrame, as_of: Column, buckets: int = 64,
                      schema=POSTS_BY_URL_SCHEMA, batch: str | None = None) -> list[int]:
    """``merge_articles_into`` from article-view rows: G1 and one row per URL first."""
    src = source_by_key(stream_rows.where(F.col("url").isNotNull()), "url", first=["article_id", "published_at"],
                        latest=["title", "body", "body_length"])
    return merge_articles_into(target_path, src, as_of, buckets, batch, schema)


POST_UPDATE_COLS = ["title", "body_markdown", "level", "tags", "summary", "emb", "url", "published_at",
                    "updated_at"]
POST_COLS = ["id", "title", "body_markdown", "level", "tags", "summary", "emb", "url", "published_at",
             "created_at", "updated_at"]


def merge_posts(target: DataFrame, source: DataFrame, null_keys: str = "reject", on_key: bool = False) -> DataFrame:
    """M2/M3: upsert by id into the 11-column posts table.

    Matched rows take the source's nine update columns unconditionally
    (created_at is kept); unmatched source rows are inserted whole. The
    source must already be one row per id (W1).
    """
    update = {c: S(c) for c in POST_UPDATE_COLS}
    insert = {c: S(c) for c in POST_COLS}
    return upsert(target.select(*POST_COLS), source.select(*POST_COLS), "id", update, insert,
                  null_keys=null_keys, on_key=on_key)


def merge_posts_into(source: DataFrame, name: str, partitions: int = 16, buckets: int = 16) -> list[int]:
    """M2/M3 applied in place to a bucketed catalog table ``name`` of posts (``tables.create_bucketed_table``).

    Only touched partitions are read and rewritten, and their rows are not shuffled. The
    source must be one row per id; rows without an id are rejected. Returns the touched partitions.
    """
    from feedlake.sources.tables import merge_into_table
    return merge_into_table(source, name, "id", lambda t, s: merge_posts(t, s, on_key=True).drop(ACTION), partitions, buckets)


def longer_body(posts: DataFrame, fetched: DataFrame, max_length: int = 500,
                limit: int | None = None, key: str = "url") -> DataFrame:
    """M4: for short articles, take the fetched page text when it is longer.

    One join instead of one UPDATE per row. ``limit`` keeps the reference's
    "newest n short articles" selection; None takes every short article. The
    body length is recomputed (the reference left it stale).
    """
    short = posts.where(F.length("body") < max_length)
    if limit is not None:
        short = short.orderBy(F.desc_nulls_first("published_at"), F.asc("id")).limit(limit)
    # one fetched text per key (the longest), so a key fetched twice cannot duplicate a post
    best = fetched.groupBy(key).agg(F.max_by(F.col("text"), F.struct(F.length("text"), F.col("text"))).alias("__new"))
    cand = short.select("id", key).join(best, key)
    better = cand.where(F.length("__new") > 0).select("id", "__new")
    out = posts.join(better, "id", "left")
    replace = F.col("__new").isNotNull() & (F.length("__new") > F.length("body"))
    body = F.when(replace, F.col("__new")).otherwise(F.col("body"))
    return out.select(*[c for c in posts.columns if c not in ("body", "body_length")],
                      body.alias("body"), F.length(body).cast("long").alias("body_length"),
                      replace.alias("replaced"))


# ------------------------------------------------------------ refresh forms


def partial_refresh(old: DataFrame, new: DataFrame, posts: DataFrame,
                    old_key: str = "article_url", post_key: str = "url") -> DataFrame:
    """S13 + J10: delete rows whose key is IN (SELECT key FROM posts), then insert ``new``.

    The IN-subquery is a left semi join, the delete its complement (left anti).
    """
    keys = posts.select(F.col(post_key).alias(old_key)).where(F.col(old_key).isNotNull())
    kept = old.join(keys, old_key, "left_anti")
    return kept.unionByName(new.select(*old.columns))
