import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from feedlake.operators import pipelines as P
from feedlake.operators import upsert as U
from feedlake.sources import tables
from feedlake.streaming import merge_stream as MS
from feedlake.streaming.changes import change_stream

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 2, 1)
TARGET_SCHEMA = ("id string, title string, url string, published_at timestamp_ntz, body string, "
                 "body_length long, first_fetched_at timestamp_ntz, last_updated_at timestamp_ntz")


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _raw_batch(spark, hour, entries):
    doc = json.dumps([{"id": i, "title": t, "url": u, "published_at": "2024-01-01T00:00:00", "body": b}
                      for i, t, u, b in entries])
    df = spark.createDataFrame([(f"r{hour}", "src", T0 + dt.timedelta(hours=hour), doc)],
                               "id string, source_url string, fetched_at timestamp_ntz, s string")
    return df.select("id", "source_url", "fetched_at", F.parse_json("s").alias("raw_data"))


def _source(raw):
    return U.source_by_key(P.article_rows(raw), "url", first=["article_id", "published_at"], latest=["title", "body", "body_length"])


def _paths():
    base = tempfile.mkdtemp(prefix="feedlake-stream-")
    return f"{base}/raw", f"{base}/target", f"{base}/ckpt"


def _rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["url"])


def _filled(spark, path, buckets=8):
    target = spark.createDataFrame([("t1", "old", "u1", T0, "b", 1, T0, T0)], TARGET_SCHEMA)
    tables.write_bucketed(target, path, "url", buckets)
    return target


def _table(spark, path):
    return tables.read(spark, path, U.ARTICLES_TABLE).drop(tables.BUCKET, U.BATCH, U.ACTION)


def test_stream_equals_batch_and_idles(spark):
    raw_path, target_path, ckpt = _paths()
    target = _filled(spark, target_path)
    b1 = _raw_batch(spark, 1, [("a1", "new", "u1", "b"), ("a2", "x", "u2", "bb")])
    b2 = _raw_batch(spark, 2, [("a3", "y", "u2", "bbb"), ("a4", "z", "u3", "b")])
    b1.write.mode("append").parquet(raw_path)
    b2.write.mode("append").parquet(raw_path)
    q = MS.start_merge_stream(spark, raw_path, target_path, ckpt, as_of=_now(), max_files=1, buckets=8)
    q.awaitTermination()
    assert MS.batches_run(q) == 2
    batch = U.merge_by_url(target, MS.article_changes(b1.unionByName(b2)), _now()).drop(U.ACTION)
    streamed = _table(spark, target_path)
    assert _rows(streamed) == _rows(batch.select(*streamed.columns))
    q2 = MS.start_merge_stream(spark, raw_path, target_path, ckpt, as_of=_now(), buckets=8)
    q2.awaitTermination()
    assert MS.batches_run(q2) == 0


def test_replayed_batch_changes_nothing_not_even_its_actions(spark):
    _, target_path, _ = _paths()
    _filled(spark, target_path)
    batch = _source(_raw_batch(spark, 1, [("a1", "new", "u1", "b"), ("a2", "x", "u2", "bb")]))
    fn = MS.merge_articles_fn(target_path, as_of=_now(), buckets=8, stream="s")
    fn(batch, 0)
    first = _rows(tables.read(spark, target_path, U.ARTICLES_TABLE))
    assert {r["url"]: r["_action"] for r in first} == {"u1": "UPDATE", "u2": "INSERT"} and {r["_batch"] for r in first} == {"s#0"}
    fn(batch, 0)
    assert _rows(tables.read(spark, target_path, U.ARTICLES_TABLE)) == first
    fn(batch, 1)                                    # the same rows in another batch: merged, equal
    assert {r["_action"] for r in _rows(tables.read(spark, target_path, U.ARTICLES_TABLE))} == {"MATCHED"}


def test_merge_cut_off_between_its_writes_is_finished_by_the_next_reader(spark):
    import shutil
    _, target_path, _ = _paths()
    _filled(spark, target_path)
    batch = _source(_raw_batch(spark, 1, [("a1", "new", "u1", "b"), ("a2", "x", "u2", "bb")]))
    MS.merge_articles_fn(target_path, as_of=_now(), buckets=8, finish=False)(batch, 0)
    for b in tables.touched_buckets(batch, "url", 8):                     # the second write got as far as removing old files
        shutil.rmtree(f"{target_path}/bucket={b}", ignore_errors=True)
    assert [(r["url"], r["title"]) for r in _rows(_table(spark, target_path))] == [("u1", "new"), ("u2", "x")]
    assert not tables.exists(spark, f"{target_path}_pending")


def test_incomplete_pending_copy_is_dropped(spark):
    import os
    _, target_path, _ = _paths()
    _filled(spark, target_path)
    batch = _source(_raw_batch(spark, 1, [("a2", "x", "u2", "bb")]))
    MS.merge_articles_fn(target_path, as_of=_now(), buckets=8, finish=False)(batch, 0)
    os.remove(f"{target_path}_pending/{tables.BUCKET}/_SUCCESS")
    assert [r["url"] for r in _rows(_table(spark, target_path))] == ["u1"]


def test_new_checkpoint_keeps_the_rows_of_the_table(spark):
    _, target_path, _ = _paths()                                          # the table does not exist yet
    for h in (1, 2, 3):                                                   # every run starts at batch 0
        fn = MS.merge_articles_fn(target_path, as_of=_now(), buckets=4, stream=f"run{h}")
        fn(_source(_raw_batch(spark, h, [(f"a{h}", "x", f"u{h}", "b")])), 0)
    assert [r["url"] for r in _rows(_table(spark, target_path))] == ["u1", "u2", "u3"]


def test_full_refresh(spark):
    _, path, _ = _paths()
    assert tables.read(spark, path) is None
    for n in (3, 5, 7):
        tables.overwrite(spark.range(n), path)
        assert tables.read(spark, path).count() == n
    tables.overwrite(spark.range(0), path)
    assert tables.read(spark, path).count() == 0
    tables.stage(spark.range(9), path)                                    # cut off after the first write
    assert tables.read(spark, path).count() == 9


def test_processing_time_trigger(spark):
    raw_path, target_path, ckpt = _paths()
    _raw_batch(spark, 1, [("a1", "t", "u1", "b")]).write.mode("append").parquet(raw_path)
    q = MS.start_merge_stream(spark, raw_path, target_path, ckpt, as_of=_now(), available_now=False, interval="1 second", buckets=4)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert tables.read(spark, target_path, U.ARTICLES_TABLE).count() == 1


def test_change_stream_flags_new_changed_and_equal_rows(spark):
    raw_path, out_path, ckpt = _paths()
    batches = [
        [("a", 1, "x", None), ("a", 2, "y", None), ("b", 1, "x", "t"), (None, 1, "n", None)],     # of a, the latest counts
        [("a", 3, "y", None), ("b", 3, "x", None), ("c", 3, "x", None), (None, 1, "n", None)],     # a equal, b changed to null, c new
        [("b", 4, "x", None), ("c", 4, "z", None), ("c", 5, "x", None)]]                           # c comes back to what it was
    got = []
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), v, w) for k, h, v, w in rows], "k string, fetched_at timestamp_ntz, v string, w string")
        df.coalesce(1).write.mode("append").parquet(raw_path)
        changes = change_stream(spark.readStream.schema(df.schema).parquet(raw_path), "k", ["v", "w"], first=["w"])
        q = changes.writeStream.option("checkpointLocation", ckpt).format("parquet").option("path", out_path).trigger(availableNow=True).start()
        q.awaitTermination()
        now = {(r["k"], r["fetched_at"].hour, r["first_fetched_at"].hour, r["v"], r["_action"], r["_is_update"]) for r in spark.read.parquet(out_path).collect()}
        got.append(now - set().union(*got))
    assert got[0] == {("a", 2, 1, "y", "INSERT", False), ("b", 1, 1, "x", "INSERT", False), (None, 1, 1, "n", "INSERT", False)}
    assert got[1] == {("b", 3, 3, "x", "UPDATE", True), ("c", 3, 3, "x", "INSERT", False)}
    assert got[2] == set()


@pytest.mark.parametrize("null_keys", [False, True])
def test_merge_into_bucketed_table_does_not_shuffle_the_target(spark, tmp_path, null_keys):
    cols = "id string, title string, body_markdown string, level string, tags array<string>, summary string, emb array<float>, url string, published_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
    row = lambda i, t: (i, t, "b", "free", ["x"], "s", None, "u", T0, T0, T0)
    name = f"posts_{'n' if null_keys else 'p'}"
    target = spark.createDataFrame([row(str(i), "old") for i in range(200)], cols)
    tables.create_bucketed_table(target, name, "id", str(tmp_path / name), 4, 4)
    source = spark.createDataFrame([row("3", "new"), row("900", "new")] + ([row(None, "lost")] if null_keys else []), cols)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        touched, merged = tables.merged_partitions(source, name, "id", lambda t, s: U.merge_posts(t, s, on_key=True).drop(U.ACTION), 4)
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan      # the source's
    assert 1 <= len(touched) <= 2
    assert U.merge_posts_into(source, name, 4, 4) == touched
    got = {r["id"]: r["title"] for r in spark.table(name).collect()}
    assert len(got) == 201 and got["3"] == got["900"] == "new" and got["4"] == "old"
    # cut off after the first write, then opened again
    tables.stage(merged, str(tmp_path / name), tables.BUCKET)
    assert tables.recover_table(spark, name, "id", 4) and spark.table(name).count() == 201
    assert not tables.recover_table(spark, name, "id", 4)
