"""Steps whose memory or time once grew faster than their input."""

import datetime as dt
import glob
import os

import numpy as np
from pyspark.sql import functions as F

from feedlake.operators import chunks as C
from feedlake.operators import embed as E
from feedlake.operators import recommend as R
from feedlake.operators import search as S
from feedlake.sources import tables
from feedlake.streaming.changes import change_stream

T0 = dt.datetime(2024, 1, 1)


def _files(path):
    return {os.path.basename(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_vector_batch_holds_a_bounded_number_of_scores(monkeypatch):
    """F1: many queries are multiplied in blocks; equal scores go by id."""
    import pandas as pd
    seen, add = [], S._TopK.add
    monkeypatch.setattr(S, "SCORES", 64)
    monkeypatch.setattr(S._TopK, "add", lambda self, rows, ids, scores: (seen.append(scores.size), add(self, rows, ids, scores))[1])
    rng = np.random.default_rng(1)
    names, m = np.array([f"q{i}" for i in range(50)], object), rng.integers(-2, 3, (50, 4)).astype(float)
    ids, x = [f"p{i}" for i in range(30)], rng.integers(-2, 3, (30, 4)).astype(float)
    half = [pd.DataFrame({"id": ids[a::2], "vec": list(x[a::2])}) for a in (0, 1)]
    out = pd.concat(S._batch_topk((names, {4: (np.arange(50), m)}), 3)(iter(half)))
    assert max(seen) <= 64
    with np.errstate(all="ignore"):
        cos = (m @ x.T) / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(x, axis=1))
    cos[~np.isfinite(cos)] = 0.0
    for j, q in enumerate(names):
        got = out[out.query_id == q]
        want = sorted(range(30), key=lambda i: (-round(cos[j, i], 9), ids[i]))[:3]
        assert sorted(np.round(got.score, 9), reverse=True) == [round(cos[j, i], 9) for i in want]


def test_index_is_stored_by_post(spark, tmp_path):
    """one stored row per post; what is read is one row per post and token."""
    posts = spark.createDataFrame([(str(i), f"t{i}", "s common", "b common more", T0) for i in range(20)] + [("x", "t", None, "b", T0)],
                                  "id string, title string, summary string, body_markdown string, published_at timestamp_ntz")
    path = str(tmp_path / "index")
    R.build_index(posts, path, 4)
    assert tables.read(spark, path).count() == 20
    key = ["id", "token", "score", "published_at"]
    assert sorted(R.read_index(spark, path).select(key).collect()) == sorted(R.post_tokens(posts).select(key).collect())
    assert R.read_index(spark, path).count() == 100
    R.update_index(path, posts.where("id = '3'").withColumn("summary", F.lit("other")), 4)
    assert {r.token for r in R.read_index(spark, path).where("id = '3'").collect()} == {"t3", "other", "b", "common", "more"}
    R.update_index(path, posts.where("id = '3'").withColumn("summary", F.lit(None).cast("string")), 4)
    assert R.read_index(spark, path).where("id = '3'").count() == 0 and tables.read(spark, path).count() == 19


def test_replacement_moves_the_staged_files(spark, tmp_path):
    """a table's new files are written once; a move that is cut off anywhere is finished."""
    path = str(tmp_path / "t")
    tables.overwrite(spark.range(3), path)
    tables.stage(spark.range(9).repartition(3), path)
    staged = _files(tables._pending(path))
    assert tables.read(spark, path).count() == 9 and _files(path) == staged and not os.path.exists(tables._pending(path))
    tables.stage(spark.range(11).repartition(3), path)
    pending = tables._pending(path, "whole")
    for f in glob.glob(f"{path}/*.parquet"):                             # cut off after the old files went and one new one came
        os.remove(f)
    open(f"{pending}/_CLEARED", "w").close()
    new = sorted(glob.glob(f"{pending}/*.parquet"))[0]
    os.rename(new, f"{path}/{os.path.basename(new)}")
    assert tables.read(spark, path).count() == 11


def test_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """no task holds all of a bucket."""
    df = spark.range(20000, numPartitions=8).select("id", F.sha2(F.col("id").cast("string"), 512).alias("v"))
    name, path, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(tmp_path / "b"), None
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "100k")
        tables.write_bucketed(df, path, "id", 2)
    finally:
        spark.conf.set(name, before)
    assert all(len(glob.glob(f"{path}/bucket={b}/*.parquet")) > 1 for b in (0, 1))
    assert spark.read.parquet(path).count() == 20000


def test_large_buckets_are_merged_by_more_tasks(spark, tmp_path, monkeypatch):
    """a merge into a bucketed table takes more tasks than buckets once these are large."""
    target = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("v"))
    source = spark.range(3000, 6000).select(F.col("id").cast("string").alias("id"), F.lit("new").alias("v"))
    tables.create_bucketed_table(target, "many_tasks", "id", str(tmp_path / "many"), 2, 2)
    seen = []

    def merge(t, s):
        seen.append((t.rdd.getNumPartitions(), s.rdd.getNumPartitions()))
        return t.join(s.withColumnRenamed("v", "w"), "id", "full_outer").select("id", F.coalesce("w", "v").alias("v"))

    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    assert tables.merge_into_table(source, "many_tasks", "id", merge, 2, 2) == [0, 1]
    assert seen == [(6, 6)]
    got = {int(r.id): r.v for r in spark.table("many_tasks").collect()}
    assert got == {i: "old" if i < 3000 else "new" for i in range(6000)}


def test_chunks_cut_a_text_once(spark):
    """the pieces of a text are not computed again for every chunk."""
    long = "".join(chr(97 + i % 26) for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "")], "id int, t string")
    got = {}
    for r in C.window_chunks(df, "t", 1000, 200, 0).select("id", "chunk_index", "chunk_text").collect():
        got.setdefault(r.id, {})[r.chunk_index] = r.chunk_text
    assert got[2] == {0: "short"} and set(got) == {1, 2}
    assert got[1] == {k: long[k * 800:k * 800 + 1000] for k in range(500)}
    plan = C.window_chunks(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(t") == 1


def test_refresh_reads_one_status(spark):
    """kept vectors and texts to embed come from one status, and kept vectors are shuffled once for the join and the distinct."""
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "x"), ("c", "z"), (None, "n")], "chunk_id string, chunk_text string")
    first = E.refresh_vectors(chunks, spark.createDataFrame([], "embedding_id string, chunk_id string, embedding_vector array<float>, model_name string, created_at timestamp_ntz, text_hash string"),
                              embedder=E.hashing_embedder(4), as_of=F.lit(T0).cast("timestamp_ntz")).localCheckpoint()
    assert sorted(r.chunk_id for r in first.collect()) == ["a", "b", "c"]
    texts = []

    def spy(df, text, out):
        texts.extend(r[0] for r in df.select(text).collect())
        return E.hashing_embedder(4)(df, text, out)

    twice = first.unionByName(first.where("chunk_id = 'a'"))
    again = E.refresh_vectors(chunks.where("chunk_id <> 'c'").replace("y", "zz"), twice, embedder=spy, as_of=F.lit(T0).cast("timestamp_ntz"))
    assert texts == [] and sorted(r.chunk_id for r in again.collect()) == ["a", "b"]
    changed = E.refresh_vectors(chunks.replace("z", "new"), twice, embedder=spy, as_of=F.lit(T0).cast("timestamp_ntz"))
    assert texts == ["new"] and sorted(r.chunk_id for r in changed.collect()) == ["a", "b", "c"]


def test_change_stream_calls_python_by_group(spark, tmp_path):
    """keys of one group share a call and a value of state."""
    raw, out, ckpt = (str(tmp_path / n) for n in ("raw", "out", "ckpt"))
    schema = "k string, fetched_at timestamp_ntz, v string"
    counts = []
    for i in range(3):                                                    # all new; a third changed and as many new; nothing
        n = 900 + 300 * (i > 0)
        rows = [(f"k{j}", T0 + dt.timedelta(hours=i), f"v{j}" + "+" * (i > 0 and j < 300)) for j in range(n)]
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(raw)
        changes = change_stream(spark.readStream.schema(df.schema).parquet(raw), "k", ["v"], groups=4)
        changes.writeStream.option("checkpointLocation", ckpt).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
        counts.append({(r._action, r._is_update): r["count"] for r in spark.read.parquet(out).groupBy("_action", "_is_update").count().collect()})
    assert counts[0] == {("INSERT", False): 900}
    assert counts[1] == counts[2] == {("INSERT", False): 1200, ("UPDATE", True): 300}


def test_token_ids_are_ranked_without_sorting_them(monkeypatch):
    """op7: small ids are counted in a table; the frame is the one that sorting gives."""
    from feedlake.llm import token_files as TF
    rng = np.random.default_rng(3)
    frames = [np.empty(0, np.uint32), np.array([7, 7, 3], np.uint32), rng.zipf(1.3, 50_000).clip(0, 50_000).astype(np.uint32)]
    counted = [TF.encode_ids(f) for f in frames[1:]]
    with monkeypatch.context() as m:
        m.setattr(TF, "COUNTED_IDS", 0)
        for f, a in zip(frames[1:], counted):
            b = TF.encode_ids(f)
            assert all(x.dtype == y.dtype and (x == y).all() for x, y in zip(a, b))
    for f in [*frames, np.array([1 << 31, 5, 1 << 31], np.uint32)]:
        assert (TF.decode_ids(*TF.encode_ids(f), len(f)) == f).all()
    with monkeypatch.context() as m:
        m.setattr(np, "unique", None)
        TF.encode_ids(frames[2])
