import datetime as dt

from pyspark.sql import functions as F

from feedlake.operators import upsert as U

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 2, 1)
TARGET_SCHEMA = ("id string, title string, url string, published_at timestamp_ntz, body string, "
                 "body_length long, first_fetched_at timestamp_ntz, last_updated_at timestamp_ntz")
ROWS_SCHEMA = ("url string, article_id string, title string, published_at timestamp_ntz, body string, "
               "body_length long, fetched_at timestamp_ntz")


def _target(spark):
    rows = [
        ("t1", "same", "u1", T0, "b1", 2, T0, T0),          # unchanged by source
        ("t2", "old", "u2", T0, "b2", 2, T0, T0),           # title changes
        ("t3", None, "u3", T0, "b3", 2, T0, T0),            # NULL title in target: no update
        ("t4", "keep", "u4", T0, "b4", 2, T0, T0),          # not in source
        ("t5", "nullkey", None, T0, "b5", 2, T0, T0),       # NULL key never matches
    ]
    return spark.createDataFrame(rows, TARGET_SCHEMA)


def _rows(spark):
    d = lambda h: T0 + dt.timedelta(hours=h)
    rows = [
        ("u1", "a1", "same", T0, "b1", 2, d(5)),
        ("u2", "a2", "new", T0, "b2", 2, d(5)),
        ("u3", "a3", "x", T0, "b3", 2, d(5)),
        ("u6", "a6", "first", T0, "v1", 2, d(1)),            # two fetches of a new URL
        ("u6", "a6b", "second", T0, "v2", 2, d(3)),
        (None, "a7", "no url", T0, "b7", 2, d(2)),           # NULL key in source
    ]
    return spark.createDataFrame(rows, ROWS_SCHEMA)


def _by_url(df):
    return {r["url"]: r for r in df.collect()}


def test_merge_by_url_rules(spark):
    m = U.merge_by_url(_target(spark), _rows(spark), F.lit(NOW).cast("timestamp_ntz"))
    got = _by_url(m)
    assert got["u1"]["_action"] == "MATCHED" and got["u1"]["last_updated_at"] == T0
    assert got["u2"]["_action"] == "UPDATE" and got["u2"]["title"] == "new" and got["u2"]["id"] == "t2"
    assert got["u2"]["last_updated_at"] == NOW and got["u2"]["first_fetched_at"] == T0
    assert got["u3"]["_action"] == "MATCHED" and got["u3"]["title"] is None      # NULL != x is not true
    assert got["u4"]["_action"] == "KEEP"
    assert got[None]["id"] == "t5" and got[None]["_action"] == "KEEP"
    u6 = got["u6"]
    assert u6["_action"] == "INSERT" and u6["title"] == "second" and u6["id"] == "a6"   # id of the first fetch
    assert u6["first_fetched_at"] == T0 + dt.timedelta(hours=1)
    assert m.count() == 6                                       # the NULL-key source row is rejected


def test_null_source_keys_can_be_inserted(spark):
    m = U.merge_by_url(_target(spark), _rows(spark), F.lit(NOW).cast("timestamp_ntz"), null_keys="insert")
    assert m.where(F.col("url").isNull()).count() == 2


def test_merge_twice_equals_merge_once(spark):
    now = F.lit(NOW).cast("timestamp_ntz")
    once = U.merge_by_url(_target(spark), _rows(spark), now)
    twice = U.merge_by_url(once.drop("_action"), _rows(spark), now)
    cols = [c for c in once.columns if c != "_action"]
    assert sorted(map(tuple, once.select(cols).collect()), key=str) == \
        sorted(map(tuple, twice.select(cols).collect()), key=str)
    assert twice.where(F.col("_action").isin("INSERT", "UPDATE")).count() == 0


def test_merge_report(spark):
    m = U.merge_by_url(_target(spark), _rows(spark), F.lit(NOW).cast("timestamp_ntz"))
    r = U.merge_report(m).collect()[0]
    assert (r["inserted"], r["updated"], r["unchanged"], r["untouched"]) == (1, 1, 2, 2)
    assert r["message"] == "Merge completed: 2 rows affected"


def test_latest_per_key_nulls_first_and_ties(spark):
    rows = [("k", None, "a"), ("k", T0, "b"), ("j", T0, "x"), ("j", T0, "y"), ("i", T0, "p")]
    df = spark.createDataFrame(rows, "id string, fetched_at timestamp_ntz, v string")
    got = {r["id"]: r["v"] for r in U.latest_per_key(df, ["id"], ["fetched_at"]).collect()}
    assert got == {"k": "a", "j": "y", "i": "p"}


def test_latest_per_key_is_an_aggregate(spark):
    df = spark.createDataFrame([("k", T0, "a")], "id string, fetched_at timestamp_ntz, v string")
    plan = U.latest_per_key(df, ["id"], ["fetched_at"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert any(a in plan for a in ("HashAggregate", "SortAggregate", "ObjectHashAggregate"))


def test_dedup_min_fetch(spark):
    rows = [("a", "t", T0 + dt.timedelta(hours=2)), ("a", "t", T0), ("b", "t", T0)]
    df = spark.createDataFrame(rows, "article_id string, title string, fetched_at timestamp_ntz")
    got = {r["article_id"]: r["first_fetched_at"] for r in U.dedup_min_fetch(df, ["article_id", "title"]).collect()}
    assert got == {"a": T0, "b": T0}


def test_merge_posts_unconditional_update_keeps_created_at(spark):
    cols = ("id string, title string, body_markdown string, level string, tags array<string>, summary string, "
            "emb array<float>, url string, published_at timestamp_ntz, created_at timestamp_ntz, "
            "updated_at timestamp_ntz")
    t = spark.createDataFrame([("1", "a", "b", "free", ["x"], "s", None, "u", T0, T0, T0)], cols)
    s = spark.createDataFrame([("1", "a", "b", "free", ["x"], "s", None, "u", T0, NOW, NOW),
                               ("2", "n", "b", "free", [], "s", [1.0], "u2", T0, NOW, NOW)], cols)
    got = {r["id"]: r for r in U.merge_posts(t, s).collect()}
    assert got["1"]["_action"] == "UPDATE" and got["1"]["created_at"] == T0 and got["1"]["updated_at"] == NOW
    assert got["2"]["_action"] == "INSERT" and got["2"]["created_at"] == NOW


def test_partial_refresh_semi_anti(spark):
    old = spark.createDataFrame([("c1", "u1"), ("c2", "u2"), ("c3", None)], "chunk_id string, article_url string")
    new = spark.createDataFrame([("n1", "u1")], "chunk_id string, article_url string")
    posts = spark.createDataFrame([("u1",), (None,)], "url string")
    got = sorted(r["chunk_id"] for r in U.partial_refresh(old, new, posts).collect())
    assert got == ["c2", "c3", "n1"]


def test_longer_body(spark):
    posts = spark.createDataFrame([("1", "u1", "short", T0), ("2", "u2", "x" * 600, T0), ("3", "u3", "tiny", T0)],
                                  "id string, url string, body string, published_at timestamp_ntz")
    fetched = spark.createDataFrame([("u1", "much longer text"), ("u1", "short one"), ("u2", "y" * 900), ("u3", "")],
                                    "url string, text string")
    got = {r["id"]: (r["body"], r["body_length"], r["replaced"]) for r in U.longer_body(posts, fetched).collect()}
    assert got["1"] == ("much longer text", 16, True)
    assert got["2"][2] is False and got["3"] == ("tiny", 4, False)
    assert U.longer_body(posts, fetched).count() == 3          # a URL fetched twice does not duplicate


def test_merge_reads_target_once(spark, tmp_path):
    path = str(tmp_path / "target")
    _target(spark).write.parquet(path)
    m = U.merge_by_url(spark.read.parquet(path), _rows(spark), F.lit(NOW).cast("timestamp_ntz"))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1        # the source here is an in-memory frame
    assert m.count() == 6


def test_bucketed_merge_rewrites_touched_buckets_only(spark, tmp_path):
    import glob
    import os

    from feedlake.sources import tables
    path = str(tmp_path / "posts")
    base = [(f"t{i}", "old", f"u{i}", T0, "b", 1, T0, T0) for i in range(200)]
    target = spark.createDataFrame(base, TARGET_SCHEMA).withColumn(U.ACTION, F.lit(None).cast("string"))
    tables.write_bucketed(target, path, "url", 16)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    rows = spark.createDataFrame([("u3", "a3", "new", T0, "b", 1, T0 + dt.timedelta(hours=1))], ROWS_SCHEMA)
    touched = U.merge_by_url_into(path, rows, F.lit(NOW).cast("timestamp_ntz"), 16)
    assert len(touched) == 1
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    unchanged = [f for f in before if f in after and after[f] == before[f]]
    changed_dirs = {os.path.dirname(f) for f in set(after) - set(before)}
    assert changed_dirs == {f"{path}/bucket={touched[0]}"}
    assert len(unchanged) == len([f for f in before if f"/bucket={touched[0]}/" not in f])
    t = spark.read.parquet(path)
    assert t.count() == 200 and t.where(F.col("url") == "u3").first()["title"] == "new"


def test_latest_per_key_carries_maps_and_variants(spark):
    df = spark.createDataFrame([("a", 1, "x", {"k": 1}), ("a", 2, "y", {"k": 2}), ("a", 2, "y", {"k": 3}), ("b", 1, "z", None)],
                               "id string, t int, v string, m map<string,int>")
    df = df.withColumns({"j": F.parse_json(F.to_json("m")), "s": F.struct("m")})
    got = {r["id"]: (r["t"], r["v"], r["m"], r["j"] and r["j"].toJson()) for r in U.latest_per_key(df, ["id"], ["t"]).collect()}
    assert got == {"a": (2, "y", {"k": 3}, '{"k":3}'), "b": (1, "z", None, None)}


def test_rows_without_a_key_are_inserted_each(spark):
    target = spark.createDataFrame([], TARGET_SCHEMA)
    rows = spark.createDataFrame([(None, f"a{i}", f"t{i}", T0, "b", 1, T0) for i in range(5)] + [(None, "a0", "t0", T0, "b", 1, T0)], ROWS_SCHEMA)
    now = F.lit(NOW).cast("timestamp_ntz")
    assert U.merge_by_url(target, rows, now).count() == 0
    assert U.merge_by_url(target, rows, now, null_keys="insert").count() == 5      # identical rows are one (G1)


def test_rejected_rows_are_counted(spark):
    rows = _rows(spark).union(_rows(spark).where("url IS NULL"))
    merged = U.merge_by_url(_target(spark), rows, F.lit(NOW).cast("timestamp_ntz"))
    rejected = U.rejected_rows(rows, "url")
    assert [(r.article_id, r.fetches) for r in rejected.collect()] == [("a7", 2)]
    r = U.merge_report(merged, rejected).first()
    assert (r.inserted, r.updated, r.unchanged, r.untouched, r.rejected) == (1, 1, 2, 2, 1)
    assert r.message == "Merge completed: 2 rows affected"
