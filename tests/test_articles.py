import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedlake.operators import articles as A

T0 = dt.datetime(2024, 1, 31)


def _raw(spark, docs):
    rows = [(f"r{i}", "src", T0, d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id string, source_url string, fetched_at timestamp_ntz, s string")
    return df.select("id", "source_url", "fetched_at", F.try_parse_json("s").alias("raw_data"))


def test_flatten_edges(spark):
    docs = [None, "{}", "[]", '[null, {"id": "a", "title": "t", "body": "xyz"}]',
            '[{"id": 5, "title": ["wrong"], "published_at": "2024-01-02T03:04:05"}]', "not json"]
    v = A.article_view(_raw(spark, docs)).orderBy("raw_id").collect()
    assert [r["raw_id"] for r in v] == ["r3", "r3", "r4"]       # NULL, {}, [] and bad JSON give no rows
    assert v[1]["article_id"] == "a" and v[1]["body_length"] == 3
    assert v[0]["article_id"] is None                            # the null element: all fields NULL
    assert v[2]["article_id"] == "5" and v[2]["published_at"] == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_array_size(spark):
    raw = _raw(spark, ['[1,2,3]', '{"a":1}', None])
    got = [r[0] for r in raw.select(A.array_size(raw)).orderBy("id").collect()]
    assert got == [3, None, None]


def test_levels_round_like_the_warehouse(spark):
    df = spark.createDataFrame([(0.0, False), (0.6, False), (0.4, True), (None, None), (300.0, True)],
                               "price double, m boolean")
    got = [r[0] for r in df.select(A.access_level(F.col("price"), F.col("m"))).collect()]
    assert got == ["free", "premium", "membership", "free", "premium"]


def test_api_transform(spark):
    doc = ('{"data": {"contents": ['
           '{"key": "k1", "name": "T", "body": "B", "price": 0, "isMembership": true, "hashtag": "#h",'
           ' "user": {"urlname": "alice/x"}, "publishedAt": "2024-01-30T10:00:00", "type": "TextNote"},'
           '{"key": null, "id": null, "name": "N", "publishedAt": "P", "type": "TextNote"},'
           '{"key": "k3", "type": "ImageNote"}]}}')
    raw = spark.createDataFrame([(doc, T0), (doc, T0 - dt.timedelta(hours=30))], "s string, fetched_at timestamp_ntz")
    raw = raw.select(F.parse_json("s").alias("xml"), "fetched_at")
    out = A.parse_api(raw, as_of=F.lit(T0).cast("timestamp_ntz"), strict_dates=False).orderBy("id").collect()
    with pytest.raises(Exception):                       # TO_TIMESTAMP_NTZ('P') is an error
        A.parse_api(raw, as_of=F.lit(T0).cast("timestamp_ntz")).collect()
    assert len(out) == 2                                  # 24 h look-back and TextNote only
    k1 = [r for r in out if r["id"] == "k1"][0]
    assert k1["level"] == "membership" and k1["tags"] == ["#h", "note.com", "alice"]
    assert k1["url"] == "https://note.com/alice/x/n/k1"
    other = [r for r in out if r["id"] != "k1"][0]
    assert other["id"] == __import__("hashlib").md5(b"NP").hexdigest() and other["url"] is None


def _rss(items):
    return '<rss version="2.0"><channel><title>c</title>' + "".join(items) + "</channel></rss>"


def _item(i):
    return (f"<item><title>t{i}</title><link>https://h/{i}</link><description>d &amp; {i}</description>"
            f"<pubDate>Mon, 01 Jan 2024 10:00:{i % 60:02d}</pubDate></item>")


def test_rss_items_limit_and_dates(spark):
    raw = spark.createDataFrame([(_rss([_item(i) for i in range(51)]), T0), (_rss([_item(0)]), T0),
                                 (_rss([]), T0)], "xml string, fetched_at timestamp_ntz")
    out = A.parse_rss(raw)
    assert out.count() == 52                              # no item is dropped by default
    r = out.where(F.col("idx") == 0).orderBy("title").collect()[0]
    assert r["body_markdown"] == "d & 0" and r["id"] == __import__("hashlib").md5(b"https://h/0").hexdigest()
    assert r["published_at"] == dt.datetime(2024, 1, 1, 10, 0, 0)
    assert A.parse_rss(raw, max_items=A.PARITY_ITEMS).count() == 51       # the original view's cut, on request


def test_rss_malformed(spark):
    raw = spark.createDataFrame([("<rss><channel><item><title>x</title></chan", T0)], "xml string, fetched_at timestamp_ntz")
    assert A.parse_rss(raw).count() == 0                  # permissive: no items
    with pytest.raises(Exception):
        A.parse_rss(raw, mode="FAILFAST").collect()


def test_filters_and_projections(spark):
    df = spark.createDataFrame([("t", "  "), (None, "b"), ("t", "body")], "title string, body_markdown string")
    assert A.complete(df).count() == 1
    r = df.select(A.summary_trunc(F.lit("x" * 300)).alias("s"), A.embed_input(F.lit("T"), F.lit(None).cast("string")).alias("e")).first()
    assert r["s"] == "x" * 200 + "..." and r["e"] == "T "


def test_lookback_reaches_the_raw_scan(spark, tmp_path):
    doc = '{"data": {"contents": [{"key": "k", "name": "T", "body": "B", "type": "TextNote"}]}}'
    raw = spark.createDataFrame([(doc, T0), (doc, T0 - dt.timedelta(hours=30))], "s string, fetched_at timestamp_ntz")
    path = str(tmp_path / "raw")
    raw.select(F.parse_json("s").alias("xml"), "fetched_at").write.parquet(path)
    out = A.parse_api(spark.read.parquet(path), as_of=F.lit(T0).cast("timestamp_ntz"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(fetched_at), GreaterThanOrEqual(fetched_at" in plan
    assert out.count() == 1


def test_variant_casts(spark):
    from feedlake.functions.variant import as_bool, as_int, as_str, json_path
    assert json_path("user:urlname") == "$.user.urlname"
    df = spark.createDataFrame([('{"a": {"b": 0.6}, "s": "x", "t": true}',), ('{"a": {"b": -2.5}}',), ('{"a": null}',)],
                               "j string").select(F.parse_json("j").alias("v"))
    got = [(r[0], r[1], r[2]) for r in df.select(as_int(F.col("v"), "a:b"), as_str(F.col("v"), "s"),
                                                  as_bool(F.col("v"), "t")).collect()]
    assert got == [(1, "x", True), (-3, None, None), (None, None, None)]
