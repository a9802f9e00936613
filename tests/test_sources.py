import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.sources import feeds as FD

T0 = dt.datetime(2024, 1, 31)


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return p


def test_json_load_keeps_arrays_and_rejects_bad_files(spark, tmp_path):
    land = tmp_path / "landing"
    land.mkdir()
    _write(land, "a.json", '[{"id": "1", "title": "t"}, {"id": "2"}]')
    _write(land, "b.json", '{"broken": ')
    rows, rejects = FD.load_json_feeds(spark, str(land), source_url="https://x/feed",
                                       fetched_at=F.lit(T0).cast("timestamp_ntz"))
    got = rows.select(F.size(F.try_variant_get("raw_data", "$", "array<variant>")).alias("n"), "source_url").collect()
    assert [(r["n"], r["source_url"]) for r in got] == [(2, "https://x/feed")]
    assert [r["file_path"].endswith("b.json") for r in rejects.collect()] == [True]


def test_xml_load_failfast(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    _write(good, "f.xml", "<rss><channel><item><title>a</title></item><item><title>b</title></item></channel></rss>")
    assert [r["n_items"] for r in FD.load_xml_feeds(spark, str(good)).collect()] == [2]
    bad = tmp_path / "bad"
    bad.mkdir()
    _write(bad, "f.xml", "<rss><channel><item><title>a</title></chan")
    loaded = FD.load_xml_feeds(spark, str(bad))
    for read in (loaded, loaded.select("fetched_at"), loaded.select(F.count("*"))):
        with pytest.raises(Exception):
            read.collect()


def test_json_arrays_become_rows(spark, tmp_path):
    d = tmp_path / "arr"
    d.mkdir()
    _write(d, "x.json", '[{"id": "1"}, {"id": "2"}, {"id": "3"}]')
    assert FD.read_json_array(spark, str(d), "id string").count() == 3


def test_html_to_text(spark):
    html = ('<html><head><title>x</title><style>p{}</style></head><body><script>var a="<p>";</script>'
            '<h1>Title &amp; more</h1><p>See <a href="https://e/x">the link</a> and <img src="i.png"> text.</p>'
            '<!-- c --><ul><li>one</li><li>two</li></ul></body></html>')
    got = spark.createDataFrame([(html,)], "h string").select(FD.html_to_text(F.col("h"))).first()[0]
    assert got == "Title & more\nSee [the link](https://e/x) and text.\none\ntwo"


def test_extract_article_order_and_fallback(spark):
    rows = [('<div class="x note-body y"> A <b>b</b> </div><article>z</article>',),
            ("<article><p> first </p><p>second</p></article>",),
            ("<p>nothing</p>",)]
    df = spark.createDataFrame(rows, "h string")
    got = [r[0] for r in df.select(FD.extract_article(F.col("h"), FD.CONTAINERS + [FD.ARTICLE_TAG])).collect()]
    assert got == ["Ab", "firstsecond", ""]


def test_normalise_entries_defaults(spark):
    items = spark.createDataFrame([(None, None, "<p>s</p>", None), ("t", "u", "", T0)],
                                  "title string, url string, description string, published_at timestamp_ntz")
    out = FD.normalise_entries(items, now=F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz"),
                               id_col=F.lit("k")).collect()
    assert (out[0]["title"], out[0]["url"], out[0]["body"], out[0]["published_at"]) == ("", "", "s", "2024-02-01T00:00:00")
    assert out[1]["body"] == "" and out[1]["published_at"] == "2024-01-31T00:00:00"


def test_append_typed_counts(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    df = spark.createDataFrame([(1, "2"), (2, "3")], "id int, n string")
    path = str(tmp_path / "t")
    assert FD.append_typed(df, path, schema) == 2
    assert FD.append_typed(df, path, schema) == 2
    back = spark.read.parquet(path)
    assert back.count() == 4 and dict(back.dtypes) == {"id": "string", "n": "bigint"}


def test_land_one_file_per_feed(spark, tmp_path):
    df = spark.createDataFrame([("f1", "<rss/>"), ("f2", "<rss></rss>")], "feed_id string, xml string")
    out = FD.land(df, str(tmp_path / "landing"), F.col("xml"), by="feed_id", stamp="s1")
    files = spark.read.text(out, wholetext=True).select(F.col("_metadata.file_path")).collect()
    assert len(files) == 2 and out.endswith("/s1")


def test_append_typed_from_pandas(spark, tmp_path):
    import pandas as pd
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("published_at", T.TimestampNTZType())])
    pdf = pd.DataFrame({"id": ["a", "b"], "published_at": ["2024-01-01T10:00:00", None]})
    path = str(tmp_path / "t5")
    assert FD.append_typed(pdf, path, schema, spark) == 2
    got = {r["id"]: r["published_at"] for r in spark.read.parquet(path).collect()}
    assert got == {"a": dt.datetime(2024, 1, 1, 10, 0), "b": None}
