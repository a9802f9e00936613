"""HTML and date expressions against hand-written expectations (no shared patterns)."""

import datetime as dt
import time

from pyspark.sql import functions as F

from feedlake.functions import html as H
from feedlake.functions.dates import iso_utc, rss_utc
from feedlake.operators import articles as A
from feedlake.operators import embed as E
from feedlake.operators import profile as PR
from feedlake.sources import feeds as FD

T0 = dt.datetime(2024, 1, 31)


def _apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_references_are_decoded_once(spark):
    got = _apply(spark, H.decode_references, [
        "&#12354;&hellip;&copy; &eacute; &nbsp;|", "&amp;lt; &lt;b&gt;", "&#x1F600; &#X41;", "&#150;&#0;&#xD800;&#9999999;",
        "&unknown; a & b &", "", None, "&notin;&apos;&#39;", "&" * 2000])
    assert got == ["あ…© é \u00a0|", "&lt; <b>", "😀 A", "–���", "&unknown; a & b &", "", None, "∉''", "&" * 2000]


def test_links_however_quoted(spark):
    got = _apply(spark, H.html_to_text, [
        "<a class=x href='u1'>one</a> <A HREF=u2>two</A> <a href=\"u3\" rel=r>three</a> <a name=n>four</a>",
        "<p>1 < 2 &lt; 3</p><p>&#12354;&nbsp; b</p>", "<a href='u'>open <b>end", "", None])
    assert got == ["[one](u1) [two](u2) [three](u3) four", "1 < 2 < 3\nあ b", "open end", "", None]


def test_whole_containers(spark):
    pages = [
        '<div class="note-body"><div>a</div><p>b<div> c <div>d</div></div></p></div><div>after</div>',
        '<div class="note-body-x">no</div><div class=\'y note-body\'>yes</div>',
        '<div class="note-body">first</div><div class="note-common-styles__textnote-body">wins</div>',
        '<DIV CLASS=note-body>open <div>x</div> <script>"</div>"</script>end',
        '<div class="note-body"> </div><article>not asked, a found one is empty</article>',
        '<div class="note-body"><!-- </div> -->kept &amp; &lt;b&gt;</div>',
        "<divider class=note-body>no</divider><article>  <p> x </p><article>y</article>z</article>w",
        "", None]
    got = _apply(spark, lambda c: FD.extract_article(c, FD.CONTAINERS + [FD.ARTICLE_TAG]), pages)
    assert got == ["abcd", "yes", "wins", "openxend", "", "kept & <b>", "xyz", "", ""]


def test_hostile_pages_end_soon(spark):
    pages = ["<div class=note-body>" * 20000, "<a " * 200000, "<a href='" + "x" * 500000, "&" * 500000,
             "<div class=note-body>" + " " * 500000 + "x", "<script>" * 50000 + "<!--" * 50000]
    t = time.time()
    texts = _apply(spark, H.html_to_text, pages)
    found = _apply(spark, FD.extract_article, pages)
    assert time.time() - t < 60 and len(texts) == 6 and found[4] == "x"


def test_dates_with_an_offset(spark):
    rss = ["Mon, 01 Jan 2024 10:00:00 +0900", "Mon, 1 Jan 2024 10:00:00 GMT", "01 Jan 2024 10:00 Z",
           "Mon, 01 Jan 2024 10:00:00", "Mon, 01 Jan 2024 10:00:00 EST", "Mon, 01 Jan 2024 10:00:00 -0330",
           "Mon, 99 Jan 2024 10:00:00", "soon", "", None]
    day = dt.datetime(2024, 1, 1)
    want = [day.replace(hour=1), day.replace(hour=10), day.replace(hour=10), day.replace(hour=10), day.replace(hour=15),
            day.replace(hour=13, minute=30), None, None, None, None]
    assert _apply(spark, rss_utc, rss) == want
    assert _apply(spark, lambda c: rss_utc(c, reference=True), rss)[:4] == [None, None, None, day.replace(hour=10)]
    iso = ["2024-01-01T10:00:00+09:00", "2024-01-01T10:00:00Z", "2024-01-01 10:00:00.5+0900", "2024-01-01T10:00:00",
           "2024-01-01", "P", None]
    assert _apply(spark, iso_utc, iso) == [day.replace(hour=1), day.replace(hour=10), day.replace(hour=1, microsecond=500000),
                                           day.replace(hour=10), day, None, None]
    assert _apply(spark, lambda c: iso_utc(c, wall_clock=True), iso)[0] == day.replace(hour=10)


def test_feed_items_with_zone_and_content(spark):
    xml = ("<rss><channel><item><title>t</title><link>u</link><description></description>"
           "<content:encoded>&lt;p&gt;body&lt;/p&gt;</content:encoded><pubDate>Mon, 01 Jan 2024 10:00:00 +0900</pubDate>"
           "</item></channel></rss>").replace("<rss>", '<rss xmlns:content="http://purl.org/rss/1.0/modules/content/">')
    raw = spark.createDataFrame([(xml, T0)], "xml string, fetched_at timestamp_ntz")
    items = A.parse_rss(raw, with_content=True)
    out = FD.normalise_entries(items.withColumnRenamed("body_markdown", "description")).first()
    assert (out["published_at"], out["body"]) == ("2024-01-01T01:00:00", "body")


def test_audits_read_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "xx", None), ("a", "y", None), ("b", "y", "zzz")], "id string, t string, u string").write.parquet(path)
    df = spark.read.parquet(path)
    long = PR.audit_length(df, {"t": 1, "u": 2})
    assert sorted(tuple(r) for r in long.collect()) == [("a", "t", 2, 1), ("b", "u", 3, 2)]
    dup = PR.audit_unique(df, ["id", "t", "u"])
    assert sorted((tuple(r) for r in dup.collect()), key=str) == [("id", "a", 2), ("t", "y", 2), ("u", None, 2)]
    for frame in (long, dup):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_vectors_follow_their_texts(spark):
    seen = []
    embedder = E.hashing_embedder(dim=4)

    def counting(df, text, out):
        seen.append(sorted(r["chunk_id"] for r in df.collect()))
        return embedder(df, text, out)

    schema = "chunk_id string, chunk_text string"
    v0 = spark.createDataFrame([], "embedding_id string, chunk_id string, embedding_vector array<float>, "
                                   "model_name string, created_at timestamp_ntz, text_hash string")
    c1 = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", None), (None, "x")], schema)
    v1 = E.refresh_vectors(c1, v0, counting).cache()
    v2 = E.refresh_vectors(c1, v1, counting)
    c2 = spark.createDataFrame([("a", "one"), ("b", "changed"), ("d", "new")], schema)
    v3 = E.refresh_vectors(c2, v1, counting)
    assert seen == [["a", "b", "c"], [], ["b", "d"]] and v2.count() == 3
    assert sorted(r["chunk_id"] for r in v3.collect()) == ["a", "b", "d"]
    assert {r["chunk_id"]: r["status"] for r in E.vector_status(c2, v1).collect()} == {
        "a": "kept", "b": "replaced", "c": "gone", "d": "new"}


def test_landed_documents_never_share_a_file(spark, tmp_path):
    df = spark.createDataFrame([("f", f"<rss>{i}</rss>") for i in range(5)], "feed_id string, xml string").repartition(2)
    out = FD.land(df, str(tmp_path / "landing"), F.col("xml"), by="feed_id", stamp="s")
    docs = [r[0].strip() for r in spark.read.text(out, wholetext=True).select("value").collect()]
    assert sorted(docs) == [f"<rss>{i}</rss>" for i in range(5)]
