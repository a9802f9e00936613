"""Adapters: the driver's tables to the shapes the operators expect.

Every adapter reads a whole driver table and derives the reference's shapes
from it by rules on the row's own columns (no sampling, no id subsets), so the
work of every query grows with the tables. The same rules are written a second
time, independently, as DuckDB SQL in ``feedlake.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the test shapes (run clock, host, windows).
AS_OF = "2024-01-31 00:00:00"
EPOCH = "2024-01-01 00:00:00"
HOST = "https://example.com"
FEED_HOURS = 48          # a document is fetched (doc_id mod 48) hours before AS_OF
FEED_SPAN = 12000        # a feed is one source at one fetch time within a span of 12,000 doc ids;
                         # the fetch hour is doc_id mod 48, so a feed holds at most 12000 / 48 = 250
                         # documents whatever the sources are (about 12 when the 20 sources rotate)
TARGET_AGE_HOURS = 12    # the curated table holds what was fetched >= 12 h ago


def ts_ntz(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table. ``spread=True`` for inputs whose next step is per-row text
    work (no shuffle of its own): a small single-row-group file is then spread
    over all cores (see ``feedlake.session.spread_small``)."""
    from feedlake.session import spread_small
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    return spread_small(df, path) if spread else df


def fetched_at(doc_id: Column) -> Column:
    return F.timestamp_add("HOUR", -(doc_id % F.lit(FEED_HOURS)), ts_ntz(AS_OF))


def published_at(doc_id: Column) -> Column:
    return F.timestamp_add("MINUTE", doc_id, ts_ntz(EPOCH))


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def revised_old(text: Column) -> Column:
    """The earlier revision of a text that the curated table still holds."""
    return F.regexp_replace(text, "the", "teh")


def documents(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return table(spark, sf_dir, "documents", spread)


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One normalised feed entry per document (the S3 output shape) plus fetch data.

    The entry URL is keyed by content, so natural copies of a text collapse to
    one article fetched several times (duplicate keys for G1/W1/M1).
    """
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id"),
        F.col("source"),
        F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("id"),
        first_line(F.col("text")).alias("title"),
        F.concat(F.lit(HOST + "/n/"), F.md5(F.col("text"))).alias("url"),
        F.date_format(published_at(F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
        F.col("text").alias("body"),
        fetched_at(F.col("doc_id")).alias("fetched_at"),
        (F.col("doc_id") / F.lit(FEED_SPAN)).cast("long").alias("feed_no"),
    )


def raw_json_feeds(spark: SparkSession, sf_dir: str, earlier: bool = False) -> DataFrame:
    """RAW feed rows: one row per landed feed, the whole entry array as a variant (``earlier``: bodies in their earlier revision).

    A feed is the entries of one source fetched at one time, within one
    FEED_SPAN of doc ids, so no group is unbounded. Every feed was also
    fetched once 24 hours earlier, so the raw table holds each entry twice
    (the duplicates G1 collapses).
    """
    e = feed_entries(spark, sf_dir)
    if earlier:
        e = e.withColumn("body", revised_old(F.col("body")))
    e = e.withColumn("fetched_at", F.explode(F.array(
        F.col("fetched_at"), F.timestamp_add("HOUR", F.lit(-24), F.col("fetched_at")))))
    entry = F.struct("id", "title", "url", "published_at", "body")
    return (
        e.groupBy("source", "fetched_at", "feed_no")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("doc_id"), entry.alias("e")))).alias("items"))
        .select(
            F.md5(F.concat_ws("|", "source", F.col("fetched_at").cast("string"),
                              F.col("feed_no").cast("string"))).alias("id"),
            F.concat(F.lit(HOST + "/feed/"), F.col("source")).alias("source_url"),
            F.col("fetched_at"),
            F.parse_json(F.to_json(F.transform("items", lambda x: x["e"]))).alias("raw_data"),
        )
    )


def api_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the blog API's JSON (``data.contents[]``), derived per document."""
    d = documents(spark, sf_dir)
    doc = F.col("doc_id").cast("string")
    return d.select(
        "doc_id", "source",
        F.when(F.col("lang") != "en", F.concat(F.lit("n"), doc)).alias("key"),
        F.when(F.col("source") != "src0", doc).alias("id"),
        first_line(F.col("text")).alias("name"),
        F.col("text").alias("body"),
        F.when(F.col("n_chars") >= 5000, F.lit(300.0))
        .when(F.col("lang") == "fr", F.lit(0.6)).otherwise(F.lit(0.0)).alias("price"),
        (F.col("lang") == "de").alias("isMembership"),
        F.concat(F.lit("#"), F.col("lang")).alias("hashtag"),
        F.struct(F.concat(F.col("source"), F.lit("/x")).alias("urlname")).alias("user"),
        F.date_format(published_at(F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss").alias("publishedAt"),
        F.when(F.col("n_chars") < 200, F.lit("ImageNote")).otherwise(F.lit("TextNote")).alias("type"),
        fetched_at(F.col("doc_id")).alias("fetched_at"),
        (F.col("doc_id") / F.lit(FEED_SPAN)).cast("long").alias("feed_no"),
    )


def raw_api_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW rows of pipeline B: ``xml`` holds ``{"data": {"contents": [...]}}`` as a variant."""
    e = api_entries(spark, sf_dir)
    entry = F.struct("key", "id", "name", "body", "price", "isMembership", "hashtag",
                     "user", "publishedAt", "type")
    return (
        e.groupBy("source", "fetched_at", "feed_no")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("doc_id"), entry.alias("e")))).alias("items"))
        .select(
            F.parse_json(F.to_json(F.struct(F.struct(
                F.transform("items", lambda x: x["e"]).alias("contents")).alias("data")))).alias("xml"),
            F.col("fetched_at"),
        )
    )


def _xml_escape(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def raw_xml_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW rows of pipeline C: one RSS 2.0 document per feed, as text."""
    d = documents(spark, sf_dir)
    item = F.concat(
        F.lit("<item><title>"), _xml_escape(first_line(F.col("text"))), F.lit("</title><link>"),
        F.lit(HOST + "/"), F.col("source"), F.lit("/n/"), F.col("doc_id").cast("string"),
        F.lit("</link><description>"), _xml_escape(F.col("text")), F.lit("</description><pubDate>"),
        F.date_format(published_at(F.col("doc_id")), "EEE, dd MMM yyyy HH:mm:ss"),
        F.lit("</pubDate></item>"),
    )
    items = d.select(
        "doc_id", "source", fetched_at(F.col("doc_id")).alias("fetched_at"),
        (F.col("doc_id") / F.lit(FEED_SPAN)).cast("long").alias("feed_no"), item.alias("item"))
    return (
        items.groupBy("source", "fetched_at", "feed_no")
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "item"))).alias("items"))
        .select(
            F.concat(F.lit("<rss version=\"2.0\"><channel><title>"), F.col("source"),
                     F.lit("</title>"), F.array_join(F.transform("items", lambda x: x["item"]), ""),
                     F.lit("</channel></rss>")).alias("xml"),
            F.col("fetched_at"),
        )
    )


def posts(spark: SparkSession, sf_dir: str, with_emb: bool = True) -> DataFrame:
    """The 11-column curated posts table (``core.posts``), one row per document."""
    d = documents(spark, sf_dir, spread=True)
    p = d.select(
        F.col("doc_id"),
        F.col("doc_id").cast("string").alias("id"),
        first_line(F.col("text")).alias("title"),
        F.col("text").alias("body_markdown"),
        F.when(F.round(F.when(F.col("n_chars") >= 5000, F.lit(300.0))
                       .when(F.col("lang") == "fr", F.lit(0.6)).otherwise(F.lit(0.0))) > 0, F.lit("premium"))
        .when(F.col("lang") == "de", F.lit("membership")).otherwise(F.lit("free")).alias("level"),
        F.array(F.concat(F.lit("#"), F.col("lang")), F.lit("example.com"), F.col("source")).alias("tags"),
        F.concat(F.left(F.col("text"), F.lit(200)), F.lit("...")).alias("summary"),
        F.concat(F.lit(HOST + "/"), F.col("source"), F.lit("/n/"), F.col("doc_id").cast("string")).alias("url"),
        published_at(F.col("doc_id")).alias("published_at"),
        fetched_at(F.col("doc_id")).alias("created_at"),
        fetched_at(F.col("doc_id")).alias("updated_at"),
    )
    if with_emb:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("emb"))
        p = p.join(e, "doc_id", "left")
    else:
        p = p.withColumn("emb", F.lit(None).cast("array<float>"))
    return p.select("id", "title", "body_markdown", "level", "tags", "summary", "emb", "url",
                    "published_at", "created_at", "updated_at")


def posts_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8-column ``core.posts_by_url`` table as the previous merge left it.

    It holds every entry fetched at least TARGET_AGE_HOURS before the run, in
    the earlier revision of its text, keyed by URL like the merge.
    """
    e = feed_entries(spark, sf_dir).where(
        F.col("fetched_at") <= F.timestamp_add("HOUR", F.lit(-TARGET_AGE_HOURS), ts_ntz(AS_OF)))
    latest = F.max_by(F.struct("id", "title", "body", "published_at"),
                      F.struct("fetched_at", "id"))
    t = e.groupBy("url").agg(latest.alias("l"), F.min("fetched_at").alias("first_fetched_at"))
    body = revised_old(F.col("l.body"))
    return t.select(
        F.col("l.id").alias("id"), F.col("l.title").alias("title"), F.col("url"),
        F.col("l.published_at").try_cast("timestamp_ntz").alias("published_at"),
        body.alias("body"), F.length(body).cast("long").alias("body_length"),
        F.col("first_fetched_at"), F.col("first_fetched_at").alias("last_updated_at"),
    )


def prior_posts(spark: SparkSession, sf_dir: str, id_rule: str = "doc") -> DataFrame:
    """The 11-column posts table as the previous transform run left it.

    Rows fetched at least TARGET_AGE_HOURS ago, bodies in their earlier
    revision. ``id_rule`` picks the key the transform uses: ``doc`` (API key,
    pipeline B) or ``md5url`` (md5 of the link, pipeline C).
    """
    p = posts(spark, sf_dir, with_emb=False)
    p = p.where(F.col("updated_at") <= F.timestamp_add("HOUR", F.lit(-TARGET_AGE_HOURS), ts_ntz(AS_OF)))
    if id_rule == "md5url":
        p = p.withColumn("id", F.md5(F.col("url")))
    return p.withColumn("body_markdown", revised_old(F.col("body_markdown")))


def container_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose article is the inside of a content container with more elements of its name around and in it."""
    decoy = '<div class="note-body-x"><div>decoy</div></div>'
    opening = F.element_at(F.array(*[F.lit(f"{decoy}<div {c}><div><div></div>") for c in (
        "class='w note-body'", "id=a class=p-article__content", 'class="note-common-styles__textnote-body w"')]),
        (F.pmod(F.col("page_id"), F.lit(3)) + 1).cast("int"))
    html = F.replace(F.col("html"), F.lit("<article>"), opening)
    html = F.replace(html, F.lit("</article>"), F.lit('</div> </div><div class="note-body">later</div>'))
    return table(spark, sf_dir, "pages", spread=True).withColumn("html", html)


def zoned_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's date written as an RSS and as an ISO date, in one of five zones or none."""
    d = documents(spark, sf_dir)
    n = (F.pmod(F.col("doc_id"), F.lit(6)) + 1).cast("int")
    wall = published_at(F.col("doc_id"))

    def zone(*names: str) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in names]), n)

    return d.select(
        "doc_id",
        F.concat(F.date_format(wall, "EEE, dd MMM yyyy HH:mm:ss"),
                 zone(" +0900", " GMT", "", " EST", " -0330", " Z")).alias("rss"),
        F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"),
                 zone("+09:00", "Z", "", "-05:00", "-0330", "+00:00")).alias("iso"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stg.embeddings``: driver vectors attached to the first chunk of article vec_id."""
    from feedlake.operators.chunks import chunk_key
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("embedding_id"),
        chunk_key(F.col("vec_id").cast("string"), F.lit(0)).alias("chunk_id"),
        F.col("embedding").alias("embedding_vector"),
        F.concat(F.lit("m"), F.col("label").cast("string")).alias("model_name"),
        ts_ntz(AS_OF).alias("created_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation requests ``(request_id, student_id, query, limit)`` from conversations.

    One request per conversation: the query is the first word of seven or more
    letters in the opening user turn (NULL when there is none, empty for some) and the limit
    is the number of turns (none for some), which may fall outside 1..20. Students ask
    several times; some requests name none.
    """
    c = table(spark, sf_dir, "conversations")
    opening = F.min_by(F.col("text"), F.col("turn"))
    g = c.groupBy("conv_id").agg(opening.alias("opening"), F.count("*").alias("turns"))
    word = F.regexp_extract(F.col("opening"), r"([A-Za-z]{7,})", 1)
    conv = F.col("conv_id")
    return g.select(
        conv.alias("request_id"),
        F.when(conv % 97 != 5, F.concat(F.lit("s"), (conv % 100).cast("string"))).alias("student_id"),
        F.when(conv % 10 == 3, F.lit("")).when(word != "", F.lower(word)).alias("query"),
        F.when(conv % 8 != 5, F.col("turns").cast("int")).alias("limit"),
    )
