"""Recommendations for a table of requests, over a kept search index.

The index has one posting per post and distinct token: the token (a run of letters and digits, in
lower case), the post, the weight of the best field that holds it, and the post's date. A query of
letters and digits can only occur inside one token, so the answer to it is in the index alone:
the vocabulary tokens that contain it, and the best of their postings per post. Texts are
fetched for the twenty best posts only. Other queries take their longest run of letters and
digits to the index and are verified on the texts of the posts it leaves; queries without any
such run go through character n-grams of the texts.

The index is stored in buckets by post, one row per post with all its postings, so posts that a merge
has changed are replaced in their buckets alone (``update_index``). Equal queries of a batch are answered once.

No requests x posts product is formed; a query or token that a third of all posts match is cut to
its best rows within every task before they are shuffled (``WindowGroupLimit``), and a query that a
third of all requests share is one row of at most twenty recommendations in the last join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.operators.embed import Embedder
from feedlake.operators.search import (BODY_WEIGHT, DEFAULT_LIMIT, MAX_LIMIT, MIN_LIMIT, SUMMARY_WEIGHT, TITLE_WEIGHT, TOKEN_ONLY,
                                       TOKEN_SPLIT, anchor_candidates, literal_segments, ngrams, random_order, request_grams,
                                       search_vector_batch)
from feedlake.session import materialize
from feedlake.sources import tables

#: Characters of the n-grams that queries are looked up by (fewer for shorter queries).
GRAM = 5
INDEX_BUCKETS = 64


# ---------------------------------------------------------------- the index


def post_entries(posts: DataFrame) -> DataFrame:
    """(id, published_at, postings) of the posts that have a summary: one row per post, with (token, score) per distinct token.

    One pass: the tokens of a field are those that no better field has."""
    def tokens(c: str) -> Column:
        return F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), TOKEN_SPLIT)

    title = F.array_distinct(tokens("title"))
    p = posts.where(F.col("summary").isNotNull()).select("id", "published_at", "summary", "body_markdown", title.alias("t"))
    p = p.withColumn("s", F.array_except(tokens("summary"), F.col("t")))
    p = p.withColumn("b", F.array_except(tokens("body_markdown"), F.concat("t", "s")))

    def weighted(c: str, weight: float) -> Column:
        return F.transform(c, lambda x: F.struct(x.alias("token"), F.lit(weight).alias("score")))

    scored = [weighted(c, w) for c, w in (("t", TITLE_WEIGHT), ("s", SUMMARY_WEIGHT), ("b", BODY_WEIGHT))]
    return p.select("id", "published_at", F.concat(*scored).alias("postings"))


def exploded(entries: DataFrame) -> DataFrame:
    """Postings (id, token, score, published_at), one row per post and distinct token."""
    e = entries.select("id", "published_at", F.explode("postings").alias("x"))
    return e.select("id", F.col("x.token").alias("token"), F.col("x.score").alias("score"), "published_at").where("token <> ''")


def post_tokens(posts: DataFrame) -> DataFrame:
    """Postings (id, token, score, published_at) of the posts that have a summary."""
    return exploded(post_entries(posts))


def build_index(posts: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Store the postings of all posts, one row per post: only whole posts are shuffled, sorted and replaced."""
    tables.write_bucketed(post_entries(posts), path, "id", buckets)


def update_index(path: str, changed: DataFrame, buckets: int = INDEX_BUCKETS) -> list[int]:
    """Replace the postings of the changed posts (the rows that a merge inserted or updated); other buckets stay as they are.

    A post that lost its summary or its tokens loses its postings. Returns the touched buckets."""
    changed = materialize(changed.select("id", "title", "summary", "body_markdown", "published_at"), "changed-posts")

    def merge(target, ids):
        new = post_entries(changed)
        return new if target is None else target.join(ids, "id", "left_anti").unionByName(new)

    return tables.bucketed_merge(path, changed.select("id").where(F.col("id").isNotNull()).distinct(), "id", merge, buckets)


def read_index(spark, path: str) -> DataFrame:
    return exploded(tables.read(spark, path))


def matching_tokens(postings: DataFrame, pieces: DataFrame) -> DataFrame:
    """(piece, token) for every vocabulary token that contains the piece (lower case, letters and digits).

    The join is on the piece's rarest n-gram (n = GRAM, or its length if it is shorter)."""
    pieces = pieces.distinct()
    sizes = sorted(r[0] for r in pieces.select(F.least(F.length("piece"), F.lit(GRAM))).distinct().collect())     # at most GRAM numbers
    if not sizes:
        return pieces.select("piece", F.col("piece").alias("token"))
    wanted = [pieces.where(F.least(F.length("piece"), F.lit(GRAM)) == n).select("piece", F.lit(n).alias("n"), F.explode(ngrams(F.col("piece"), n)).alias("tri"))
              for n in sizes]
    vocab = postings.select("token").distinct()
    sets = F.concat(*(F.transform(ngrams(F.col("token"), n), _sized(n)) for n in sizes))
    grams = vocab.select("token", F.explode(sets).alias("x")).select("token", "x.n", "x.tri")
    while len(wanted) > 1:
        wanted[0] = wanted[0].unionByName(wanted.pop())
    # only what the pieces ask for is written, and read twice
    grams = materialize(grams.join(wanted[0].select("n", "tri").distinct(), ["n", "tri"], "left_semi"), "vocabulary-grams")
    counts = grams.groupBy("n", "tri").agg(F.count("*").alias("df"))
    anchor = (wanted[0].join(counts, ["n", "tri"]).groupBy("piece").agg(F.min(F.struct("df", "n", "tri")).alias("a"))
              .select("piece", "a.n", "a.tri"))
    return anchor.join(grams, ["n", "tri"]).where(F.contains(F.col("token"), F.col("piece"))).select("piece", "token")


def _sized(n: int):
    return lambda g: F.struct(F.lit(n).alias("n"), g.alias("tri"))


# ---------------------------------------------------------------- the batch


def with_status(requests: DataFrame) -> DataFrame:
    """The requests as the API takes them: limit 5 where none is given, an empty query is none, and why a request is refused."""
    limit = F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT)).cast("int")
    query = F.when(F.col("query") != "", F.col("query"))
    status = (F.when(F.col("student_id").isNull(), F.lit("no student_id"))
              .when(~limit.between(MIN_LIMIT, MAX_LIMIT), F.lit(f"limit outside {MIN_LIMIT}..{MAX_LIMIT}")).otherwise(F.lit("ok")))
    return requests.withColumns({"limit": limit, "query": query}).withColumn("status", status)


def _best(scored: DataFrame, by: str) -> DataFrame:
    """The MAX_LIMIT best posts per ``by``, with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.desc_nulls_first("published_at"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MAX_LIMIT).select(F.col(by).alias("answer"), "rank", "id", "score")


def _verified(candidates: DataFrame, posts: DataFrame, wildcards: bool) -> DataFrame:
    """Scores of the (q, id) pairs that match, on the posts' texts."""
    low = posts.select("id", "published_at", *(F.lower(c).alias(c) for c in ("title", "summary", "body_markdown")))
    plain = ~F.col("q").rlike(r"[%_\\\\]")

    def hit(c: str) -> Column:
        # a backslash is an ordinary character, not LIKE's escape
        like = F.like(F.col(c), F.concat(F.lit("%"), F.replace(F.col("q"), F.lit("\\"), F.lit("\\\\")), F.lit("%")))
        return F.when(plain, F.contains(F.col(c), F.col("q"))).otherwise(like) if wildcards else F.contains(F.col(c), F.col("q"))

    score = (F.when(hit("title"), F.lit(TITLE_WEIGHT)).when(hit("summary"), F.lit(SUMMARY_WEIGHT))
             .when(hit("body_markdown"), F.lit(BODY_WEIGHT)).otherwise(F.lit(0.0)))
    return candidates.join(low, "id").select("q", "id", score.alias("score"), "published_at").where("score > 0")


def recommend_batch(requests: DataFrame, posts: DataFrame, seed: int = 0, wildcards: bool = True,
                    as_of: Column | None = None, with_rejects: bool = True, index: DataFrame | None = None) -> DataFrame:
    """R6 over a table of requests (request_id, student_id, query, limit); one row per request.

    * A request without a query, or with an empty one, gets posts in the stable random order (R5).
    * A query gets R2's posts: scored by its best field, latest first, ``%`` and ``_`` being
      wildcards. A query of wildcards only matches a field that has as many characters as it has ``_``.
    * Without a limit five posts are returned. A request with a limit outside 1..20, or without a
      student, gets no posts and a ``status`` other than ``ok`` (left out with ``with_rejects=False``).

    ``index``: the postings of ``posts`` (``read_index``); without it they are computed for this
    batch. Without a request_id column every row is a request of its own. Result: request_id,
    student_id, recommendations (array in rank order), total_count, generated_at, status.
    """
    generated_at = as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
    if "request_id" not in requests.columns:
        requests = requests.withColumn("request_id", F.monotonically_increasing_id())
    q = F.lower(F.col("query"))
    segments = literal_segments(q) if wildcards else F.array(q)
    runs = F.filter(F.flatten(F.transform(segments, lambda s: F.split(s, TOKEN_SPLIT))), lambda s: F.length(s) > 0)
    longest = F.aggregate(runs, F.lit(""), lambda a, s: F.when(F.length(s) > F.length(a), s).otherwise(a))
    characters = F.aggregate(segments, F.lit(0), lambda a, s: F.greatest(a, F.length(s)))
    kind = (F.when(F.col("status") != "ok", "refused").when(F.col("query").isNull(), "random").when(characters == 0, "any")
            .when(q.rlike(TOKEN_ONLY), "token").when(F.length(longest) > 0, "piece").otherwise("signs"))
    rq = with_status(requests.select("request_id", "student_id", "query", "limit"))
    rq = rq.withColumns({"kind": kind, "q": q, "piece": longest, "any": F.length(F.regexp_replace(q, "[^_]", "")), "segs": segments,
                         "g": F.least(F.lit(GRAM), characters)})
    answer = (F.when(F.col("kind") == "random", F.lit("r")).when(F.col("kind") == "any", F.concat(F.lit("u"), F.col("any").cast("string")))
              .when(F.col("kind") != "refused", F.concat(F.lit("q"), F.col("q"))))
    rq = materialize(rq.withColumn("answer", answer), "requests")                # one row per request, read by every branch
    kinds = {r[0] for r in rq.select("kind").distinct().collect()}               # at most six words
    live = posts.where(F.col("summary").isNotNull())
    pools = []

    if kinds & {"token", "piece"}:
        postings = index if index is not None else materialize(post_tokens(posts), "postings")
        asked = rq.where(F.col("kind").isin("token", "piece")).select("q", F.when(F.col("kind") == "token", F.col("q")).otherwise(F.col("piece")).alias("piece"),
                                                                     (F.col("kind") == "token").alias("sure")).distinct()
        asked = materialize(asked, "queries")
        found = materialize(matching_tokens(postings, asked.select("piece")), "tokens").join(postings, "token")
        sure = asked.where("sure").select(F.concat(F.lit("q"), F.col("q")).alias("answer"), "piece")
        scored = (found.join(sure, "piece").groupBy("answer", "id").agg(F.max("score").alias("score"), F.first("published_at").alias("published_at")))
        pools.append(_best(scored, "answer"))
        if "piece" in kinds:
            pairs = found.join(asked.where("not sure"), "piece").select("q", "id").distinct()
            pools.append(_best(_verified(pairs, live, wildcards).withColumn("a", F.concat(F.lit("q"), F.col("q"))), "a"))

    if "signs" in kinds:                                                         # no letter or digit: n-grams of the texts
        asked = materialize(rq.where(F.col("kind") == "signs").select("q", "segs", "g").dropDuplicates(["q"]), "signs")
        grams = request_grams(asked.withColumnRenamed("q", "student_id"), GRAM)
        text = F.lower(F.concat_ws("\n", "title", "summary", "body_markdown"))
        held = None
        for n in sorted(r[0] for r in asked.select("g").distinct().collect()):   # at most GRAM numbers
            own = live.select("id", F.lit(n).alias("n"), F.explode(ngrams(text, n)).alias("tri"))
            own = own.join(grams.where(F.col("n") == n).select("n", "tri").distinct(), ["n", "tri"], "left_semi")
            held = own if held is None else held.unionByName(own)
        pairs = anchor_candidates(grams, materialize(held, "post-grams"), "id").withColumnRenamed("student_id", "q")
        pools.append(_best(_verified(pairs, live, wildcards).withColumn("a", F.concat(F.lit("q"), F.col("q"))), "a"))

    if "any" in kinds:                                                           # one pass for all numbers of characters
        counts = [r[0] for r in rq.where(F.col("kind") == "any").select("any").distinct().collect()]     # at most as many as the longest query has characters
        u = F.col("u")
        score = (F.when(F.length("title") >= u, F.lit(TITLE_WEIGHT)).when(F.length("summary") >= u, F.lit(SUMMARY_WEIGHT))
                 .when(F.length("body_markdown") >= u, F.lit(BODY_WEIGHT)).otherwise(F.lit(0.0)))
        each = live.withColumn("u", F.explode(F.array(*(F.lit(c) for c in counts))))
        scored = each.select(F.concat(F.lit("u"), u.cast("string")).alias("a"), "id", score.alias("score"), "published_at").where("score > 0")
        pools.append(_best(scored, "a"))

    if "random" in kinds:
        pools.append(_random_pool(live, seed))
    return _answered(rq, pools, posts, generated_at, with_rejects)


def _random_pool(live: DataFrame, seed: int) -> DataFrame:
    """The MAX_LIMIT first posts in the stable random order."""
    top = live.select("id", F.lit(1.0).alias("score"), random_order(F.col("id"), seed).alias("o")).orderBy("o", "id").limit(MAX_LIMIT)
    return top.select(F.lit("r").alias("answer"), F.row_number().over(Window.orderBy("o", "id")).alias("rank"), "id", "score")


def _answered(rq: DataFrame, pools: list[DataFrame], posts: DataFrame, generated_at: Column, with_rejects: bool) -> DataFrame:
    """Every request with the recommendations of its ``answer``, from pools of (answer, rank, id, score)."""
    rec = "array<struct<article_id:string,score:double,title:string,summary:string,url:string>>"
    if pools:
        pool = materialize(reduce(DataFrame.unionByName, pools), "answers")      # at most MAX_LIMIT rows per distinct query
        texts = posts.select("id", "title", "summary", "url").join(pool.select("id").distinct(), "id", "left_semi")
        entry = F.struct("rank", F.struct(F.col("id").cast("string").alias("article_id"), F.col("score").cast("double").alias("score"), "title", "summary", "url").alias("r"))
        recs = pool.join(texts, "id").groupBy("answer").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["r"]).alias("recs"))
        out = rq.join(recs, "answer", "left")
    else:
        out = rq.withColumn("recs", F.lit(None).cast(rec))
    own = F.slice(F.coalesce(F.col("recs"), F.array().cast(rec)), F.lit(1), F.greatest(F.col("limit"), F.lit(0)))
    out = out.select("request_id", "student_id", F.when(F.col("status") == "ok", own).otherwise(F.array().cast(rec)).alias("recommendations"), "status")
    out = out.select("request_id", "student_id", "recommendations", F.size("recommendations").cast("long").alias("total_count"),
                     generated_at.alias("generated_at"), "status")
    return out if with_rejects else out.where("status = 'ok'")


def recommend_similar(requests: DataFrame, posts: DataFrame, embedder: Embedder, seed: int = 0,
                      as_of: Column | None = None, with_rejects: bool = True) -> DataFrame:
    """R6 by meaning, as the API does with a model: requests and result as in ``recommend_batch``.

    Distinct queries are embedded once and answered by cosine among the posts that have an embedding
    and a summary (``search_vector_batch``: one scan of the posts). A query without a vector, or with
    one of another length than the posts' vectors, gets no posts; requests without a query get the
    stable random order.
    """
    generated_at = as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
    if "request_id" not in requests.columns:
        requests = requests.withColumn("request_id", F.monotonically_increasing_id())
    rq = with_status(requests.select("request_id", "student_id", "query", "limit"))
    answer = F.when(F.col("status") == "ok", F.when(F.col("query").isNull(), F.lit("r")).otherwise(F.concat(F.lit("q"), F.col("query"))))
    rq = materialize(rq.withColumn("answer", answer), "requests")
    asked = rq.where(F.col("answer").startswith("q")).select("query").distinct()
    vectors = embedder(asked, "query", "query_vector").select(F.concat(F.lit("q"), F.col("query")).alias("query_id"), "query_vector")
    similar = search_vector_batch(posts, vectors, MAX_LIMIT).where(F.col("id").isNotNull())
    pools = [similar.select(F.col("query_id").alias("answer"), "rank", F.col("id").cast(posts.schema["id"].dataType).alias("id"), "score"),
             _random_pool(posts.where(F.col("summary").isNotNull()), seed)]
    return _answered(rq, pools, posts, generated_at, with_rejects)
