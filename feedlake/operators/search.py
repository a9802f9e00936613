"""Scored text search, vector search and random recommendations.

Each function is DataFrame -> DataFrame. Top-k is ``orderBy(...).limit(k)``,
which Spark plans as ``TakeOrderedAndProject`` (a per-partition top-k and one
small merge), and per-request top-k uses ``row_number`` under a window, which
Spark plans with a map-side ``WindowGroupLimit`` so a request that matches a
third of all posts still ships only k rows per partition to its reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.text import contains_ci
from feedlake.functions.vectors import cosine
from feedlake.session import materialize

# Field weights of the scored text search, and the API limits.
TITLE_WEIGHT = 1.0
SUMMARY_WEIGHT = 0.7
BODY_WEIGHT = 0.5
MIN_LIMIT = 1
MAX_LIMIT = 20
DEFAULT_LIMIT = 5
ANCHORS = 3   # rarest n-grams per request used to narrow candidates before the exact test
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"       # tokens: maximal runs of letters and digits
TOKEN_ONLY = r"^[\p{L}\p{N}]+$"       # a query that can only occur inside one token


def text_score(query: Column | str, title: str = "title", summary: str = "summary",
               body: str = "body_markdown", wildcards: bool = True) -> Column:
    """1.0 for a title hit, else 0.7 for a summary hit, else 0.5 for a body hit, else 0.0."""
    return (
        F.when(contains_ci(title, query, wildcards), F.lit(TITLE_WEIGHT))
        .when(contains_ci(summary, query, wildcards), F.lit(SUMMARY_WEIGHT))
        .when(contains_ci(body, query, wildcards), F.lit(BODY_WEIGHT))
        .otherwise(F.lit(0.0))
    )


def search_text(posts: DataFrame, query: str, limit: int = DEFAULT_LIMIT,
                wildcards: bool = True) -> DataFrame:
    """R1 (UI search): posts matching the query in title, summary or body, top ``limit``.

    Order: score DESC, published_at DESC with NULLs first (the warehouse's
    DESC order), id as the tie-break. Filtering on ``score > 0`` selects the
    same rows as the OR of the three LIKEs, with the LIKEs evaluated once.
    """
    scored = posts.select("id", "title", "summary", "url", "published_at", "tags",
                          text_score(query, wildcards=wildcards).alias("similarity_score"))
    return (scored.where(F.col("similarity_score") > 0)
            .orderBy(F.desc("similarity_score"), F.desc_nulls_first("published_at"), F.asc("id"))
            .limit(limit))


def search_api(posts: DataFrame, query: str, limit: int = DEFAULT_LIMIT,
               wildcards: bool = True) -> DataFrame:
    """R2 (API search): as R1 over posts with a summary; returns the response columns."""
    p = posts.where(F.col("summary").isNotNull())
    scored = p.select(F.col("id").alias("article_id"),
                      text_score(query, wildcards=wildcards).cast("double").alias("score"),
                      "title", "summary", "url", "published_at")
    return (scored.where(F.col("score") > 0)
            .orderBy(F.desc("score"), F.desc_nulls_first("published_at"), F.asc("article_id"))
            .limit(limit)
            .select("article_id", "score", "title", "summary", "url"))


def search_vector(posts: DataFrame, query_vector: Column | list[float],
                  limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Cosine of each post's embedding to one query vector, top ``limit``.

    The query vector is a literal array column, so there is no join at all:
    one scan, one projection, one top-k.
    """
    p = posts.where(F.col("emb").isNotNull() & F.col("summary").isNotNull())
    scored = p.select(F.col("id").alias("article_id"), cosine("emb", query_vector).alias("score"),
                      "title", "summary", "url")
    return scored.orderBy(F.desc_nulls_last("score"), F.asc("article_id")).limit(limit)


def searchable_articles(chunks: DataFrame, vectors: DataFrame, posts: DataFrame,
                        by: str = "id") -> DataFrame:
    """J1 (``by="id"``) and J2 (``by="url"``): chunk ⋈ embedding ⋈ post.

    Both are plain inner equi-joins; AQE turns either into a broadcast join
    when a side's measured size is under the threshold, else sort-merge.
    """
    ce = chunks.join(vectors.select("chunk_id", "embedding_vector", "model_name"), "chunk_id")
    if by == "id":
        p = posts.select(F.col("id").alias("article_id"), "title", "url", "published_at")
        return ce.join(p, "article_id").select(
            "chunk_id", "article_id", "chunk_index", "chunk_text", "embedding_vector",
            "title", "url", "published_at")
    p = posts.select(F.col("url").alias("article_url"), "title", "published_at")
    return ce.join(p, "article_url").select(
        "chunk_id", "article_id", "article_url", "chunk_index", "chunk_text", "title",
        "published_at", "embedding_vector", "model_name")


def search_chunks(searchable: DataFrame, query_vector: Column | list[float],
                  limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Chunk-level semantic search over J1/J2, top ``limit`` by similarity."""
    s = searchable.select("chunk_id", "article_id", "chunk_index", "title", "url",
                          cosine("embedding_vector", query_vector).alias("similarity"))
    return s.orderBy(F.desc_nulls_last("similarity"), F.asc("chunk_id")).limit(limit)


def random_order(id_col: Column, seed: int | None) -> Column:
    """``rand(seed)`` order, or with a seed a stable md5 order that SQL can repeat."""
    if seed is None:
        return F.rand()
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"#{seed}")))


def recommend_random(posts: DataFrame, limit: int = DEFAULT_LIMIT, seed: int | None = None) -> DataFrame:
    """Random posts with a summary, score 1.0."""
    p = posts.where(F.col("summary").isNotNull())
    return (p.orderBy(random_order(F.col("id"), seed), F.asc("id")).limit(limit)
            .select(F.col("id").alias("article_id"), F.lit(1.0).alias("score"),
                    "title", "summary", "url"))


# ---------------------------------------------------------------- character n-grams (R6, see recommend.py)


def ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams of a string column (empty when shorter than n).

    A zero-width lookahead regex yields every overlapping n-gram in one linear
    pass; ``substring`` by character position would rescan the UTF-8 bytes
    from the start for each position (quadratic in the text length).
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), 1))


def literal_segments(q: Column) -> Column:
    """Pieces of a LIKE query between its wildcards; every piece must occur in a match."""
    return F.filter(F.split(q, "[%_]"), lambda s: F.length(s) > 0)


def request_grams(rq: DataFrame, gram: int) -> DataFrame:
    """(student_id, n, tri): the distinct n-grams of each request's literal pieces, n = its ``g``."""
    parts = None
    for n in range(1, gram + 1):
        rg = rq.where(F.col("g") == n).select(
            "student_id", F.lit(n).alias("n"),
            F.explode(F.array_distinct(F.flatten(F.transform(
                F.filter(F.col("segs"), lambda s: F.length(s) >= n),
                lambda s: ngrams(s, n))))).alias("tri"))
        parts = rg if parts is None else parts.unionByName(rg)
    return parts


def anchor_candidates(req_grams: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(student_id, key) pairs whose ``index`` entry holds the request's ANCHORS rarest grams.

    The first step is an equi-join on the rarest gram; the next ones are
    semi-joins on (key, gram), a key without hot values. A request's gram set
    is bounded by its query length, so ranking it is a small window.
    """
    df_gram = index.groupBy("n", "tri").agg(F.count("*").alias("df"))   # partial aggregation first
    ranked = (req_grams.join(df_gram, ["n", "tri"], "left")
              .withColumn("df", F.coalesce("df", F.lit(0)))
              .withColumn("r", F.row_number().over(Window.partitionBy("student_id").orderBy("df", "n", "tri")))
              .where(F.col("r") <= ANCHORS))
    ranked = materialize(ranked, "anchors")          # at most ANCHORS rows per request, read ANCHORS times
    cand = (ranked.where(F.col("r") == 1).select("student_id", "n", "tri")
            .join(index, ["n", "tri"]).select("student_id", key))
    for r in range(2, ANCHORS + 1):
        ar = ranked.where(F.col("r") == r).select("student_id", "n", "tri")
        c = cand.join(ar, "student_id", "left")
        cand = (c.where(F.col("tri").isNull()).select("student_id", key)
                .unionByName(c.join(index, [key, "n", "tri"], "left_semi").select("student_id", key)))
    return cand


# ---------------------------------------------------------------- R3, batch of query vectors

QUERY_BYTES = 32 << 20        # query vectors that are sent to every task; beyond, they are dealt to groups of tasks
POST_BLOCK = 4096             # post vectors that are multiplied at once
SCORES = 1 << 20              # scores that are held at once: query vectors are multiplied in blocks, too


class _TopK:
    """The best ``k`` rows per query seen so far by one task: score falling, then id rising.

    An empty place has the score -inf and no id."""

    def __init__(self, n: int, k: int):
        import numpy as np
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), None, object)

    def add(self, rows, ids, scores) -> None:
        """``scores``: one row per query in ``rows``, one column per id, the ids rising."""
        import numpy as np
        if not len(rows) or not len(ids):
            return
        cut = self.scores[rows, -1]                            # equal scores can win by their id
        if len(ids) > self.k:
            cut = np.maximum(cut, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        r, c = np.nonzero(scores >= cut[:, None])
        if not len(r):
            return
        s = scores[r, c]
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)      # rank of each among its query's new rows
        r, c, s, place = (x[place < self.k] for x in (r, c, s, place))
        own, at = np.unique(r, return_inverse=True)
        new_scores, new_ids = np.full((len(own), self.k), -np.inf), np.full((len(own), self.k), None, object)
        new_scores[at, place], new_ids[at, place] = s, ids[c]
        own = rows[own]
        all_scores = np.hstack([self.scores[own], new_scores])
        all_ids = np.hstack([self.ids[own], new_ids])
        names = np.where(np.equal(all_ids, None), "", all_ids).astype(str)
        order = np.lexsort((names, -all_scores), axis=1)[:, :self.k]
        self.scores[own] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[own] = np.take_along_axis(all_ids, order, axis=1)


def _vectors(ids, column) -> tuple:
    """(query ids, {length: (rows, matrix)}) of an Arrow column of vectors, without those that are null."""
    import numpy as np
    known = column.is_valid().to_numpy(zero_copy_only=False)
    ids = np.array(ids.to_pylist(), object)[known]
    column = column.drop_null()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start, by_dim = np.cumsum(size) - size, {}
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        by_dim[dim] = (at, flat[start[at][:, None] + np.arange(dim)])
    return ids, by_dim


def _batch_topk(queries: tuple, k: int):
    """``mapInPandas`` body: exact best ``k`` posts per query over all batches of a task.

    A task holds ``k`` rows per query and ``SCORES`` scores, however many queries there are."""
    import numpy as np

    names, vectors = queries
    by_dim = {dim: (at, m, np.linalg.norm(m, axis=1)) for dim, (at, m) in vectors.items()}

    def run(batches):
        import pandas as pd
        top = _TopK(len(names), k)
        for pdf in batches:
            size = pdf["vec"].map(len)
            for dim, (at, m, norm) in by_dim.items():
                own = pdf[size == dim]
                for a in range(0, len(own), POST_BLOCK):
                    part = own.iloc[a:a + POST_BLOCK]
                    ids = part["id"].to_numpy(object)
                    place = np.argsort(ids, kind="stable")
                    x = np.vstack(part["vec"].to_list()).astype(np.float64).reshape(len(part), dim)[place]
                    length, step = np.linalg.norm(x, axis=1), max(1, SCORES // len(part))
                    for b in range(0, len(at), step):
                        with np.errstate(divide="ignore", invalid="ignore"):
                            sims = m[b:b + step] @ x.T
                            sims /= np.outer(norm[b:b + step], length)
                        sims[~np.isfinite(sims)] = 0.0         # a zero norm gives 0 (V1)
                        top.add(at[b:b + step], ids[place], sims)
        step = max(1, SCORES // (16 * k))
        for a in range(0, len(names), step):
            r, c = np.nonzero(top.scores[a:a + step] > -np.inf)
            yield pd.DataFrame({"query_id": names[a + r], "id": top.ids[a + r, c], "score": top.scores[a + r, c]})
    return run


def search_vector_batch(posts: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT,
                        vec_col: str = "emb", max_bytes: int = QUERY_BYTES) -> DataFrame:
    """R3 for a batch of query vectors ``(query_id, query_vector)``, exact top ``limit`` per query.

    Each task multiplies its posts' vectors with the query matrix (Arrow batches, numpy) and keeps
    ``limit`` rows per query over all its batches; a window with a ``WindowGroupLimit`` takes
    the best of all tasks. The posts are scanned once: query vectors of at most ``max_bytes`` are
    sent to all tasks, more are dealt into groups that meet every post in a shuffled join of
    (group, post block) instead. A query and a post of unlike length have no cosine and are no
    match; a query whose vector is null or matches nothing has one row with null id, score and rank.
    Repeated query ids are answered by their first vector (in order of its components).
    """
    spark = posts.sparkSession
    p = posts.where(F.col(vec_col).isNotNull() & F.col("summary").isNotNull()).select(
        F.col("id").cast("string").alias("id"), F.col(vec_col).alias("vec"))
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("query_vector").cast("array<double>").alias("qv"))
    q = materialize(q.groupBy("query_id").agg(F.min("qv").alias("qv")), "query-vectors")
    schema = "query_id string, id string, score double"
    size = q.agg(F.sum(F.lit(64) + 8 * F.greatest(F.size("qv"), F.lit(0)))).first()[0] or 0
    if size <= max_bytes:
        rows = q.where(F.col("qv").isNotNull()).toArrow().combine_chunks()                   # at most max_bytes
        sent = spark.sparkContext.broadcast(_vectors(rows["query_id"], rows["qv"].combine_chunks()))

        def run(batches):
            yield from _batch_topk(sent.value, limit)(batches)

        # every task gives ``limit`` rows per query, so there are no more tasks than keep all cores busy
        tasks = 2 * spark.sparkContext.defaultParallelism
        cand = p.coalesce(tasks).mapInPandas(run, schema) if rows.num_rows else spark.createDataFrame([], schema)
    else:
        groups = -(-size // max_bytes)
        blocks = max(-(-2 * spark.sparkContext.defaultParallelism // groups), p.count() // (16 * POST_BLOCK) + 1)
        grouped = q.where(F.col("qv").isNotNull()).withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
        left = p.withColumns({"b": F.pmod(F.xxhash64("id"), F.lit(blocks)), "g": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1)))})
        right = grouped.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1))))

        def pairs(a, b):
            import pandas as pd
            import pyarrow as pa
            none = pd.DataFrame(columns=["query_id", "id", "score"])
            if not len(a) or not len(b):
                return none
            rows = _vectors(pa.array(b["query_id"]), pa.array(b["qv"], pa.list_(pa.float64())))
            return pd.concat([*_batch_topk(rows, limit)(iter([a[["id", "vec"]]]))] or [none])

        cand = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(pairs, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    best = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return q.select("query_id").join(best, "query_id", "left")
