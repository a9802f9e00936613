import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedlake.operators import recommend as R
from feedlake.operators import search as S

T0 = dt.datetime(2024, 1, 1)
POSTS = [
    ("1", "Alpha news", "the summary", "body about cats", T0),
    ("2", "beta", "alpha summary", "body", T0 + dt.timedelta(days=1)),
    ("3", "gamma", "s", "ALPHA in body", None),
    ("4", "delta", None, "alpha hidden, no summary", T0),
    ("5", "50% off", "s", "100_000 items", T0),
    ("6", "a", "b", "c", T0),
]
SCHEMA = "id string, title string, summary string, body_markdown string, published_at timestamp_ntz"


def _posts(spark):
    return spark.createDataFrame(POSTS, SCHEMA).withColumn("url", F.concat(F.lit("u"), "id")).withColumn(
        "tags", F.array(F.lit("t")))


def test_search_text_scores_and_null_order(spark):
    got = [(r["id"], r["similarity_score"]) for r in S.search_text(_posts(spark), "alpha", limit=10).collect()]
    assert got == [("1", 1.0), ("2", 0.7), ("3", 0.5), ("4", 0.5)]   # NULL published_at first on DESC


def test_api_requires_summary(spark):
    got = [r["article_id"] for r in S.search_api(_posts(spark), "alpha", limit=10).collect()]
    assert got == ["1", "2", "3"]


def test_wildcards(spark):
    p = _posts(spark)
    assert {r["id"] for r in S.search_text(p, "%", limit=20).collect()} == {"1", "2", "3", "4", "5", "6"}
    assert [r["id"] for r in S.search_text(p, "50%", limit=20).collect()] == ["5"]
    assert {r["id"] for r in S.search_text(p, "a_p", limit=20).collect()} == {"1", "2", "3", "4"}
    assert S.search_text(p, "a_p", limit=20, wildcards=False).count() == 0


def test_top_k_plan(spark):
    plan = S.search_text(_posts(spark), "alpha")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def brute_recommend(posts, requests, seed):
    import hashlib
    import re

    def like(v, q):
        if v is None:
            return False
        rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q.lower())
        return re.fullmatch(f"(?s).*{rx}.*", v.lower()) is not None

    def score(p, q):
        return 1.0 if like(p[1], q) else 0.7 if like(p[2], q) else 0.5 if like(p[3], q) else 0.0

    live = [p for p in posts if p[2] is not None]
    rnd = sorted(live, key=lambda p: (hashlib.md5(f"{p[0]}#{seed}".encode()).hexdigest(), p[0]))
    out = {}
    for sid, q, lim in requests:
        lim = 5 if lim is None else lim
        if not 1 <= lim <= 20:
            out[sid] = []
            continue
        if not q:
            out[sid] = [(p[0], 1.0) for p in rnd[:lim]]
            continue
        hits = [(p, score(p, q)) for p in live if score(p, q) > 0]
        hits.sort(key=lambda h: (-h[1], -(h[0][4].timestamp() if h[0][4] else 1e18), h[0][0]))
        out[sid] = [(p[0], s) for p, s in hits[:lim]]
    return out


def test_recommend_batch_matches_brute_force(spark):
    reqs = [("s1", "alpha", 2), ("s2", "al", 5), ("s3", None, 3), ("s4", "%", 20), ("s5", "x", 0),
            ("s6", "zzzz", 5), ("s7", "a_p", 5), ("s8", "Body", 21), ("s9", "bo", 1),
            ("s10", "in body", 5), ("s11", "50% off", 3), ("s12", "hidden, no", 4), ("s13", "ALPHA", 20),
            ("s14", "___", 6), ("s15", "%_____%", 6), ("s16", "", 2), ("s17", "________", 3)]
    rdf = spark.createDataFrame(reqs, "student_id string, query string, limit int")
    out = R.recommend_batch(rdf, _posts(spark), seed=3, as_of=F.lit(T0).cast("timestamp_ntz")).collect()
    got = {r["student_id"]: [(x["article_id"], x["score"]) for x in r["recommendations"]] for r in out}
    want = brute_recommend(POSTS, reqs, 3)
    assert got == want
    assert all(r["total_count"] == len(r["recommendations"]) for r in out)


def test_requests_are_answered_one_by_one(spark):
    reqs = [(1, "s1", "alpha", 2), (2, "s1", "body", 3), (3, "s1", None, 1), (4, "s1", "", 2), (5, "s2", None, None), (6, "s2", "x", 0),
            (7, "s2", None, 21), (8, None, "alpha", 3), (9, "s3", "   ", 5), (10, "s3", ".,;", 5), (11, "s3", "al%a", None)]
    rdf = spark.createDataFrame(reqs, "request_id long, student_id string, query string, limit int")
    out = {r["request_id"]: r for r in R.recommend_batch(rdf, _posts(spark), seed=3).collect()}
    want = brute_recommend(POSTS, [(i, q, lim) for i, s, q, lim in reqs if s], 3)
    assert {i: [(x["article_id"], x["score"]) for x in r["recommendations"]] for i, r in out.items()} == {**want, 8: []}
    assert {i: r["status"] for i, r in out.items() if r["status"] != "ok"} == {6: "limit outside 1..20", 7: "limit outside 1..20", 8: "no student_id"}
    assert R.recommend_batch(rdf, _posts(spark), with_rejects=False).count() == 8
    assert R.recommend_batch(rdf.limit(0), _posts(spark)).collect() == []


def test_kept_index_follows_changed_posts(spark, tmp_path):
    path = str(tmp_path / "index")
    cols = "id string, title string, summary string, body_markdown string, url string, published_at timestamp_ntz"
    post = lambda i, body, summary="sum": (str(i), f"title{i}", summary, body, "u", T0)
    before = spark.createDataFrame([post(i, f"old word{i}") for i in range(40)], cols)
    after = spark.createDataFrame([post(3, "fresh words"), post(4, "old word4", None), post(90, "fresh old")], cols)
    now = before.where("id not in (3, 4)").unionByName(after)
    R.build_index(before, path, 8)
    touched = R.update_index(path, after, 8)
    assert 1 <= len(touched) <= 3
    rows = lambda df: sorted(map(tuple, df.select("id", "token", "score", "published_at").collect()))
    assert rows(R.read_index(spark, path)) == rows(R.post_tokens(now))
    rdf = spark.createDataFrame([(1, "s", "fresh", 5), (2, "s", "old", 20), (3, "s", "word4", 5)], "request_id long, student_id string, query string, limit int")
    got = {r["request_id"]: [x["article_id"] for x in r["recommendations"]] for r in R.recommend_batch(rdf, now, index=R.read_index(spark, path)).collect()}
    assert got[1] == ["3", "90"] and len(got[2]) == 20 and got[3] == []


@pytest.mark.parametrize("max_bytes", [1 << 20, 100])
def test_vector_batch_matches_brute_force(spark, max_bytes):
    import math
    import random
    rnd = random.Random(5)
    posts = [(str(i), "s", [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    posts.append(("z", "s", [0.0, 0.0, 0.0, 0.0]))
    posts.append(("nosum", None, [1.0, 0.0, 0.0, 0.0]))
    pdf = spark.createDataFrame(posts, "id string, summary string, emb array<double>").repartition(3)
    queries = [(f"q{j}", [rnd.uniform(-1, 1) for _ in range(4)]) for j in range(5)]
    qdf = spark.createDataFrame(queries, "query_id string, query_vector array<double>")
    got = S.search_vector_batch(pdf, qdf, limit=3, max_bytes=max_bytes).collect()
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in got}

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return 0.0 if na == 0 or nb == 0 else sum(x * y for x, y in zip(a, b)) / (na * nb)

    want = {}
    for qid, qv in queries:
        ranked = sorted(((cos(v, qv), pid) for pid, s, v in posts if s is not None), key=lambda t: (-t[0], t[1]))[:3]
        for r, (sc, pid) in enumerate(ranked, 1):
            want[(qid, r)] = (pid, round(sc, 9))
    assert got == want


def test_backslash_is_an_ordinary_character(spark):
    from feedlake.functions.text import contains_ci
    df = spark.createDataFrame([("a\\b_c",), ("ab_c",), ("a\\bxc",)], "t string")
    assert [r.t for r in df.where(contains_ci("t", "A\\b")).collect()] == ["a\\b_c", "a\\bxc"]
    assert [r.t for r in df.where(contains_ci("t", F.lit("\\b_c"))).collect()] == ["a\\b_c", "a\\bxc"]


@pytest.mark.parametrize("max_bytes", [1 << 20, 40])
def test_vector_batch_with_unlike_lengths_and_nulls(spark, max_bytes):
    pdf = spark.createDataFrame([(str(i), "s", [float(i), 1.0, 0.0][:2 + i % 2]) for i in range(30)] + [("n", "s", None)], "id string, summary string, emb array<float>")
    qdf = spark.createDataFrame([("two", [1.0, 0.0]), ("three", [1.0, 0.0, 0.0]), ("seven", [1.0] * 7), ("none", None), ("two", [1.0, 0.0])], "query_id string, query_vector array<double>")
    rows = S.search_vector_batch(pdf, qdf, limit=4, max_bytes=max_bytes).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert sorted(got["two"]) == [(1, "28"), (2, "26"), (3, "24"), (4, "22")] and sorted(got["three"]) == [(1, "29"), (2, "27"), (3, "25"), (4, "23")]
    assert got["seven"] == got["none"] == [(None, None)]
    assert S.search_vector_batch(pdf.limit(0), qdf).count() == 4 and S.search_vector_batch(pdf, qdf.limit(0)).count() == 0


def test_recommend_similar_answers_by_vector(spark):
    """Equal queries are one; queries without a vector or with one of another length find nothing; the rest as in the text form."""
    posts = spark.createDataFrame(
        [(1, "a", "s", "u1", [1.0, 0.0]), (2, "b", "s", "u2", [0.0, 1.0]), (3, "c", "s", "u3", [1.0, 1.0]),
         (4, "d", None, "u4", [1.0, 0.0]), (5, "e", "s", "u5", None)],
        "id int, title string, summary string, url string, emb array<double>")
    known = spark.createDataFrame([("right", [1.0, 0.0]), ("up", [0.0, 2.0]), ("odd", [1.0]), ("none", None)], "query string, query_vector array<double>")
    requests = spark.createDataFrame(
        [(10, "s", "right", 2), (11, "s", "right", 1), (12, "t", "up", None), (13, "s", "odd", 3), (14, "s", "none", 3),
         (15, "s", "", 2), (16, "s", None, 20), (17, "s", "up", 21), (18, None, "up", 1)],
        "request_id int, student_id string, query string, limit int")
    out = R.recommend_similar(requests, posts, lambda df, text, vec: df.join(known, "query", "left"), seed=1)
    got = {r.request_id: r for r in out.collect()}
    ids = {k: [x.article_id for x in r.recommendations] for k, r in got.items()}
    assert ids[10] == ["1", "3"] and ids[11] == ["1"] and ids[12] == ["2", "3", "1"]
    assert ids[13] == ids[14] == ids[17] == ids[18] == []
    assert len(ids[15]) == 2 and sorted(ids[16]) == ["1", "2", "3", "5"] and ids[16][:2] == ids[15]
    assert got[12].recommendations[0].score == 1.0 and got[17].status != "ok" and got[13].status == "ok"
    none = R.recommend_similar(requests.limit(0), posts, lambda df, text, vec: df.join(known, "query", "left"))
    assert none.count() == 0
