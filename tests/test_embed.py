import math


from feedlake.operators.embed import enrich, hashing_embedder, pandas_embedder


def test_hashing_embedder_is_unit_norm(spark):
    df = spark.createDataFrame([("1", "a b c"), ("2", None)], "id string, t string")
    out = {r["id"]: r["e"] for r in hashing_embedder(dim=16)(df, "t", "e").collect()}
    assert len(out["1"]) == 16 and math.isclose(sum(x * x for x in out["1"]), 1.0, rel_tol=1e-5)
    assert out["2"] is None


def test_model_plugs_in_through_a_pandas_udf(spark):
    def fake_model(texts):
        return [[float(len(t)), 1.0] for t in texts]
    df = spark.createDataFrame([("1", "abc"), ("2", "hello")], "id string, t string")
    out = {r["id"]: r["e"] for r in pandas_embedder(fake_model, dim=2)(df, "t", "e").collect()}
    assert out == {"1": [3.0, 1.0], "2": [5.0, 1.0]}


def test_enrich_adds_summary_and_embedding(spark):
    df = spark.createDataFrame([("T", "x" * 300)], "title string, body_markdown string")
    r = enrich(df, embedder=hashing_embedder(dim=8)).first()
    assert r["summary"] == "x" * 200 + "..." and len(r["emb"]) == 8


def test_enrich_embeds_the_whole_body(spark):
    df = spark.createDataFrame([("T", "a " * 600 + "end"), ("T", "a " * 600 + "other")], "title string, body_markdown string")
    whole = [r["emb"] for r in enrich(df).collect()]
    cut = [r["emb"] for r in enrich(df, embed_chars=1000).collect()]
    assert whole[0] != whole[1] and cut[0] == cut[1]
