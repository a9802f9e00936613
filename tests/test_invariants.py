"""Invariants from the test strategy: properties that must hold for any input."""

import datetime as dt
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedlake.operators import articles as A
from feedlake.operators import chunks as C
from feedlake.operators import search as S

TEXT = st.text(alphabet="ab cdé\nxy", min_size=0, max_size=2600)


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=4))
def test_chunks_without_overlap_rebuild_the_text(spark, texts):
    """Unfiltered window chunks, each cut to its first `step` characters, rebuild the whole text."""
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = C.window_chunks(df, "text", min_len=-1).collect()
    by_k = {}
    for r in out:
        by_k.setdefault(r["k"], []).append((r["chunk_index"], r["chunk_text"]))
    for k, t in enumerate(texts):
        pieces = [c[:800] for _, c in sorted(by_k.get(k, []))]
        assert "".join(pieces) == t


@settings(max_examples=10, deadline=None)
@given(query=st.text(alphabet="ab_%", min_size=1, max_size=3))
def test_literal_search_is_within_wildcard_search(spark, query):
    posts = [("1", "a_b", "s", "b%a", dt.datetime(2024, 1, 1)), ("2", "aab", "ba", "x", None),
             ("3", "zz", "s", "ab%_", dt.datetime(2024, 1, 2))]
    p = spark.createDataFrame(posts, "id string, title string, summary string, body_markdown string, "
                                     "published_at timestamp_ntz").withColumn("url", F.lit("u")).withColumn(
        "tags", F.array(F.lit("t")))
    lit_ids = {r["id"] for r in S.search_text(p, query, limit=20, wildcards=False).collect()}
    wild_ids = {r["id"] for r in S.search_text(p, query, limit=20, wildcards=True).collect()}
    assert lit_ids <= wild_ids


def test_flatten_of_aggregated_entries_gives_the_entries(spark):
    entries = [{"id": f"e{i}", "title": f"t{i}", "url": f"u{i}", "published_at": "2024-01-01T00:00:00",
                "body": "b" * i} for i in range(7)]
    feeds = [(f"r{j}", "src", dt.datetime(2024, 1, 1), json.dumps(entries[j::3])) for j in range(3)]
    raw = spark.createDataFrame(feeds, "id string, source_url string, fetched_at timestamp_ntz, s string")
    raw = raw.select("id", "source_url", "fetched_at", F.parse_json("s").alias("raw_data"))
    got = sorted((r["article_id"], r["title"], r["url"], r["body"]) for r in A.article_view(raw).collect())
    assert got == sorted((e["id"], e["title"], e["url"], e["body"]) for e in entries)
