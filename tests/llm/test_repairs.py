"""Malformed markup, clashing columns, padding, components that need more rounds, frequent keys."""

import random
import time
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlake.llm import components, decontamination as D, html_extract as H, jaccard_join as J, packing, ship, suffix_dedup, url_filter


@pytest.mark.parametrize("page", [
    "<p>x</p><a " + " ".join(f'a{i}="v{i}"' for i in range(60)), "<a " * 350_000, "<script " * 130_000, "<! " * 300_000,
    '<a "' * 250_000, "<a '\"" * 200_000 + ">", "<div>" * 20_000 + "</x>" * 20_000])
def test_cut_off_markup_takes_linear_time(page):
    start = time.time()
    H.extract(page)
    assert time.time() - start < 5


@pytest.mark.parametrize("page, text", [
    ("<article><header><h1>Head</h1><p>by</p></header><p>body</p></article>", "Head\n\nbody"),
    ('<article><p class="search-engine">a</p><p class="social-history">b</p><p class="notice">gone</p></article>', "a\n\nb"),
    ("<article><p>if x<y then z</p></article>", "if x<y then z"),
    ("<header><h1>Site</h1></header><article><p>a</p></article>", "a"),
    ('<article><p>a</p></article><a href="x', "a"),
    ('<div class="search-engine">menu</div><article><p>a</p></article>', "a")])
def test_article_text_is_kept(page, text):
    assert H.extract(page) == text


def test_captures_with_clashing_columns(spark):
    rows = [(1, "http://a.example/x", "2024-05-01 00:00:00", "mine", 5, "k")]
    captures = spark.createDataFrame(rows, "page_id long, url string, t string, verdict string, m int, kind string").withColumn("fetched_at", F.to_timestamp("t"))
    entries = spark.createDataFrame([("host", "a.example", "block", "2024-01-01 00:00:00")], "kind string, value string, action string, t string")
    out = url_filter.filter_urls(captures, entries.withColumn("listed_at", F.to_timestamp("t")).drop("t"))
    row = out.first().asDict()
    assert out.columns.count("verdict") == 1 and row["verdict"] == "block" and row["m"] == 5 and row["kind"] == "k"


def test_lengths_that_cannot_be_sorted_raise(spark):
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(spark.createDataFrame([(1, "x")], "doc_id long, text string"), length=65)


def test_packing_assigns_every_piece_with_little_padding_whatever_the_setting(spark):
    ship(spark)
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(0, 900)))) for i in range(400)],
                                 "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        pieces = packing.pack(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tokens, places = Counter(), defaultdict(list)
    for r in pieces:
        tokens[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert all(tokens[r.doc_id] == r.doc_tokens for r in pieces) and set(tokens) == set(range(400))
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= packing.CAPACITY
    assert len(places) <= 1.03 * sum(tokens.values()) / packing.CAPACITY + 1


def test_components_carry_on_and_raise_when_unfinished(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        components.connected_components(chain, max_rounds=1)
    first = components.connected_components(chain.where("a % 2 = 0"))
    whole = components.connected_components(chain.where("a % 2 = 1"), known=first)
    assert {(r.node, r.component) for r in whole.collect()} == {(i, 0) for i in range(201)}


def test_frequent_keys_stay_though_their_bucket_has_one_document():
    table = lambda kind, *docs: {"keys": np.full(len(docs), 9, np.uint64), "checks": np.zeros(len(docs), np.uint64), "docs": np.array(docs, np.int64),
                                 "sizes": np.full(len(docs), 20, np.int32), "kinds": np.full(len(docs), kind, np.int8)}
    run = lambda t: J._shared_keys(pa.table({k: pa.array([v.tobytes()], pa.binary()) for k, v in t.items()})).to_pylist()
    assert run(table(J.LISTED, 4)) == [] and run(table(J.LISTED, 4, 4)) == []
    assert [r["doc"] for r in run(table(J.LISTED, 4, 5))] == [4, 5]
    assert run(table(J.LISTED | J.OFTEN, 4)) == [{"key": 9, "check": 0, "doc": 4, "size": 20, "kind": J.LISTED}]
    assert run(table(J.SAME | J.OFTEN, 4, 4))[0]["kind"] == J.SAME and len(run(table(J.SAME | J.OFTEN, 4, 4))) == 1


def test_representatives_with_maps(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b c d e f g", {"x": 1}), (1, "a b c d e f g", {"x": 2}), (2, "a b c d e f g", None)], "doc_id long, text string, m map<string,int>")
    assert [r.doc_id for r in J.keep_one_per_component(docs).collect()] == [1]


def test_decontamination_in_slices(spark, monkeypatch):
    """Each slice is written and freed before the next one; the passages and the kept rows are those of one pass."""
    item = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    bench = spark.createDataFrame([(i, item(i)) for i in range(6)] + [(9, None)], "item_id long, text string")
    rows = [(i, f"head {item(i)} tail {item(i + 1) if i % 2 else ''}") for i in range(5)] + [(7, "clean words"), (8, None), (None, item(2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, D.find_leaks(docs, bench).collect()), key=str)
    kept = sorted(map(tuple, D.drop_leaking(docs, bench).collect()), key=str)
    assert {r[:2] for r in whole} >= {(i, i) for i in range(5)} | {(None, 2)} and kept == sorted([(7, "clean words"), (8, None)], key=str)
    monkeypatch.setattr(D, "slices", partial(D.slices, limit=100))
    assert len(list(D.slices(bench))) > 2
    assert sorted(map(tuple, D.find_leaks(docs, bench).collect()), key=str) == whole
    assert sorted(map(tuple, D.drop_leaking(docs, bench).collect()), key=str) == kept


def test_suffix_blocks_follow_the_texts_size(spark, monkeypatch):
    """More blocks than shuffle partitions, rows that repeat an id in several of them: the same result."""
    rng = random.Random(6)
    shared = ["".join(rng.choice("abcd ") for _ in range(90)) for _ in range(4)]
    rows = [(i // 2, rng.choice(shared) + "".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + rng.choice(shared)) for i in range(60)]
    rows += [(3, None), (None, shared[0]), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, suffix_dedup.suffix_dedup(docs, groups=1).collect()), key=str)
    assert sum(r[2] for r in one) > 0
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 200)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 500)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect()), key=str) == one
