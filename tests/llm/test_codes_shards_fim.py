"""Vector codes, sharding and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from feedlake.llm import fill_middle as M, sharding as S, ship, vector_codes as V


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- vector codes

def brute_codes(rows, entries=256, rounds=4):
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in kept], np.float64) * 1024).astype(np.int64)
    parts = np.split(x, 4, axis=1)
    books = [p[:entries].copy() for p in parts]

    def assign():
        out = []
        for p, b in zip(parts, books):
            d = ((p[:, None, :] - b[None]) ** 2).sum(axis=2)
            out.append((d.argmin(axis=1), d.min(axis=1)))
        return out
    for _ in range(rounds):
        for p, b, (k, _) in zip(parts, books, assign()):
            for e in set(k.tolist()):
                b[e] = p[k == e].sum(axis=0) // int((k == e).sum())
    got = assign()
    error = sum(d for _, d in got)
    sums = Counter()
    for r, e in zip(kept, error.tolist()):
        sums[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{int(k[i]):02x}" for k, _ in got), int(error[i]), sums[r[2]], digest) for i, r in enumerate(kept)), key=repr)


def vectors(spark, n=700, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(2)
    x[50:400] = x[50]                                                     # one vector is half of all
    rows = [(i, x[i].tolist(), int(rng.integers(0, 3)) if i % 7 else None, "extra", 1) for i in range(n)]
    rows += [(5000, None, 1, "e", 1), (5001, [], 1, "e", 1), (5002, [None] * dim, 1, "e", 1), (5003, [float("nan")] * dim, 1, "e", 1),
             (5004, [1.0] * (dim - 1) + [float("-inf")], 2, "e", 1), (None, [0.5] * dim, None, "e", 1), (3, [0.25] * dim, 2, "e", 1)]
    ship(spark)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)


@pytest.mark.parametrize("cell", [7, 32, 4000])
def test_codes_equal_brute_force(spark, cell):
    df = vectors(spark)
    assert rows_of(V.vector_codes(df, cell=cell)) == brute_codes([tuple(r)[:3] for r in df.collect()])


def test_codes_of_few_rows_and_none(spark):
    df = vectors(spark, n=60).where("vec_id < 20")
    assert rows_of(V.vector_codes(df)) == brute_codes([tuple(r)[:3] for r in df.collect()])
    assert V.vector_codes(df.limit(0)).collect() == []
    assert V.vector_codes(df.where("embedding is null")).collect() == []


def test_vectors_of_other_lengths_and_large_components(spark):
    make = lambda *v: spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    ship(spark)
    assert [r[0] for r in rows_of(V.vector_codes(make([1.0] * 4, [1.0] * 8, [2.0] * 4)))] == [0, 2]
    with pytest.raises(ValueError):
        V.vector_codes(make([1.0] * 5))
    with pytest.raises(ValueError):
        V.vector_codes(make([1e9] * 4))


def test_grid_remembers_and_prunes():
    rng = np.random.default_rng(1)
    book, parts = rng.integers(-300, 300, (256, 4)), rng.integers(-300, 300, (5000, 4))
    grid = V.Grid(book, 32, most=500)                                     # the memory is started afresh on the way
    want = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    for _ in range(2):
        index, distance = grid.nearest(parts)
        assert (index == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
    assert grid.evaluated < 0.2 * grid.asked and len(grid.keys) <= 500
    same = V.Grid(np.repeat(book[:3], 2, axis=0), 32)                     # ties go to the lower index
    assert set(same.nearest(parts)[0].tolist()) <= {0, 2, 4}


def test_decoded_codes_have_the_stated_error(spark):
    df = vectors(spark, n=300)
    books, length = V.train(df)
    out = V.decode(V.encode(df, books, length), books).join(df.select("vec_id", "embedding"), "vec_id").where("vec_id between 10 and 290").collect()
    for r in out:
        assert sum((int(np.floor(1024 * x)) - y) ** 2 for x, y in zip(r["embedding"], r["approximation"])) == r["error"]


# --- sharding

def test_grants_respect_room():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        wishes, room = rng.integers(0, 50, (n, n)), rng.integers(0, 10, n)
        moves = S.grant(wishes, room)
        assert (moves >= 0).all() and (moves <= wishes).all() and not moves.diagonal().any()
        assert (moves.sum(axis=0) - moves.sum(axis=1) <= room).all()
    assert S.grant(np.array([[0, 5], [3, 0]]), np.zeros(2, int)).tolist() == [[0, 3], [3, 0]]       # swaps need no room


def test_dense_ranks(spark):
    df = spark.range(3000).selectExpr("id", "id % 3 as k", "cast(id % 5 as int) as o")
    out = S.dense_ranks(df, ["k"], "id", 3000, [F.col("o")], "r").collect()
    for k in range(3):
        own = sorted((r["r"], r["o"]) for r in out if r["k"] == k)
        assert [r for r, _ in own] == list(range(1000)) and [o for _, o in own] == sorted(o for _, o in own)


def check_shards(docs, shards, **settings):
    out = S.shard_documents(docs, shards=shards, carry=["text"], **settings)
    rows = out.collect()
    n = docs.count()
    assert len(rows) == n
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    for r in rows:
        body = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 16, zlib.crc32(body), "rows", None)
    count = Counter(r["shard"] for r in rows)
    assert not rows or max(count.values()) - min(count[s] for s in range(shards)) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(count[s])) for s in range(shards))
    return rows, out


def test_copies_come_together_and_shards_stay_even(spark):
    ship(spark)
    rows = [(i, f"text {i}", "x", 3) for i in range(150)]
    rows += [(1000 + 10 * g + j, f"copy {g}", "x", 3) for g in range(40) for j in range(2 + g % 4)]
    rows += [(None, None, "x", 1), (7, "", None, 1), (8, None, "x", 1), (3, "text 3", "x", 2), (3, "text 3", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int").drop("shard", "slot").repartition(6)
    got, out = check_shards(docs, 7)
    links, cut = S.cut_links(out, F.coalesce("text", F.lit(""))).first()
    assert links > 100 and cut <= 0.02 * links


def test_group_of_a_third_of_all_rows_is_split_over_few_shards(spark):
    ship(spark)
    docs = spark.range(900).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id) end as text")
    got, out = check_shards(docs, 9)
    assert len({r["shard"] for r in got if r["text"] == "hot"}) == 3       # 300 rows, 100 to a shard


def test_only_linked_rows_swap_places(spark):
    ship(spark)
    docs = spark.range(400).selectExpr("id as doc_id", "concat('t', id div 4) as text")                # no free rows at all
    got, out = check_shards(docs, 5, rounds=8)
    links, cut = S.cut_links(out, F.col("text")).first()
    assert links == 600 and cut < 0.45 * links                              # dealt at random, 480 are cut


def test_fewer_rows_than_shards_and_none(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    check_shards(docs, 40)
    check_shards(docs.limit(0), 40)


def test_written_shards_hold_their_rows(spark, tmp_path):
    ship(spark)
    docs = spark.range(50).selectExpr("id as doc_id", "concat('t', id % 20) as text")
    out = S.shard_documents(docs, shards=4, carry=["text"])
    S.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).where("shard = 1").count() in (12, 13)


# --- fill in the middle

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_middle(doc_id, text):
    text = text or ""
    t = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
    form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(t), form, None if plain else len(p), None if plain else len(m), sha(out), sha(text)


def middle_docs(spark):
    ship(spark)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a <P> b c"), (5, "é" * 300 + " x " * 50 + " ü "), (None, "some words here to cut"), (6, " lead and trail \t"),
            (6, " lead and trail \t"), (7, "<S < P>M> <" * 20), (8, " nbsp em x"), (9, " " * 500 + "w" + "\t" * 300)]
    rows += [(100 + i, "wé" * i + "  <" * i) for i in range(60)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, form string, n int").repartition(3)


@pytest.mark.parametrize("frame_bytes", [1, 5, 64, M.FRAME_BYTES])
def test_middle_equals_brute_force(spark, frame_bytes):
    docs = middle_docs(spark)
    got = rows_of(M.digests(M.fill_in_middle(docs, frame_bytes=frame_bytes)))
    assert got == sorted((brute_middle(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert M.digests(M.fill_in_middle(docs.limit(0))).collect() == []


def test_frames_are_independent_and_only_cut_ones_are_opened(spark):
    text = " ".join(f"word{i}" for i in range(5000))
    ship(spark)
    row = M.store_frames(spark.createDataFrame([(1, text)], "doc_id long, text string"), 1000).first()
    assert len(row["frames"]) > 30 and row["units"][-1] == row["n"] == 5000 and row["chars"][-1] == len(text)
    opener = zstandard.ZstdDecompressor()
    assert b"".join(opener.decompress(f) for f in row["frames"]).decode() == text
    own = M.FrameText([bytes(f) for f in row["frames"]], row["units"], row["chars"], zstandard.ZstdCompressor(), opener)
    i, at, chars = own.place(2500)
    assert len(own.opened) == 1 and text[:chars] == " ".join(f"word{i}" for i in range(2500))
    piece = own.piece((0, 0, 0), (i, at, chars))
    assert piece[:i] == own.frames[:i] and len(own.opened) == 1


def test_restored_text_from_output_and_form_alone(spark):
    docs = middle_docs(spark)
    wanted = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = M.fill_in_middle(docs, frame_bytes=16).select("doc_id", "form", "frames").collect()
    assert Counter((r["doc_id"], b"".join(M.restored([bytes(f) for f in r["frames"]], r["form"])).decode()) for r in got) == wanted
