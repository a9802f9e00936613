import pytest
from pyspark.sql import functions as F

from feedlake.operators import chunks as C


def brute_window(text, size=1000, overlap=200, min_len=50):
    """The reference's recursion, literally."""
    if text is None:
        return []
    out, idx, nxt = [], 0, size - overlap
    out.append((0, text[:size]))
    while nxt < len(text):
        idx += 1
        out.append((idx, text[nxt:nxt + size]))
        nxt += size - overlap
    return [(i, t) for i, t in out if t is not None and len(t) > min_len]


LENGTHS = [0, 50, 51, 800, 801, 1000, 1001, 1600, 1601, 5003]


def _texts():
    alphabet = "abcdéfghij\nklmnöp qrstu"
    return [(n, "".join(alphabet[(i * 7 + n) % len(alphabet)] for i in range(n))) for n in LENGTHS]


@pytest.mark.parametrize("impl", ["auto", "linear", "closed", "long_threshold"])
def test_window_chunks_match_recursion(spark, impl):
    df = spark.createDataFrame(_texts(), "n int, text string")
    if impl == "auto":
        out = C.window_chunks(df, "text")
    elif impl == "linear":
        out = C.window_chunks_linear(df, "text")
    elif impl == "closed":
        out = C.window_chunks_closed_form(df, "text")
    else:
        out = C.window_chunks(df, "text", long_text=900)
    got = sorted((r["n"], r["chunk_index"], r["chunk_text"]) for r in out.collect())
    want = sorted((n, i, t) for n, text in _texts() for i, t in brute_window(text))
    assert got == want


def test_overlap_must_be_smaller_than_size(spark):
    df = spark.createDataFrame([("x" * 10,)], "text string")
    with pytest.raises(ValueError):
        C.window_chunks(df, "text", size=100, overlap=100)


def test_post_chunks_null_title_gives_none(spark):
    posts = spark.createDataFrame([("1", None, "u1", "b" * 300), ("2", "t", "u2", "b" * 300)],
                                  "id string, title string, url string, body_markdown string")
    got = C.post_chunks(posts).select("article_id").distinct().collect()
    assert [r[0] for r in got] == ["2"]


def test_paragraphs_trim_and_positions(spark):
    body = "short\n\n" + " " * 3 + "p" * 120 + "  \n\n\n\n" + "q" * 60
    posts = spark.createDataFrame([("1", "u", body)], "id string, url string, body_markdown string")
    c3 = C.paragraph_chunks(posts).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["chunk_length"]) for r in c3] == [(1, 120)]
    c4 = C.paragraph_chunks(posts, min_len=50, trim_output=False).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["chunk_length"]) for r in c4] == [(1, 125), (3, 60)]


def test_separator_only_and_literal_separator(spark):
    posts = spark.createDataFrame([("1", "u", "\n\n"), ("2", "u2", "a.b" * 40 + "." + "c" * 120)],
                                  "id string, url string, body_markdown string")
    assert C.paragraph_chunks(posts).count() == 1          # '.' is not a regex here
    pieces = C.split_lateral(posts.where(F.col("id") == "1")).collect()
    assert [(r["pos"], r["value"]) for r in pieces] == [(0, ""), (1, "")]


def test_labelled_chunk_length_is_title_plus_body(spark):
    posts = spark.createDataFrame([("1", "T", "https://x", "body")], "id string, title string, url string, body_markdown string")
    r = C.labelled_chunks(posts).collect()[0]
    assert r["chunk_length"] == 5 and r["chunk_index"] == 1
    assert r["chunk_text"] == "【タイトル】T\n\n【内容】body\n\n【URL】https://x"
