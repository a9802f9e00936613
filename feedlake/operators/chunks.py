"""Chunking of article text.

All chunkers are per-row generators (a projection plus ``explode``), so they
run map-side in the stage that reads the posts, with no shuffle. The
reference's recursive CTE becomes a closed form: chunk k starts at character
``k * step + 1`` and exists while ``k * step < length`` (chunk 0 always).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import md5_key

# Fixed values of the reference's chunkers.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
CHUNK_MIN = 50            # window chunks longer than 50 characters are kept
PARAGRAPH_SEP = "\n\n"
PARAGRAPH_MIN = 100       # C3: trimmed paragraphs longer than 100 characters
LOOSE_MIN = 50            # C4: trimmed length longer than 50, untrimmed text kept
TITLE_SEP = "\n\n"
LABEL_TITLE = "【タイトル】"
LABEL_BODY = "【内容】"
LABEL_URL = "【URL】"


def chunk_key(article_id: Column, chunk_index: Column) -> Column:
    """Reproducible chunk id in place of UUID_STRING()."""
    return md5_key(article_id, chunk_index)


def _check(size: int, overlap: int) -> int:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("chunking needs 0 <= overlap < size (the recursion would not end)")
    return size - overlap


def _closed_form_array(t: Column, step: int, size: int) -> Column:
    n = F.greatest(F.lit(0), F.ceil(F.length(t) / F.lit(step)) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.substring(t, k * step + 1, F.lit(size)))


def _linear_array(t: Column, step: int, size: int) -> Column:
    """A chunk is its own step and the beginning of the steps that follow.

    The steps are handed to one lambda, since inside it an expression is computed again for every chunk."""
    m = -(-size // step)
    steps = F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % step), 0)
    return F.flatten(F.transform(F.array(steps), lambda pieces: _joined_steps(pieces, m, step, size)))


def _joined_steps(pieces: Column, m: int, step: int, size: int) -> Column:
    if m == 2:
        return F.transform(pieces, lambda p, i: F.concat(p, F.left(F.coalesce(F.get(pieces, i + 1), F.lit("")), F.lit(size - step))))
    return F.transform(pieces, lambda p, i: F.left(F.array_join(F.slice(pieces, i + 1, F.lit(m)), ""),
                                                    F.lit(size)))


def window_chunks(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                  min_len: int = CHUNK_MIN, long_text: int = -1) -> DataFrame:
    """C1 (SPLIT_TEXT_TO_CHUNKS): fixed windows of ``size`` characters every ``size - overlap``.

    Adds ``chunk_index`` and ``chunk_text``; pieces of ``min_len`` characters
    or fewer are dropped. One pass: each row's chunks are built as one array,
    then exploded, so the text is never copied into every chunk row and the
    input is read once. Texts are cut by one linear regex pass, whatever their
    length: ``substring`` by character position rescans the UTF-8 text from its
    start. Texts of at most ``long_text`` characters (by default none) take the
    closed form of the recursion instead. Both give the same chunks.
    """
    step = _check(size, overlap)
    t = F.col(text)
    arr = F.when(F.length(t) <= long_text, _closed_form_array(t, step, size)).otherwise(
        _linear_array(t, step, size))
    out = df.select("*", F.posexplode(arr).alias("chunk_index", "chunk_text"))
    return out.where(F.col("chunk_text").isNotNull() & (F.length("chunk_text") > min_len))


def window_chunks_linear(df: DataFrame, text: str, size: int = CHUNK_SIZE,
                         overlap: int = CHUNK_OVERLAP, min_len: int = CHUNK_MIN) -> DataFrame:
    """C1 in one linear pass for every row."""
    return window_chunks(df, text, size, overlap, min_len)


def window_chunks_closed_form(df: DataFrame, text: str, size: int = CHUNK_SIZE,
                              overlap: int = CHUNK_OVERLAP, min_len: int = CHUNK_MIN) -> DataFrame:
    """The same chunks as a lateral call of ``sequence`` + ``substring`` per row.

    The pieces are built before the explode, so the text itself is not copied into every chunk row."""
    arr = _closed_form_array(F.col(text), _check(size, overlap), size)
    out = df.select("*", F.posexplode(arr).alias("chunk_index", "chunk_text"))
    return out.where(F.col("chunk_text").isNotNull() & (F.length("chunk_text") > min_len))


def chunk_steps(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The rows the recursive generator visits (before the length filter)."""
    step = _check(size, overlap)
    n = F.greatest(F.lit(0), F.ceil(F.length(text) / F.lit(step)) - 1)
    out = df.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    return out.select("*", (F.col("chunk_index") * step + 1).alias("start_pos"),
                      ((F.col("chunk_index") + 1) * step).alias("next_pos"),
                      F.length(text).alias("text_length"))


def _chunk_table(df: DataFrame, as_of: Column | None) -> DataFrame:
    created = as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
    return df.select(chunk_key(F.col("article_id"), F.col("chunk_index")).alias("chunk_id"),
                     "article_id", "article_url", F.col("chunk_index").cast("int").alias("chunk_index"),
                     "chunk_text", F.length("chunk_text").cast("int").alias("chunk_length"),
                     created.alias("created_at"))


def post_chunks(posts: DataFrame, as_of: Column | None = None, body: str = "body_markdown",
                size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, min_len: int = CHUNK_MIN) -> DataFrame:
    """C2 (CREATE_ARTICLE_CHUNKS): window chunks of title + blank line + body.

    A NULL title or body gives no chunks (CONCAT propagates NULL).
    """
    p = posts.select(F.col("id").alias("article_id"), F.col("url").alias("article_url"),
                     F.concat(F.col("title"), F.lit(TITLE_SEP), F.col(body)).alias("__text"))
    return _chunk_table(window_chunks(p, "__text", size, overlap, min_len), as_of)


def _split_literal(text: Column, sep: str) -> Column:
    return F.split(text, F.lit("\\Q" + sep + "\\E"), -1)


def paragraph_chunks(posts: DataFrame, sep: str = PARAGRAPH_SEP, min_len: int = PARAGRAPH_MIN,
                     trim_output: bool = True, as_of: Column | None = None,
                     body: str = "body_markdown") -> DataFrame:
    """C3 (``trim_output=True``, > 100) and C4 (``trim_output=False``, > 50).

    J8: SPLIT_TO_TABLE is ``posexplode(split)`` with the separator quoted as a
    literal. Paragraphs whose trimmed length exceeds ``min_len`` are kept. The
    index is the paragraph's position in its article (the warehouse's SEQ4()
    gives no order guarantee).
    """
    p = posts.select(F.col("id").alias("article_id"), F.col("url").alias("article_url"),
                     F.posexplode(_split_literal(F.col(body), sep)).alias("chunk_index", "__v"))
    p = p.where(F.length(F.trim("__v")) > min_len)
    txt = F.trim("__v") if trim_output else F.col("__v")
    return _chunk_table(p.withColumn("chunk_text", txt), as_of)


def split_lateral(posts: DataFrame, sep: str = PARAGRAPH_SEP, body: str = "body_markdown") -> DataFrame:
    """J8 alone: every piece of the body split on a literal separator, with its position."""
    return posts.select("id", F.posexplode(_split_literal(F.col(body), sep)).alias("pos", "value"))


def labelled_chunks(posts: DataFrame, as_of: Column | None = None, body: str = "body_markdown") -> DataFrame:
    """One labelled chunk per article; length is that of title || body, as in the reference."""
    created = as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
    text = F.concat(F.lit(LABEL_TITLE), F.col("title"), F.lit("\n\n"), F.lit(LABEL_BODY), F.col(body),
                    F.lit("\n\n"), F.lit(LABEL_URL), F.col("url"))
    return posts.select(chunk_key(F.col("id"), F.lit(1)).alias("chunk_id"), F.col("id").alias("article_id"),
                        F.col("url").alias("article_url"), F.lit(1).alias("chunk_index"),
                        text.alias("chunk_text"),
                        F.length(F.concat(F.col("title"), F.col(body))).cast("int").alias("chunk_length"),
                        created.alias("created_at"))
