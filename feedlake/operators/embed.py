"""Embedding and summary plug-in points.

The reference calls hosted models inside SQL. Here a model is a function
``(df, text_col, out_col) -> df``. The built-in embedder is MLlib's
tokenizer, feature hashing into ``dim`` buckets and an L2 normalisation,
all JVM-side; a real model plugs in through ``pandas_embedder``, an
iterator pandas UDF that loads the model once per task and embeds Arrow
batches. Values of the default are not comparable with any model's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.operators.articles import embed_input, summary_trunc
from feedlake.session import materialize

EMBED_DIM = 768                    # fixed value: dimension of the reference's embedding
DEFAULT_MODEL = "text-embedding-3-small"   # fixed value: default model_name of the embeddings table

Embedder = Callable[[DataFrame, str, str], DataFrame]


def hashing_embedder(dim: int = EMBED_DIM) -> Embedder:
    """E1 default: RegexTokenizer -> HashingTF(dim) -> L2 Normalizer, as array<float>."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    def embed(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        tmp = "__tok", "__tf", "__vec"
        tok = RegexTokenizer(inputCol=text_col, outputCol=tmp[0], pattern=r"\W+", minTokenLength=1)
        tf = HashingTF(inputCol=tmp[0], outputCol=tmp[1], numFeatures=dim)
        norm = Normalizer(inputCol=tmp[1], outputCol=tmp[2], p=2.0)
        safe = df.withColumn(text_col + "__in", F.coalesce(F.col(text_col), F.lit("")))
        tok.setInputCol(text_col + "__in")
        out = norm.transform(tf.transform(tok.transform(safe)))
        vec = F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(
            vector_to_array(F.col(tmp[2]), "float32"))
        return out.withColumn(out_col, vec).drop(*tmp, text_col + "__in")

    return embed


def pandas_embedder(model_fn: Callable, dim: int = EMBED_DIM) -> Embedder:
    """E1 with a real model: ``model_fn(list[str]) -> list[list[float]]`` runs per Arrow batch.

    An iterator pandas UDF: a task gets its batches as one iterator, so a model
    loaded inside ``model_fn``'s closure is set up once per task, not per row.
    A vector that has not ``dim`` components is an error.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            vecs = model_fn(texts)
            if any(len(v) != dim for v in vecs):
                raise ValueError(f"the model's vectors must have {dim} components")
            yield pd.Series([list(map(float, v)) for v in vecs])

    def embed(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        return df.withColumn(out_col, _embed(F.col(text_col)))

    return embed


def default_summarizer(title: Column, body: Column) -> Column:
    """E3 default: the truncation summary (P11); a model would take ``summary_prompt``."""
    return summary_trunc(body)


def enrich(df: DataFrame, embedder: Embedder | None = None,
           summarizer: Callable[[Column, Column], Column] | None = None,
           title: str = "title", body: str = "body_markdown", embed_chars: int | None = None) -> DataFrame:
    """E1 + E3 on an article frame: adds ``summary`` and ``emb`` (of the whole body, or its first ``embed_chars``)."""
    embedder = embedder or hashing_embedder()
    summarizer = summarizer or default_summarizer
    df = df.withColumn("summary", summarizer(F.col(title), F.col(body)))
    df = df.withColumn("__embed_in", embed_input(F.col(title), F.col(body), embed_chars))
    return embedder(df, "__embed_in", "emb").drop("__embed_in")


def embed_backlog(chunks: DataFrame, vectors: DataFrame, embedder: Embedder | None = None,
                  model_name: str = DEFAULT_MODEL, as_of: Column | None = None) -> DataFrame:
    """E2 + J12: embed the chunks that have no vector yet, as rows to append.

    The backlog is a left anti join, so only new chunks reach the model.
    """
    from feedlake.functions.text import md5_key
    embedder = embedder or hashing_embedder()
    todo = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    out = embedder(todo.select("chunk_id", "chunk_text"), "chunk_text", "embedding_vector")
    created = as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
    return out.select(md5_key(F.lit("emb"), F.col("chunk_id")).alias("embedding_id"), "chunk_id",
                      "embedding_vector", F.lit(model_name).alias("model_name"), created.alias("created_at"))


# ------------------------------------------------------------ E2 by content

TEXT_HASH = "text_hash"
STATUSES = ("kept", "replaced", "new", "gone")


def vector_status(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """What a refresh does with each chunk id: (chunk_id, status, chunk_text of those to embed).

    A vector belongs to a text: it is ``kept`` while its ``text_hash`` (md5)
    is that of the chunk, else ``replaced``; a chunk without vector is ``new``,
    a vector without chunk ``gone``. A vector without a hash counts as
    replaced. Of an id that occurs several times on one side, one chunk (the
    least text) and one vector (the least hash) count; NULL ids are left out.
    """
    c = (chunks.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min("chunk_text").alias("chunk_text"))
         .withColumn("__now", F.md5(F.coalesce("chunk_text", F.lit("")))).withColumn("__c", F.lit(True)))
    v = (vectors.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min(TEXT_HASH).alias("__then"))
         .withColumn("__v", F.lit(True)))
    j = c.join(v, "chunk_id", "full_outer")
    status = (F.when(F.col("__c").isNull(), "gone").when(F.col("__v").isNull(), "new")
              .when(F.col("__now").eqNullSafe(F.col("__then")), "kept").otherwise("replaced"))
    return j.select("chunk_id", status.alias("status"), "chunk_text", F.col("__now").alias(TEXT_HASH))


def refresh_vectors(chunks: DataFrame, vectors: DataFrame, embedder: Embedder | None = None,
                    model_name: str = DEFAULT_MODEL, as_of: Column | None = None) -> DataFrame:
    """The vector table after a refresh by content; only new and changed texts reach the model.

    ``vectors`` has embedding_id, chunk_id, embedding_vector, model_name,
    created_at and text_hash, and so has the result. Running it again on its
    own result embeds nothing. Write it with ``tables.overwrite``, which
    keeps the old table until the new one is whole.
    """
    from feedlake.functions.text import md5_key
    embedder = embedder or hashing_embedder()
    columns = ["embedding_id", "chunk_id", "embedding_vector", "model_name", "created_at", TEXT_HASH]
    todo_text = F.when(F.col("status").isin("new", "replaced"), F.col("chunk_text"))
    status = materialize(vector_status(chunks, vectors).withColumn("chunk_text", todo_text), "vector-status")   # read twice
    # a kept id has one hash, so the join's partitioning serves the second step, too
    kept = vectors.join(status.where(F.col("status") == "kept").select("chunk_id", TEXT_HASH),
                        ["chunk_id", TEXT_HASH], "left_semi").dropDuplicates(["chunk_id", TEXT_HASH])
    todo = status.where(F.col("status").isin("new", "replaced")).select("chunk_id", "chunk_text", TEXT_HASH)
    created = as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
    made = embedder(todo, "chunk_text", "embedding_vector").select(
        md5_key(F.lit("emb"), F.col("chunk_id"), F.col(TEXT_HASH)).alias("embedding_id"), "chunk_id",
        "embedding_vector", F.lit(model_name).alias("model_name"), created.alias("created_at"), TEXT_HASH)
    return kept.select(*columns).unionByName(made.select(*columns))
