"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Unigrams and bigrams of words are hashed to ``buckets`` cells. The raw multinomial counts
every document of the corpus; the target multinomial counts the documents that ``labels``
marks as good (a bounded sample of at most ``max_labels`` labelled rows, chosen by the hash
of their id). A document's score is the mean, over its n-grams, of
``log p_target(cell) - log p_raw(cell)``; it is kept if the score reaches the threshold.
The threshold is fitted on the same bounded sample: midway between ``allowed_loss`` of the
good rows and the median of the bad ones, never above the ``allowed_loss`` quantile of the
good rows. Base rules reject documents of fewer than 10 words, or with more than 20 % of
their words in repeated 5-word windows.

Edge cases: a null or wordless text has all counts 0, score 0 and fails the base rule.
Repeated ids are scored row by row. Without good labels every score is 0 and only base
rules reject; without bad labels the ``allowed_loss`` quantile of the good rows decides.
Labels with null columns are ignored. Extra columns of ``documents`` pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from feedlake.llm import textops as X

BUCKETS = 1 << 14
MAX_LABELS = 20_000
ALLOWED_LOSS = 0.005
SMOOTHING = 1.0

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_SALT = np.uint64(0x51ED270B0B5C4D21)

STATS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType())])


def _cells(words: X.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cell and document of every unigram and bigram."""
    at, pairs = words.windows(2)
    h = np.concatenate([X.mix(words.hashes ^ _SALT), pairs])
    return (h % np.uint64(buckets)).astype(np.int64), np.concatenate([words.doc, words.doc[at]])


def _base(data: np.ndarray, offs: np.ndarray, words: X.Words) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    out = {"n_words": words.counts.astype(np.int64),
           "word_chars": X.per_doc_sum(words.inside & ((data & 0xC0) != 0x80), offs),
           "n_symbols": X.per_doc_sum(_SYMBOL[data], offs)}
    # lines: cut at \n and at document ends
    cut = np.union1d(offs, np.flatnonzero(data == 10) + 1)
    starts, ends = cut[:-1], cut[1:].copy()
    if len(starts):
        ends -= data[ends - 1] == 10
        worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
        starts, ends = starts[worded], ends[worded]
    doc = np.searchsorted(offs, starts, "right") - 1
    lines = np.bincount(doc, minlength=n)
    if len(starts):
        key = X.range_hashes(data, starts, ends)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        lines = lines - np.bincount(doc[new], minlength=n)
    out["n_dup_lines"] = lines.astype(np.int64)
    # words covered by a 5-word window that occurs twice or more in its document
    at, h = words.windows(5)
    cover = np.zeros(len(words.hashes) + 6, np.int32)
    if len(at):
        key = X.mix(h + words.doc[at].astype(np.uint64) * _SALT)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.r_[same, False] | np.r_[False, same]]]
        cover[:len(words.hashes) + 1] += np.bincount(twice, minlength=len(words.hashes) + 1).astype(np.int32)
        cover[5:len(words.hashes) + 6] -= np.bincount(twice, minlength=len(words.hashes) + 1).astype(np.int32)
    inside = np.cumsum(cover)[:len(words.hashes)] > 0
    out["n_repeat_words"] = np.bincount(words.doc[inside], minlength=n).astype(np.int64)
    return out


def _scores(words: X.Words, weights: np.ndarray, n: int) -> np.ndarray:
    cell, doc = _cells(words, len(weights))
    total = np.bincount(doc, weights=weights[cell], minlength=n)
    return total / np.maximum(np.bincount(doc, minlength=n), 1)


def _score_column(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    data, offs = X.utf8(column)
    parts = [_scores(X.Words(d, o), weights, b - a) for a, b, d, o in X.chunks(data, offs)]
    return np.concatenate(parts) if parts else np.empty(0)


def labelled_sample(labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the good and of the bad rows among at most ``max_labels`` labelled rows."""
    rows = (labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).collect())
    good = [r.doc_id for r in rows if r.quality == 1]
    return np.array(sorted(good), np.int64), np.array(sorted({r.doc_id for r in rows} - set(good)), np.int64)


def cell_counts(docs: DataFrame, good: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts per hashed cell: of all documents, and of those whose id is in ``good``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            ids = batch.column(0)
            known = np.isin(ids.fill_null(0).to_numpy(), good) & ~ids.is_null().to_numpy(zero_copy_only=False)
            data, offs = X.utf8(batch.column(1))
            for a, b, d, o in X.chunks(data, offs):
                cell, doc = _cells(X.Words(d, o), buckets)
                total += np.bincount(cell, minlength=buckets)
                target += np.bincount(cell[known[a:b][doc]], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(target[at])],
                                         names=["cell", "raw", "target"])

    rows = (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(X.lean(count), "cell int, raw long, target long")
            .groupBy("cell").agg(F.sum("raw"), F.sum("target")).collect())          # at most ``buckets`` rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for cell, a, b in rows:
        raw[cell], target[cell] = a, b
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log p_target - log p_raw per cell; zeros if either side is empty.

    Both multinomials are smoothed towards the raw one, so an n-gram that the small target
    never shows costs no more than its rarity in the corpus justifies."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    p = (raw + SMOOTHING) / (raw + SMOOTHING).sum()
    # as many pseudo-counts as there are cells, dealt out like the raw corpus
    q = (target + SMOOTHING * len(raw) * p) / (target.sum() + SMOOTHING * len(raw))
    return np.log(q) - np.log(p)


def fit_threshold(docs: DataFrame, good: np.ndarray, bad: np.ndarray, weights: np.ndarray,
                  allowed_loss: float = ALLOWED_LOSS) -> float:
    """Threshold from the scores of the (bounded) labelled rows."""
    if not len(good) or not weights.any():
        return -np.inf
    wanted = docs.sparkSession.createDataFrame([(int(x),) for x in np.r_[good, bad]], "doc_id long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_score_column(batch.column(1), weights))],
                                             names=["doc_id", "score"])

    # ``wanted`` holds at most max_labels ids
    rows = (docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(wanted), "doc_id", "left_semi")
            .mapInArrow(X.lean(score), "doc_id long, score double").groupBy("doc_id").agg(F.min("score")).collect())
    score_of = dict(rows)
    of = lambda ids: np.array([score_of[i] for i in ids.tolist() if i in score_of])
    fine, junk = of(good), of(bad)
    if not len(fine):
        return -np.inf
    top = float(np.quantile(fine, allowed_loss))
    if not len(junk):
        return top
    # a clear gap leaves clean documents some room: never above the quantile, midway to the junk
    middle = float(np.median(junk))
    return top if middle >= top else (top + middle) / 2


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_labels: int = MAX_LABELS,
        allowed_loss: float = ALLOWED_LOSS) -> tuple[np.ndarray, float]:
    """Weights per cell and the threshold."""
    good, bad = labelled_sample(labels, max_labels)
    weights = log_ratios(*cell_counts(docs, good, buckets))
    return weights, fit_threshold(docs, good, bad, weights, allowed_loss)


def score_documents(docs: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """doc_id, base statistics, score, base_failed and kept for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, score = _measure(batch.column(1), weights)
            failed = _fails(cols)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(cols[f.name]) for f in STATS), pa.array(score), pa.array(failed),
                 pa.array(~failed & (score >= threshold))],
                names=["doc_id", *STATS.names, "score", "base_failed", "kept"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *STATS.fields,
                           T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()),
                           T.StructField("kept", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(X.lean(run), schema)


def keep_documents(docs: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, score = _measure(batch.column(at), weights)
            yield batch.filter(pa.array(~_fails(cols) & (score >= threshold)))

    return docs.mapInArrow(X.lean(run), docs.schema)


def _measure(column: pa.Array, weights: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    data, offs = X.utf8(column)
    parts, scores = [], []
    for a, b, d, o in X.chunks(data, offs):
        words = X.Words(d, o)
        parts.append(_base(d, o, words))
        scores.append(_scores(words, weights, b - a))
    if not parts:
        return {f.name: np.empty(0, np.int64) for f in STATS}, np.empty(0)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}, np.concatenate(scores)


def _fails(cols: dict[str, np.ndarray]) -> np.ndarray:
    return (cols["n_words"] < 10) | (100 * cols["n_repeat_words"] > 20 * cols["n_words"])


def quality_rules(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Fit on the corpus and score every document (``score_documents``)."""
    weights, threshold = fit(docs, labels, **settings)
    return score_documents(docs, weights, threshold)
