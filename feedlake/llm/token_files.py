"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Documents are range-partitioned by id, sorted and encoded; each task writes frames of up to
``FRAME_TOKENS`` ids (whole documents). A frame holds

* ``ranked``: its distinct ids by falling frequency (ties by id), unsigned 32-bit;
* ``control``: two bits per id, four ids to a byte, lowest bits first: bytes of its rank - 1;
* ``data``: the ranks, little-endian, one to four bytes each, so that frequent ids take one;
* ``doc_ids`` and ``n_tokens``: its documents in order (64-bit), ``part`` and ``part_start``:
  the writing task and its ids before the frame.

Frames are rows of parquet files written by Spark, so files are committed whole, any store
works, and a lost executor repeats its task. Readers decode a frame with one table lookup
per control byte and numpy gathers. Starts over all documents come from the totals per part
(one row per task), never from all documents in one place.

Edge cases: null and empty texts hold the end id alone; rows that repeat an id follow each
other (ordered by text); null ids come first; an empty table gives no frames.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from feedlake.llm import textops as X, tokens
from feedlake.session import scratch_dir

END_ID = 2
FRAME_TOKENS = 1 << 19
COUNTED_IDS = 1 << 20         # ids below are counted in a table, others are sorted
FRAMES = ("part int, part_start long, doc_ids binary, id_known binary, n_tokens binary, ranked binary, control binary, data binary")

_BYTES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1        # bytes of the four ranks of a control byte


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ranked, control, data) of a frame's ids."""
    if int(ids.max(initial=0)) < COUNTED_IDS:        # counted in a table: no sorting of all ids
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        order = np.lexsort((values, -counts[values]))
        rank_of = np.empty(len(counts), np.uint32)
        rank_of[values[order]] = np.arange(len(order), dtype=np.uint32)
        rank = rank_of[ids]
    else:
        values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.lexsort((values, -counts))
        rank_of = np.empty(len(order), np.uint32)
        rank_of[order] = np.arange(len(order), dtype=np.uint32)
        rank = rank_of[inverse]
    size = 1 + (rank > 0xFF).astype(np.int64) + (rank > 0xFFFF) + (rank > 0xFFFFFF)
    padded = np.zeros(-len(size) % 4 + len(size), np.uint8)
    padded[:len(size)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = rank.astype("<u4").view(np.uint8).reshape(-1, 4)
    return values[order].astype(np.uint32), control.astype(np.uint8), raw[np.arange(4) < size[:, None]]


def decode_ids(ranked: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ids of a frame; inverse of ``encode_ids``."""
    size = _BYTES[control].reshape(-1)[:n]
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    rank = padded[at].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.flatnonzero(size > i)
        if len(more):
            rank[more] |= padded[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return ranked[rank]


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write frames in ascending doc_id order to ``path``."""
    tokenizer = tokenizer or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, written = TaskContext.get().partitionId(), 0
        held: list[tuple] = []                       # (doc ids, known, counts, ids)

        def frame():
            nonlocal written
            doc, known, count, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            ranked, control, data = encode_ids(ids)
            row = [part, written, doc.tobytes(), known.tobytes(), count.tobytes(), ranked.tobytes(), control.tobytes(), data.tobytes()]
            written += len(ids)
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=_FRAME_NAMES)

        for batch in batches:
            all_ids = batch.column(0)
            doc = all_ids.fill_null(0).to_numpy()
            known = ~all_ids.is_null().to_numpy(zero_copy_only=False)
            for a, b, ids, cuts in tokens.encode_column(batch.column(1), tokenizer):
                ids = np.insert(ids.astype(np.uint32), cuts[1:], end_id)
                cuts = cuts + np.arange(len(cuts))
                row = 0
                while row < b - a:                   # whole documents, one at least
                    end = max(row + 1, int(np.searchsorted(cuts, cuts[row] + FRAME_TOKENS, "right")) - 1)
                    end = min(end, b - a)
                    if held and sum(len(h[3]) for h in held) + cuts[end] - cuts[row] > FRAME_TOKENS:
                        yield frame()
                    held.append((doc[a + row:a + end], known[a + row:a + end], np.diff(cuts[row:end + 1]), ids[cuts[row]:cuts[end]]))
                    row = end
        if held:
            yield frame()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(X.lean(run), FRAMES).write.mode("overwrite").parquet(path)


_FRAME_NAMES = ["part", "part_start", "doc_ids", "id_known", "n_tokens", "ranked", "control", "data"]


def read_frames(frames: DataFrame, with_ids: bool = False) -> DataFrame:
    """part, part_start, doc_id, n_tokens, ids_crc32 (and ids) of every document, decoded from the frames."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)  # noqa: B023, E731
                doc, known, count = get("doc_ids", np.int64), get("id_known", bool), get("n_tokens", np.int64)
                ids = decode_ids(get("ranked", np.uint32), get("control", np.uint8), get("data", np.uint8), int(count.sum()))
                raw, cuts = ids.astype("<u4").tobytes(), np.r_[0, np.cumsum(count)] * 4
                pieces = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                columns = [pa.array(np.full(len(doc), batch.column("part")[i].as_py(), np.int32)),
                           pa.array(batch.column("part_start")[i].as_py() + cuts[:-1] // 4), pa.array(doc, mask=~known), pa.array(count),
                           pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                names = ["part", "part_start", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").tolist() for p in pieces], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, part_start long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return frames.mapInArrow(X.lean(run), schema)


def read_token_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document of the files at ``path``."""
    frames = spark.read.parquet(path)
    # one row per writing task; the last frame of a part ends with the part's total
    last = frames.select("part", F.col("part_start"), F.length("n_tokens").alias("size"), "n_tokens")
    total = last.mapInArrow(X.lean(_frame_totals), "part int, total long").groupBy("part").agg(F.max("total").alias("total"))
    before = total.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    docs = read_frames(frames, with_ids).join(F.broadcast(before), "part")       # as many rows as the writer had tasks
    return docs.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def _frame_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [s + int(np.frombuffer(n, np.int64).sum()) for s, n in zip(batch.column("part_start").to_pylist(), batch.column("n_tokens").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(ends, pa.int64())], names=["part", "total"])


def token_file_round_trip(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files (a new folder under the checkpoint folder unless given) and read them back."""
    import uuid
    path = path or scratch_dir(docs.sparkSession, f"token-files-{uuid.uuid4().hex}")
    write_token_files(docs, path, tokenizer)
    return read_token_files(docs.sparkSession, path)
