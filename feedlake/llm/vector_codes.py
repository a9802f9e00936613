"""Product-quantised codes of vectors, assigned through memoised grid cells.

A vector of integers floor(``SCALE`` * x) is cut into ``PARTS`` equal parts; each part
position has a codebook of at most ``ENTRIES`` integer vectors. A round assigns every part to
its nearest entry (squared distance, ties to the lower index) and moves each entry to the
componentwise floor mean of its parts.

Assignment: a part falls into a cell of a grid of ``CELL`` integers' width. For the box of a
cell, every entry has a least and a greatest distance, both sums of one table value per
component. An entry whose least distance exceeds the smallest greatest distance of any entry
is nowhere nearest in that box; the others are remembered under the hash of the cell, and
only those are evaluated exactly for the parts in it. The cell's coordinates are kept beside
the hash, so cells of equal hashes are told apart. What is remembered (at most ``CELLS`` cells
a part position and task) touches cost only.

Spark deals the vectors; a task returns one sum and count per entry and component, which are
summed with a map-side aggregate. Only codebooks (``PARTS * ENTRIES`` vectors) reach the
driver and go back to the tasks. A frequent vector is one cell with one evaluation a batch.

Edge cases: rows whose vector is null or empty, or holds a null or non-finite component, are dropped.
The length of the vectors is that of the first kept one (by id); vectors of another length are
dropped, too, and a length that ``PARTS`` does not divide raises. A component beyond
2**17 in amount raises: its squared distances would not fit 64 bits. Null ids come last in
the order of ids; rows that repeat an id are ordered by their vectors and coded one by one.
Fewer rows than entries give a smaller codebook, no rows an empty one. Labels that are null
are summed together. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from feedlake.llm.checked import BROADCAST_BYTES
from feedlake.session import materialize

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Width of a grid cell in every component, in integers.
CELL = 32
#: Cells remembered per part position and task; beyond, the memory starts afresh.
CELLS = 1 << 14
#: Parts that are looked at together.
BLOCK = 4096
#: Largest amount of an integer component.
MOST = SCALE << 17

_MIX = np.random.default_rng(11).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def usable(vectors: pa.Array) -> np.ndarray:
    """Whether each list is there, has a component, and finite ones only."""
    values = vectors.flatten()
    good = pc.fill_null(pc.is_finite(values.cast(pa.float64())), False).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    total = np.r_[0, np.cumsum(good)]
    return vectors.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & (total[ends] - total[ends - size] == size)


def integers(vectors: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    """Integer matrix of the given rows, all of ``length`` components."""
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.floor(flat * float(SCALE))
    if len(out) and np.abs(out).max() > MOST:
        raise ValueError(f"a component is beyond {MOST // SCALE} in amount")
    return out.astype(np.int64).reshape(-1, length)


class Grid:
    """Nearest entries of one codebook through remembered cells."""

    def __init__(self, book: np.ndarray, cell: int = CELL, most: int = CELLS):
        self.book, self.cell, self.most = book, cell, most
        self.evaluated = self.asked = 0
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)                               # sorted
        self.cells = np.empty((0, self.book.shape[1]), np.int64)
        self.near = np.empty((0, len(self.book)), bool)                  # entries not dominated

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Entries that may be nearest somewhere in each cell."""
        least = np.zeros((len(cells), len(self.book)), np.int64)
        most = np.zeros_like(least)
        for j in range(cells.shape[1]):
            value, place = np.unique(cells[:, j], return_inverse=True)
            low = value[:, None] * self.cell
            below, above = low - self.book[:, j], self.book[:, j] - (low + self.cell - 1)
            inside = np.maximum(np.maximum(below, above), 0)
            outside = np.maximum(np.abs(below), np.abs(above))
            least += (inside * inside)[place]
            most += (outside * outside)[place]
        return least <= most.min(axis=1, keepdims=True)

    def _remembered(self, cells: np.ndarray) -> np.ndarray:
        """Candidate rows of distinct cells."""
        with np.errstate(over="ignore"):
            key = (cells.astype(np.uint64) * _MIX[:cells.shape[1]]).sum(axis=1, dtype=np.uint64)
            key ^= key >> np.uint64(29)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = np.zeros(len(cells), bool)
        if len(self.keys):
            known = (self.keys[at] == key) & (self.cells[at] == cells).all(axis=1)
        out = np.empty((len(cells), len(self.book)), bool)
        if known.any():
            out[known] = self.near[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.candidates(cells[new])
            _, first = np.unique(key[new], return_index=True)
            add = new[first]
            add = add[~np.isin(key[add], self.keys)]                     # a cell of an equal hash stays unremembered
            if len(self.keys) + len(add) > self.most:
                self._forget()
                add = add[:self.most]
            where = np.searchsorted(self.keys, key[add])
            self.keys = np.insert(self.keys, where, key[add])
            self.cells = np.insert(self.cells, where, cells[add], axis=0)
            self.near = np.insert(self.near, where, out[add], axis=0)
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, and its squared distance, of each part."""
        index, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for a in range(0, len(parts), BLOCK):
            own, place = np.unique(parts[a:a + BLOCK], axis=0, return_inverse=True)
            cells, cell = np.unique(own // self.cell, axis=0, return_inverse=True)
            row, entry = np.nonzero(self._remembered(cells)[cell.reshape(-1)])
            away = np.zeros(len(row), np.int64)
            for j in range(own.shape[1]):
                step = own[row, j] - self.book[entry, j]
                away += step * step
            first = np.searchsorted(row, np.arange(len(own)))            # every part has a candidate
            best = np.minimum.reduceat(away, first)
            hit = np.flatnonzero(away == best[row])                      # entries ascend within a row
            _, lowest = np.unique(row[hit], return_index=True)
            self.evaluated += len(row)
            self.asked += len(own) * len(self.book)
            index[a:a + BLOCK], distance[a:a + BLOCK] = entry[hit][lowest][place.reshape(-1)], best[place.reshape(-1)]
        return index, distance


def _matrices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batch, its kept rows, and their integers."""
    for batch in batches:
        vectors = batch.column("embedding")
        size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(usable(vectors) & (size == length))
        if len(rows):
            yield batch, rows, integers(vectors, rows, length)


def _book_sums(vectors: DataFrame, books: list[np.ndarray], length: int, cell: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> count of its parts and their componentwise sums, over all vectors."""
    parts, width = len(books), length // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b, cell) for b in books]
        sums = [np.zeros((len(b), width + 1), np.int64) for b in books]
        for _, _, x in _matrices(batches, length):
            for p in range(parts):
                own = x[:, p * width:(p + 1) * width]
                entry, _ = grids[p].nearest(own)
                np.add.at(sums[p], entry, np.c_[np.ones(len(own), np.int64), own])
        for p in range(parts):
            used = np.flatnonzero(sums[p][:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p * ENTRIES + used, width + 1)), pa.array(np.tile(np.arange(width + 1), len(used))),
                                              pa.array(sums[p][used].reshape(-1))], names=["slot", "place", "total"])

    made = vectors.select("embedding").mapInArrow(run, "slot long, place long, total long")
    rows = made.groupBy("slot", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()   # codebooks: bounded
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    found: dict[int, dict[int, int]] = {}
    for r in rows:
        found.setdefault(r["slot"], {})[r["place"]] = int(r["total"])
    for slot, own in found.items():
        out[divmod(slot, ENTRIES)] = own[0], [own[j + 1] for j in range(width)]
    return out


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[list[np.ndarray], int]:
    """Starting codebooks, the parts of the vectors of the smallest ids, and the vectors' length."""
    finite = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.where((F.size("embedding") > 0) & finite).select("vec_id", "embedding")
    order = [F.asc_nulls_last("vec_id"), "embedding"]
    top = kept.orderBy(*order).limit(1).collect()
    length = len(top[0]["embedding"]) if top else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    if not length:
        return [np.empty((0, 0), np.int64)] * parts, 0
    rows = kept.where(F.size("embedding") == length).orderBy(*order).limit(entries).collect()
    x = integers(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), np.arange(len(rows)), length)
    return np.split(x, parts, axis=1), length


def train(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, cell: int = CELL) -> tuple[list[np.ndarray], int]:
    """Codebooks (one integer matrix per part position) after ``rounds`` rounds over all vectors, and the vectors' length."""
    books, length = first_books(vectors, parts, entries)
    for _ in range(rounds if length else 0):
        sums = _book_sums(vectors, books, length, cell)
        books = [b.copy() for b in books]
        for (p, k), (n, total) in sums.items():
            books[p][k] = [t // n for t in total]
    return books, length


def encode(vectors: DataFrame, books: list[np.ndarray], length: int, cell: int = CELL) -> DataFrame:
    """vec_id, label, code (one byte per part) and error (squared distance, summed over the parts) of every kept vector."""
    width = length // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b, cell) for b in books]
        for batch, rows, x in _matrices(batches, length):
            error, codes = np.zeros(len(rows), np.int64), np.empty((len(rows), len(books)), np.uint8)
            for p, grid in enumerate(grids):
                entry, away = grid.nearest(x[:, p * width:(p + 1) * width])
                codes[:, p] = entry
                error += away
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at),
                                              pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Adds ``approximation``, the integer vector that a code stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(books))
            x = np.concatenate([b[code[:, p]] for p, b in enumerate(books)], axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "approximation"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in codes.dtypes)
    return codes.mapInArrow(run, f"{kinds}, approximation array<long>")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every kept vector."""
    cell = settings.get("cell", CELL)
    books, length = train(vectors, **settings)
    coded = encode(vectors, books, length, cell) if length else encode(vectors.limit(0), books, 0, cell)
    coded = materialize(coded, "vector-codes")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-labels")
    sums = sums.withColumnRenamed("label", "sum_label")
    if sums.count() * 64 <= BROADCAST_BYTES:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("sum_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
