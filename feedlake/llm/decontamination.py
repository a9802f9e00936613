"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A document leaks a benchmark item of m characters if one of its passages aligns with the
whole item within k = ``rate`` * m edits (code points in lower case, white space as blanks). Such an alignment stays within k + 1 neighbouring diagonals and keeps at least
T = m + 1 - q (k + 1) of the item's q-grams. So:

1. every q-gram of a document that some item has is a hit (hash table lookup per chunk);
2. hits are counted per item in bands of 2 (k + 1) diagonals that overlap by half, first
   roughly, then with each pattern position once; bands below T cannot hold an alignment
   and are dropped;
3. the rest are verified by a banded alignment of the whole item (all bands of a chunk at
   once, one numpy row per pattern position), which also gives the passage's bounds.

The benchmark is split into slices of at most ``SLICE_CHARS`` characters; each slice is
sent to the tasks (a checked size) and makes one pass, so its size is not assumed. Before the
next slice is sent, what the last one found is written and the slice is freed: tasks and driver
hold one slice at a time.

Edge cases: null or empty documents leak nothing; items that are null or shorter than q + 1
characters cannot be told from chance and are ignored; k shrinks for short items until T is
at least 1. Items of equal text are all reported. Rows that repeat an id are searched one by
one; a null id is reported as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from feedlake.llm import textops as X
from feedlake.session import materialize

Q = 8
RATE = 0.1
SLICE_CHARS = 1 << 22
_TABLE_BITS = 22
_COST = 1 << 32


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of the joined texts, and the offsets."""
    points = np.frombuffer("".join(map(_lower, texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    offs = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    return np.where((points >= 9) & (points <= 13), np.uint32(32), points), offs


def _lower(text: str) -> str:
    """Lower case, character by character where that would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = X.powers(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * power[:len(points)], out=total[1:])
    return X.mix((total[q:] - total[:n]) * inverse[:n])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and their counts."""
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return values[first], np.diff(np.r_[first, len(values)])


class Index:
    """q-grams of a slice of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        self.q = q
        rows = []
        for item, text in items:
            points, _ = _code_points([text])
            if len(points) > q:
                rows.append((item, points))
        self.ids = [item for item, _ in rows]
        self.points = [p for _, p in rows]
        self.length = np.array([len(p) for p in self.points], np.int64)
        self.budget = np.minimum((rate * self.length).astype(np.int64), self.length // q - 1)
        self.least = self.length + 1 - q * (self.budget + 1)
        grams = [_grams(p, q) for p in self.points]
        gram = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.at = gram[order], item[order], at[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(gram >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of every leak; of overlapping ones of an item, the best."""
        points, offs = _code_points(texts)
        gram = _grams(points, self.q)
        if not len(gram) or not len(self.gram):
            return []
        hit = np.flatnonzero(self.table[(gram >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        lo = np.searchsorted(self.gram, gram[hit], "left")
        hi = np.searchsorted(self.gram, gram[hit], "right")
        doc = np.searchsorted(offs, hit, "right") - 1
        inside = (hi > lo) & (hit + self.q <= offs[doc + 1])
        hit, lo, hi, doc = hit[inside], lo[inside], hi[inside], doc[inside]
        n = hi - lo
        row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, at = self.item[row], self.at[row]
        block = (np.repeat(hit, n) - at) // (self.budget[item] + 1)
        # count by half bands first: most of them, and their neighbours, hold too few hits
        key = (item << 40) + block + 1
        kinds, count = _runs(np.sort(key))
        follows = np.r_[kinds[1:] == kinds[:-1] + 1, False]
        both = count + np.where(follows, np.r_[count[1:], 0], 0)
        full = both >= self.least[kinds >> 40]
        full |= np.r_[False, (full & follows)[:-1]]
        kinds = kinds[full]
        if not len(kinds):
            return []
        keep = kinds[np.minimum(np.searchsorted(kinds, key), len(kinds) - 1)] == key
        doc, item, at, block = np.repeat(doc, n)[keep], item[keep], at[keep], block[keep]
        diagonal = np.repeat(hit, n)[keep] - at
        # a diagonal with all q-grams of an item is a verbatim copy; its bands need no alignment
        lines, count = _runs(np.sort((item << 40) + diagonal + 1))
        whole = lines[count == self.length[lines >> 40] - self.q + 1]
        copies, place = whole >> 40, (whole & ((1 << 40) - 1)) - 1
        owner = np.searchsorted(offs, place, "right") - 1
        one = (place >= 0) & (place + self.length[copies] <= offs[owner + 1])
        copies, place, owner = copies[one], place[one], owner[one]
        found = [(d, t, a - int(offs[d]), a - int(offs[d]) + int(self.length[t]), 0) for d, t, a in zip(owner.tolist(), copies.tolist(), place.tolist())]
        if len(place):
            own = place // (self.budget[copies] + 1)
            near = np.unique(np.concatenate([(copies << 40) + own + i for i in (0, 1, 2)]))
            open_ = near[np.minimum(np.searchsorted(near, (item << 40) + block + 1), len(near) - 1)] != (item << 40) + block + 1
            doc, item, at, block = doc[open_], item[open_], at[open_], block[open_]
        if not len(item):
            return self._best(found)
        # both bands that a diagonal belongs to; each pattern position counts once in a band
        item, at, doc, block = (np.concatenate([v, v]) for v in (item, at, doc, block))
        block[len(block) // 2:] -= 1
        order = np.lexsort((at, block, item, doc))
        item, at, doc, block = item[order], at[order], doc[order], block[order]
        new = np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])]
        once = new | np.r_[True, at[1:] != at[:-1]]
        first = np.flatnonzero(new)
        count = np.add.reduceat(once.astype(np.int64), first)
        keep = first[count >= self.least[item[first]]]
        return self._best(found + self._verify(points, offs, doc[keep], item[keep], block[keep]))

    def _verify(self, points, offs, doc, item, block) -> list[tuple[int, int, int, int, int]]:
        found = []
        for a in range(0, len(doc), 2048):           # bounded work space
            d, t, b = doc[a:a + 2048], item[a:a + 2048], block[a:a + 2048]
            cost, start, end = self._align(points, offs[d], offs[d + 1], t, b)
            good = np.flatnonzero(cost <= self.budget[t])
            found += zip(d[good].tolist(), t[good].tolist(), (start - offs[d])[good].tolist(), (end - offs[d])[good].tolist(), cost[good].tolist())
        return found

    def _best(self, found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        best, taken = [], {}
        for d, t, s, e, c in sorted(found, key=lambda x: (x[0], x[1], x[4], x[2])):
            spans = taken.setdefault((d, t), [])
            if all(e <= x or s >= y for x, y in spans):
                spans.append((s, e))
                best.append((d, self.ids[t], s, e, c))
        return best

    def _align(self, points, low, high, item, block):
        """Least edits, start and end of an alignment of each item whose start lies on its band's
        diagonals (a margin of k on both sides leaves room for the path)."""
        k, m = self.budget[item], self.length[item]
        width = int((4 * (k + 1) + 2).max())
        base = block * (k + 1) - (k + 1)             # first diagonal
        lane = np.arange(width)
        place = base[:, None] + lane                 # column of pattern row 0
        end_lane = 4 * (k + 1) + 1
        big = np.int64(1 << 20) * _COST
        # row 0: an alignment may start at any place of the document in the band
        open_ = (place >= low[:, None]) & (place <= high[:, None]) & (lane < end_lane[:, None])
        d = np.where(open_, place - low[:, None], big)       # cost 0, start in the low bits
        done_cost = np.full(len(item), big)
        done_lane = np.zeros(len(item), np.int64)
        step = lane * _COST
        longest = int(m.max())
        pattern = np.zeros((len(item), longest), np.uint32)
        for i, t in enumerate(item):
            pattern[i, :self.length[t]] = self.points[t]
        for i in range(longest):
            column = place + i                               # text position that row i + 1 consumes on the diagonal
            ok = (column >= low[:, None]) & (column < high[:, None])
            same = ok & (points[np.clip(column, 0, len(points) - 1)] == pattern[:, i:i + 1])
            diag = np.where(ok, d + np.where(same, 0, _COST), big)
            up = np.full_like(d, big)                        # a pattern character without counterpart
            up[:, :-1] = d[:, 1:] + _COST
            up = np.where(column + 1 >= low[:, None], up, big)
            d = np.minimum(np.minimum(diag, up), big)
            d = np.minimum.accumulate(d - step, axis=1) + step       # extra text characters
            d = np.where((column + 1 <= high[:, None]) & (lane < end_lane[:, None]), np.minimum(d, big), big)
            last = np.flatnonzero(m == i + 1)
            if len(last):
                at = d[last].argmin(axis=1)
                done_cost[last], done_lane[last] = d[last, at], at
        cost, start = done_cost // _COST, done_cost % _COST
        return cost, start + low, base + done_lane + m


def slices(benchmark: DataFrame, limit: int = SLICE_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items of the benchmark, at most ``limit`` characters (or one item) at a time."""
    rows: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select("item_id", "text").dropna(subset=["text"]).orderBy("item_id", "text").toLocalIterator():
        if rows and size + len(r.text) > limit:
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += len(r.text)
    if rows:
        yield rows


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    rows = [x or "" for x in column.to_pylist()]
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size + len(rows[end]) <= X.CHUNK_BYTES // 2):
            size += len(rows[end])
            end += 1
        yield at, rows[at:end]
        at = end


def _slice_pass(docs: DataFrame, items: list[tuple[int, str]], answer: Callable, schema, q: int, rate: float) -> tuple[DataFrame, Broadcast]:
    """``answer(index, batch)`` for every batch of ``docs``, and the broadcast slice that the frame needs."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value, q, rate)
        for batch in batches:
            yield from answer(index, batch)

    return docs.mapInArrow(X.lean(run), schema), sent


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end (code points, end exclusive), edits of every leaked passage.

    A slice's passages are written under the checkpoint folder before the next slice is sent."""
    schema = "doc_id long, item_id long, start long, end long, edits long"

    def passages(index: Index, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_pylist()
        for at, texts in _texts(batch.column(1)):
            rows = [(ids[at + d], *rest) for d, *rest in index.search(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)],
                                             names=["doc_id", "item_id", "start", "end", "edits"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts, sent = [], None
    for items in slices(benchmark):
        if sent:
            parts[-1] = materialize(parts[-1], "leaks")
            sent.destroy()
        part, sent = _slice_pass(rows, items, passages, schema, q, rate)
        parts.append(part)
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, with all their columns.

    What a slice leaves is written under the checkpoint folder before the next slice is sent."""
    at = docs.columns.index("text")

    def clean_rows(index: Index, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        clean = np.ones(batch.num_rows, bool)
        for a, texts in _texts(batch.column(at)):
            clean[[a + r[0] for r in index.search(texts)]] = False
        yield batch.filter(pa.array(clean))

    sent = None
    for items in slices(benchmark):
        if sent:
            docs = materialize(docs, "clean")
            sent.destroy()
        docs, sent = _slice_pass(docs, items, clean_rows, docs.schema, q, rate)
    return docs
