"""Packing into sequences of at most ``capacity`` tokens by minimum bin slack.

A document (ids with the end id) is cut into full windows and a rest. Rests are dealt into
groups by the hash of id and text; a group packs its multiset of lengths on its own: the
longest rest opens a window, and a bitset subset-sum over the counts of the remaining
lengths finds the multiset that fills the window closest to its capacity. The sums that
each length adds are kept, so the counts are read off by walking back; a filling that still
fits the remaining counts is repeated as often as they allow. All windows but the last few
of a group come out full; ``padding`` counts what a sequence needs.

Only lengths and checksums are written and shuffled, never ids. The number of groups follows
from the measured number of rests (``GROUP_RESTS`` each), whatever the session's settings: the
last windows of a group are its only padding, and no document count or length can make one group hot.

Edge cases: null and empty texts are the end id alone; rows that repeat an id are packed one
by one; a null id is reported as null; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedlake.llm import textops as X, tokens
from feedlake.session import materialize

CAPACITY = 2048
END_ID = 1
#: Rests that a group should hold. Fewer means more windows that are left open.
GROUP_RESTS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def padding(length: int, capacity: int = CAPACITY) -> int:
    """Padding of a sequence: up to the capacity, none at a power of two."""
    return 0 if length & (length - 1) == 0 else capacity - length


def fill(counts: np.ndarray, lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, count) pairs from ``counts`` whose sum is as close to ``room`` as possible, not above.

    ``lengths``: those with a positive count, descending. Bit s of a set is on if sum s can
    be made; the search stops as soon as ``room`` itself can."""
    mask, sums = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []           # length, how many at once, sums before
    for length in lengths:
        if length > room:
            continue
        left, chunk = min(int(counts[length]), room // length), 1
        while left:                                  # binary split of the count
            take = min(chunk, left)
            grown = (sums | sums << (length * take)) & mask
            if grown != sums:
                steps.append((length, take, sums))
                sums = grown
            left -= take
            chunk *= 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):     # walk back: a step was used if its sums lacked ``at``
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return list(used.items())


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece (lengths of 1 to ``capacity``)."""
    order = np.argsort(lengths, kind="stable")
    at = np.searchsorted(lengths[order], np.arange(capacity + 2))
    counts, nxt = np.diff(at), at[:-1].copy()
    counts = counts.astype(np.int64)
    present = [int(x) for x in np.flatnonzero(counts)[::-1]]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    while present:
        longest = present[0]
        counts[longest] -= 1
        open_ = [x for x in present if counts[x] and x <= capacity - longest]
        used = [(longest, 1), *fill(counts, open_, capacity - longest)] if open_ else [(longest, 1)]
        counts[longest] += 1
        content: dict[int, int] = {}
        for length, n in used:
            content[length] = content.get(length, 0) + n
        times = min(int(counts[length]) // n for length, n in content.items())
        for _ in range(times):
            place = 0
            for length, n in content.items():
                for _ in range(n):
                    i = order[nxt[length]]
                    nxt[length] += 1
                    sequence[i], offset[i] = made, place
                    place += length
            made += 1
        for length, n in content.items():
            counts[length] -= n * times
        if any(not counts[length] for length in content):
            present = [x for x in present if counts[x]]
    return sequence, offset


def cut_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: full windows and the rest (``PIECES`` columns and the group key)."""
    tokenizer = tokenizer or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, cuts in tokens.encode_column(batch.column(1), tokenizer):
                raw = np.insert(ids.astype("<u4"), cuts[1:], end_id).tobytes()
                cuts = cuts + np.arange(len(cuts))
                total = np.diff(cuts)
                n = -(-total // capacity)
                row = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(total[row] - start, capacity)
                low = (cuts[:-1][row] + start) * 4
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(low.tolist(), (low + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row]),
                     batch.column(2).take(pa.array(a + row))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("spread")).mapInArrow(X.lean(run), PIECES + ", spread long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, groups: int | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    pieces = materialize(cut_documents(docs, tokenizer, capacity, end_id), "pieces")
    groups = groups or max(1, round(pieces.where(F.col("length") < capacity).count() / GROUP_RESTS))

    def run(table: pa.Table) -> pa.Table:
        # the order of arrival must not matter when a task is repeated
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = pack_lengths(table.column("length").to_numpy(), capacity)
        group = table.column("group")[0].as_py()
        out = table.select([c.split()[0] for c in PIECES.split(", ")])
        return out.append_column("sequence_id", pa.array((np.int64(group) << 40) + sequence)).append_column("offset", pa.array(offset))

    # copies of one row must not fill one group: the start tells their pieces apart, the rows themselves need no order
    keyed = pieces.withColumn("group", F.pmod(F.xxhash64("spread", "start"), F.lit(groups)).cast("long")).drop("spread")
    return keyed.groupBy("group").applyInArrow(X.lean_group(run), PIECES + ", sequence_id long, offset long")
