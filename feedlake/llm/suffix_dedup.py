"""Suffix-array dedup: difference-cover blockwise construction, one suffix bucket at a time.

A byte is removed if a ``length``-byte string that covers it also starts in a document with
a smaller id (judged on the input; matches never cross documents).

1. Documents are dealt into blocks by the hash of their id and text; the number of blocks follows
   the measured size of the texts, so a block's size does not grow with the table. Each window of ``length`` bytes
   picks its seed, the ``SEED``-gram with the smallest hash (a function of the window alone,
   so equal windows pick equal seeds). Every block sends each distinct seed once, as packed
   numpy arrays, to the seed's bucket; the bucket answers with the seeds that two documents
   share. Windows under other seeds occur once and take no further part.
2. Windows under a shared seed start in one run around it. A block sends the text of each
   distinct run (at most ``2 * length - SEED`` bytes) with its smallest id to the seed's
   bucket. All equal windows meet in one bucket, and a bucket holds one entry per block and
   text, however many copies there are.
3. A bucket sorts its suffixes: by their first ``PERIOD`` bytes, then, for the long ties, by
   the ranks of difference-cover samples computed beforehand: for suffixes i and j there is
   a shift d < PERIOD with i+d and j+d both in the cover, and one rank comparison decides.
   Neighbours in suffix order that agree on ``length`` bytes form a class; its smallest id
   decides which starts are removed. Only bit masks of starts go back to the blocks.

The text is shuffled once; the three passes over it share the exchange.

Edge cases: null text is empty; texts shorter than ``length`` lose nothing; rows that repeat
an id are judged by that id and do not remove each other; a null id ranks after all others.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedlake.llm import textops as X

LENGTH = 50
SEED = 20
PERIOD = 32

#: Bytes of text per block, and per bucket of seeds and runs (these are about a quarter of the text).
BLOCK_BYTES = 256 << 20
BUCKET_BYTES = 1 << 30

_NO_ID = np.iinfo(np.int64).max
_TO_BLOCK = "block int, tag int, a binary, b binary"


def difference_cover(period: int) -> np.ndarray:
    """Residues such that every difference modulo ``period`` is one between two of them (greedy)."""
    cover, missing = [0], set(range(1, period))
    while missing:
        best = max(range(1, period), key=lambda r: (r not in cover) * len({x for c in cover for x in ((r - c) % period, (c - r) % period)} & missing))
        missing -= {x for c in cover for x in ((best - c) % period, (c - best) % period)}
        cover.append(best)
    return np.array(sorted(cover))


_COVER = difference_cover(PERIOD)
_IN_COVER = np.isin(np.arange(PERIOD), _COVER)
#: _SHIFT[a, b]: least d with (a + d) and (b + d) in the cover.
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD])
                    for b in range(PERIOD)] for a in range(PERIOD)])


def _words64(text: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte word that starts at each position (the text is followed by zeros)."""
    padded = np.concatenate([text, np.zeros(3 * PERIOD + 16, np.uint8)]).astype(np.uint64)
    n = len(text) + 3 * PERIOD + 8
    w = np.zeros(n, np.uint64)
    for i in range(8):
        w = (w << np.uint64(8)) | padded[i:i + n]
    return w


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Rank of each row in the lexicographic order of its columns; equal rows share a rank."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def sample_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Rank of the first 2 * PERIOD bytes of each cover sample of a text of n bytes."""
    size = n + 2 * PERIOD
    at = np.flatnonzero(np.tile(_IN_COVER, size // PERIOD + 1)[:size])
    ranks = np.zeros(size + PERIOD, np.int64)
    ranks[at] = 1 + _dense([words[at + 8 * i] for i in range(PERIOD // 8)])
    first = ranks[at] * (len(at) + 2) + ranks[at + PERIOD]     # at + PERIOD is a sample, too
    ranks[at] = _dense([first])
    return ranks


def suffix_order(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Order of the suffixes at ``starts`` by (at least) their first 2 * PERIOD bytes."""
    head = _dense([words[starts + 8 * i] for i in range(PERIOD // 8)])
    order = np.argsort(head, kind="stable")
    group = head[order]
    tied = np.r_[False, group[1:] == group[:-1]]
    tied |= np.r_[tied[1:], False]
    if not tied.any():
        return order
    ranks = sample_ranks(words, n)
    slot = np.flatnonzero(tied)                      # places in the order that are still open
    while len(slot):
        s, g = starts[order[slot]], group[slot]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(slot)])
        pivot = np.repeat(s[first + size // 2], size)
        shift = _SHIFT[s % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[s + shift] - ranks[pivot + shift])
        key = np.repeat(np.arange(len(first)), size) * 3 + side + 1
        by = np.argsort(key, kind="stable")
        order[slot] = order[slot][by]
        key, side = key[by], side[by]
        group[slot] = key
        again = np.r_[False, key[1:] == key[:-1]]
        again |= np.r_[again[1:], False]
        slot = slot[again & (side != 0)]             # those equal to their pivot are done
    return order


def repeated_starts(text: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Smallest id among the suffixes of ``text`` that share their first ``length`` bytes, per start."""
    words = _words64(text)
    order = suffix_order(words, starts, len(text))
    s = starts[order]
    new = np.zeros(len(s), bool)
    new[:1] = True
    for at in [*range(0, length - 7, 8), length - 8]:
        w = words[s + at]
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[order], first)
    out = np.empty(len(s), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[first, len(s)]))
    return out


class Runs:
    """Runs of window starts that share a seed, for the documents of a chunk.

    first, last: window starts of the run; seed: hash of the seed; key: hash of the run's text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int = LENGTH):
        width, n = length - SEED + 1, len(data)
        self.first = self.last = np.empty(0, np.int64)
        self.seed = self.key = np.empty(0, np.uint64)
        if n < length:
            return
        power, inverse = X.powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(X._BYTE_VALUES[data] * power[:n], out=total[1:])
        m = n - SEED + 1
        gram = X.mix((total[SEED:] - total[:m]) * inverse[:m])
        least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        span = 1
        while span < width:                          # least over windows of 1, 2, 4, ... and then ``width`` grams
            step = min(span, width - span)
            least = np.minimum(least[:len(least) - step], least[step:])
            span += step
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 1, np.int32)           # windows that end in the document where they start
        long = np.diff(offs) >= length
        np.add.at(inside, offs[:-1][long], 1)
        np.add.at(inside, offs[1:][long] - length + 1, -1)
        valid = np.flatnonzero(np.cumsum(inside[:len(at)]) > 0)
        if not len(valid):
            return
        place = at[valid]
        new = np.r_[True, (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)]
        start = np.flatnonzero(new)
        self.first = valid[start]
        self.last = valid[np.r_[start[1:] - 1, len(valid) - 1]]
        self.seed = gram[place[start]]
        ends = self.last + length
        self.key = X.mix((total[ends] - total[self.first]) * inverse[self.first] + (ends - self.first).astype(np.uint64) * X._STEP[0])


def _bucket(seed: np.ndarray, buckets: int) -> np.ndarray:
    return ((seed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _short(seed: np.ndarray) -> np.ndarray:
    return (seed & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _table_runs(table: pa.Table, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, Runs]]:
    data, offs = X.utf8(table.column("text"))
    for a, _, d, o in X.chunks(data, offs):
        yield a, d, o, Runs(d, o, length)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(_NO_ID).to_numpy()


def _pack(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, the buckets present, and the cuts between them."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    return order, np.flatnonzero(np.diff(cuts)), cuts


def _cut(values: np.ndarray, cuts: np.ndarray, present: np.ndarray) -> list[bytes]:
    return [values[cuts[b]:cuts[b + 1]].tobytes() for b in present]


def _send_seeds(buckets: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        ids, seeds, docs = _ids(table), [], []
        for a, _, o, runs in _table_runs(table, length):
            seeds.append(runs.seed)
            docs.append(ids[a + np.searchsorted(o, runs.first, "right") - 1])
        seed, doc = np.concatenate(seeds or [np.empty(0, np.uint64)]), np.concatenate(docs or [np.empty(0, np.int64)])
        order = np.argsort(seed)
        seed, doc = seed[order], doc[order]
        first = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]]) if len(seed) else np.empty(0, np.int64)
        shared = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.empty(0, bool)
        seed = seed[first]
        order, present, cuts = _pack(_bucket(seed, buckets), buckets)
        block = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(present, pa.int32()), "block": pa.array(np.full(len(present), block), pa.int32()),
                         "seeds": pa.array(_cut(_short(seed)[order], cuts, present), pa.binary()),
                         "shared": pa.array(_cut(shared[order], cuts, present), pa.binary())})
    return run


def _answer_seeds(table: pa.Table) -> pa.Table:
    """One bucket: tell each block which of its seeds two documents share."""
    seed, counts = X.joined(table.column("seeds"), np.uint32)
    shared, _ = X.joined(table.column("shared"), bool)
    block = np.repeat(table.column("block").combine_chunks().to_numpy(), counts)
    order = np.argsort(seed, kind="stable")
    s = seed[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[first, len(s)])
    hit = np.repeat((size > 1) | np.maximum.reduceat(shared[order], first), size)
    s, block = s[hit], block[order][hit]
    # the bucket completes the short seed
    value = (np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)) | s.astype(np.uint64)
    by = np.argsort(block, kind="stable")
    block, value = block[by], value[by]
    at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, np.int64)
    ends = np.r_[at[1:], len(block)]
    return pa.table({"block": pa.array(block[at], pa.int32()), "tag": pa.array(np.zeros(len(at)), pa.int32()),
                     "a": pa.array([value[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()),
                     "b": pa.array([b""] * len(at), pa.binary())})


def _send_runs(buckets: int, length: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        known = np.sort(X.joined(answers.column("a"), np.uint64)[0])
        ids, parts = _ids(table) if table.num_rows else None, []
        for a, d, o, runs in _table_runs(table, length) if len(known) else ():
            value = (_bucket(runs.seed, buckets).astype(np.uint64) << np.uint64(32)) | _short(runs.seed).astype(np.uint64)
            at = np.searchsorted(known, value)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == value)
            first, ends = runs.first[hit], runs.last[hit] + length
            doc = ids[a + np.searchsorted(o, first, "right") - 1]
            order = np.lexsort((doc, runs.key[hit]))             # the smallest id of each text comes first
            key = runs.key[hit][order]
            keep = order[np.r_[True, key[1:] != key[:-1]]] if len(order) else order
            size = (ends - first)[keep]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            parts.append((runs.key[hit][keep], doc[keep], size, d[np.repeat(first[keep], size) + within], _bucket(runs.seed[hit][keep], buckets)))
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.int64))
        key, doc, size, text, bucket = (np.concatenate(x) for x in zip(*(parts or [empty])))
        # once more over the chunks of the block
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, key))
        keep = order[np.r_[True, key[order][1:] != key[order][:-1]]] if len(order) else order
        order, present, cuts = _pack(bucket[keep], buckets)
        keep = keep[order]
        size = size[keep]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text = text[np.repeat(begin[keep], size) + within]
        bytes_at = np.r_[0, np.cumsum(size)]
        block = table.column("block")[0].as_py() if table.num_rows else -1
        return pa.table({"bucket": pa.array(present, pa.int32()), "block": pa.array(np.full(len(present), block), pa.int32()),
                         "keys": pa.array(_cut(key[keep], cuts, present), pa.binary()),
                         "docs": pa.array(_cut(doc[keep], cuts, present), pa.binary()),
                         "sizes": pa.array(_cut(size.astype(np.uint16), cuts, present), pa.binary()),
                         "texts": pa.array([text[bytes_at[cuts[b]]:bytes_at[cuts[b + 1]]].tobytes() for b in present], pa.binary())})
    return run


def _sort_bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        key, counts = X.joined(table.column("keys"), np.uint64)
        doc, _ = X.joined(table.column("docs"), np.int64)
        size = X.joined(table.column("sizes"), np.uint16)[0].astype(np.int64)
        text, _ = X.joined(table.column("texts"), np.uint8)
        block = np.repeat(table.column("block").combine_chunks().to_numpy(), counts)
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, key))
        new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.empty(0, bool)
        keep = order[new]                                        # distinct texts, each with its smallest id
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        n = size[keep]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        distinct = text[np.repeat(begin[keep], n) + within]
        at = np.cumsum(n) - n
        windows = n - length + 1
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = np.repeat(at, windows) + offset
        least = repeated_starts(distinct, starts, np.repeat(doc[keep], windows), length) if len(starts) else np.empty(0, np.int64)
        # per entry: the bit of every start at which a smaller id has the same bytes
        rows = np.cumsum(windows) - windows
        take = windows[which]
        bit = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        smaller = least[np.repeat(rows[which], take) + bit] < np.repeat(doc, take)
        mask = np.add.reduceat(np.where(smaller, np.uint64(1) << bit.astype(np.uint64), np.uint64(0)), np.cumsum(take) - take) if len(take) else np.empty(0, np.uint64)
        hit = np.flatnonzero(mask)
        by = hit[np.argsort(block[hit], kind="stable")]
        b = block[by]
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, np.int64)
        ends = np.r_[cut[1:], len(b)]
        return pa.table({"block": pa.array(b[cut], pa.int32()), "tag": pa.array(np.ones(len(cut)), pa.int32()),
                         "a": pa.array([key[by[i:j]].tobytes() for i, j in zip(cut, ends)], pa.binary()),
                         "b": pa.array([mask[by[i:j]].tobytes() for i, j in zip(cut, ends)], pa.binary())})
    return run


def _finish(length: int, texts: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        key, _ = X.joined(answers.column("a"), np.uint64)
        mask, _ = X.joined(answers.column("b"), np.uint64)
        order = np.argsort(key)
        key, mask = key[order], mask[order]
        ids = _ids(table) if table.num_rows else np.empty(0, np.int64)
        every, own = [], []
        for a, _, o, runs in _table_runs(table, length):         # the smallest id of each run's text in this block
            every.append(runs.key)
            own.append(ids[a + np.searchsorted(o, runs.first, "right") - 1])
        all_keys, all_docs = np.concatenate(every or [np.empty(0, np.uint64)]), np.concatenate(own or [np.empty(0, np.int64)])
        order = np.lexsort((all_docs, all_keys))
        all_keys, all_docs = all_keys[order], all_docs[order]
        new = np.r_[True, all_keys[1:] != all_keys[:-1]] if len(order) else np.empty(0, bool)
        all_keys, all_docs = all_keys[new], all_docs[new]
        cols: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_text": []}
        for a, d, o, runs in _table_runs(table, length):
            doc = ids[a + np.searchsorted(o, runs.first, "right") - 1]
            windows = runs.last - runs.first + 1
            bits = np.zeros(len(windows), np.uint64)
            if len(key):
                at = np.minimum(np.searchsorted(key, runs.key), len(key) - 1)
                bits = np.where(key[at] == runs.key, mask[at], np.uint64(0))
            if len(windows):
                here = all_docs[np.searchsorted(all_keys, runs.key)] < doc
                bits = np.where(here, np.uint64(0xFFFFFFFFFFFFFFFF), bits)
            cover = np.zeros(len(d) + 1, np.int32)
            hit = np.flatnonzero(bits)
            take = windows[hit]
            bit = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            gone = (np.repeat(bits[hit], take) >> bit.astype(np.uint64)) & np.uint64(1) > 0
            start = (np.repeat(runs.first[hit], take) + bit)[gone]
            cover[:len(d) + 1] += np.bincount(start, minlength=len(d) + 1).astype(np.int32)
            cover -= np.bincount(start + length, minlength=len(d) + 1).astype(np.int32)
            removed = np.cumsum(cover)[:len(d)] > 0
            edge = removed.copy()
            edge[1:] &= ~removed[:-1]
            at = o[:-1][o[:-1] < len(d)]
            edge[at] = removed[at]
            cols["n_bytes"].append(np.diff(o))
            cols["n_removed"].append(X.per_doc_sum(removed, o))
            cols["n_spans"].append(X.per_doc_sum(edge, o))
            kept = d[~removed]
            ko = np.r_[0, np.cumsum(np.diff(o) - cols["n_removed"][-1])]
            raw = kept.tobytes()
            pieces = [raw[ko[i]:ko[i + 1]] for i in range(len(o) - 1)]
            cols["kept_sha256"] += [hashlib.sha256(p).hexdigest() for p in pieces]
            if texts:                                            # a cut can split a character
                cols["kept_text"] += [p.decode("utf-8", "ignore") for p in pieces]
        number = lambda k: pa.array(np.concatenate(cols[k]) if cols[k] else np.empty(0, np.int64), pa.int64())
        out = {"doc_id": table.column("doc_id").cast(pa.int64()), "n_bytes": number("n_bytes"), "n_removed": number("n_removed"),
               "n_spans": number("n_spans"), "kept_sha256": pa.array(cols["kept_sha256"], pa.string())}
        if texts:
            out["kept_text"] = pa.array(cols["kept_text"], pa.string())
        return pa.table(out)
    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, groups: int | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) of every row of ``docs``.

    ``length``: bytes of a repeated string, 32 to 64. ``groups``: number of blocks, with twice as
    many buckets. Unless given, both follow from the texts' measured bytes (``BLOCK_BYTES``,
    ``BUCKET_BYTES``), and are one and two per shuffle partition at least. A block and a bucket
    exchange one row, so smaller blocks multiply the rows. Rows that repeat an id with
    different texts are spread over the blocks; equal rows stay in one."""
    if not 32 <= length <= 64:                                       # ranks reach 64 bytes: beyond, equal strings need not be neighbours
        raise ValueError("length must be between 32 and 64")
    buckets = 2 * groups if groups else None
    if not groups:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        groups, buckets = max(parts, -(-size // BLOCK_BYTES)), max(2 * parts, -(-size // BUCKET_BYTES))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("block"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = lambda: rows.groupBy("block")
    seeds = blocks().applyInArrow(_send_seeds(buckets, length), "bucket int, block int, seeds binary, shared binary")
    answers = seeds.groupBy("bucket").applyInArrow(_answer_seeds, _TO_BLOCK)
    runs = blocks().cogroup(answers.groupBy("block")).applyInArrow(
        _send_runs(buckets, length), "bucket int, block int, keys binary, docs binary, sizes binary, texts binary")
    masks = runs.groupBy("bucket").applyInArrow(_sort_bucket(length), _TO_BLOCK)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts
    return blocks().cogroup(masks.groupBy("block")).applyInArrow(_finish(length, texts), schema)
