"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents of equal
sets are one class from the start (grouped by size and a 128-bit fingerprint, with map-side
aggregation), and of large classes only the representative is listed at all. Two sets of s <= t shingles link if they share
at least c(s, t) = ceil(S (s + t) / (100 + S)) of them (S = similarity in percent).

* Light sets (at most ``boundary`` shingles): every size pair (s, t) that can link has a
  fixed c(s, t); a set emits all its c(s, t)-subsets, and a set of s and one of t shingles
  that share a subset link without further checks. Two sets of the larger size that meet
  there need not link: they have subsets of their own size pair.
* Heavy sets: inverted lists over the first s - ceil(S s / 100) + 1 shingles of a set in one
  global order, rare shingles first (frequent ones are counted over the whole corpus).
  Linking sets share a listed shingle. Light sets that could link with a heavy one are
  listed, too.
* The boundary is the one with the least estimated cost: subsets emitted below it against
  list entries, weighted by the mean list length, above it.

The members of a list are not paired. Each list picks a pivot, each member takes
the pivot that most of its lists have and is verified against it exactly (shingle sets of
both texts), and linked members form components; this is repeated with other pivots. Only members of
a list that are still in different components are paired and verified in the last round, so
every link between components is found, while a group of m near copies costs about m
comparisons instead of m * m. Before texts are fetched, a bound drops most pairs: sets whose
parity signatures (shingle hashes folded by exclusive or) differ in H bits share at most
(s + t - H) / 2 shingles.

Edge cases: null texts and texts without words have an empty set, link with nothing and are
their own component; texts of fewer words than a shingle count as one shingle; words are
lower-cased (A-Z). Rows that repeat an id are one node: their component is shared, each
row keeps its own n_shingles, and of their different texts the least one (in byte order)
is compared with others in the lists. Rows with a null id take no part in links and get a null component_id.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from feedlake.llm import textops as X
from feedlake.llm.components import connected_components
from feedlake.session import materialize

SHINGLE = 5
SIMILARITY = 80
#: Largest boundary that the cost choice considers.
MAX_LIGHT = 16
#: Most frequent shingles whose counts order the lists (8 bytes each when broadcast). The
#: bound touches cost only: any one global order gives the same links.
FREQUENT = 1 << 19
#: Repeats within a chunk from which a shingle is reported as possibly frequent.
LOCAL_REPEATS = 2
PIVOT_ROUNDS = 2

#: Classes of copies that are told to every task, the largest ones (about 40 bytes each), and the
#: least number of their rows. The bound touches cost only: entries of other copies are dropped later.
KNOWN_CLASSES, CLASS_ROWS = 1 << 14, 16
#: List entries that one bucket should hold.
BUCKET_ENTRIES = 1 << 19

#: Members of a list that are compared with each other at once.
BLOCK = 1024
#: 64-bit words of a set's parity signature, at least.
SIGNATURE_WORDS = 32

#: Kinds of list entries: a shingle of a list, a subset of sets of one size, a subset of sets of
#: two sizes. OFTEN is added if the shingle, or every one of the subset, is known to be frequent.
LISTED, SAME, MIXED, OFTEN = 0, 1, 2, 4

_KEY = np.uint64(0x6A09E667F3BCC909)


def overlap(s: int, t: int, similarity: int = SIMILARITY) -> int:
    """Least shared shingles at which sets of s and t shingles link."""
    return -(-similarity * (s + t) // (100 + similarity))


def prefix_length(s: int, similarity: int = SIMILARITY) -> int:
    return s - -(-similarity * s // 100) + 1


def partners(s: int, similarity: int = SIMILARITY) -> range:
    """Sizes of the sets that can link with a set of s shingles."""
    return range(-(-similarity * s // 100), 100 * s // similarity + 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, sorted within it, and the cuts between documents."""
    words = X.Words(data, offs, lower=True)
    at, h = words.windows(k)
    doc = words.doc[at]
    for d in np.flatnonzero((words.counts > 0) & (words.counts < k)):       # the whole sequence is the shingle
        own = words.hashes[words.bounds[d]:words.bounds[d + 1]]
        h = np.append(h, X.mix(np.add.reduce(own * X._STEP[:len(own)], keepdims=True) + X.mix(_KEY + np.array([len(own)], np.uint64))))
        doc = np.append(doc, d)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offs)))


def _chunk_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = X.utf8(column)
    for a, b, d, o in X.chunks(data, offs):
        yield a, b, *shingle_sets(d, o, k)


def _fingerprints(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every set, as two columns."""
    total = [np.r_[np.uint64(0), np.cumsum(X.mix(h ^ salt))] for salt in (_KEY, X._STEP[1])]
    return tuple(t[cuts[1:]] - t[cuts[:-1]] for t in total)


def describe_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint), bits (signature) per row, and (kind 1) shingles repeated within a chunk with their count."""
    names = ["kind", "doc_id", "n_shingles", "f1", "f2", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, cuts in _chunk_sets(batch.column(1), k):
                f1, f2 = _fingerprints(h, cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(b - a, np.int32)), batch.column(0).slice(a, b - a), pa.array(np.diff(cuts).astype(np.int64)),
                     pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), _signatures(h, cuts)], names=names)
                s = np.sort(h)
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
                n = np.diff(np.r_[first, len(s)])
                often = n >= LOCAL_REPEATS
                m = int(often.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(m, np.int32)), pa.array([None] * m, pa.int64()), pa.array(n[often].astype(np.int64)),
                     pa.array(s[first][often].view(np.int64)), pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.list_(pa.int64()))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(X.lean(run), "kind int, doc_id long, n_shingles long, f1 long, f2 long, bits array<long>")


def _signatures(h: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Parity of the set's shingles per signature bit, as 64-bit words; null for the empty set.

    A signature has as many bits as the set has shingles, rounded up to a power of two, and
    ``64 * SIGNATURE_WORDS`` at least; halves can be folded onto each other."""
    size = np.diff(cuts)
    width = np.where(size > 0, 64 * SIGNATURE_WORDS, 0)
    large = size > 64 * SIGNATURE_WORDS
    width[large] = 1 << np.ceil(np.log2(size[large])).astype(np.int64)
    at = np.r_[0, np.cumsum(width)]
    cell = np.repeat(at[:-1], size) + (h & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64)
    odd = np.zeros(at[-1], bool)
    order = np.sort(cell)
    first = np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else np.empty(0, np.int64)
    odd[order[first]] = np.diff(np.r_[first, len(order)]) & 1
    words = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array((at // 64).astype(np.int32)), pa.array(words), mask=pa.array(size == 0))


def choose_boundary(sizes: dict[int, int], list_length: float, similarity: int = SIMILARITY, most: int = MAX_LIGHT) -> int:
    """Largest light size, by cost: subsets of the light sets plus entries of the listed sets times the mean list length."""
    subsets = {s: sum(math.comb(s, c) for t in partners(s, similarity) if t and (c := overlap(s, t, similarity)) <= s) for s in range(1, most + 1)}

    def cost(x: int) -> float:
        light = sum(n * subsets[s] for s, n in sizes.items() if s <= x)
        lowest = -(-similarity * (x + 1) // 100)
        return light + sum(n * prefix_length(s, similarity) * (1 + list_length) for s, n in sizes.items() if lowest <= s <= most + most // 4 + 1)
    return min(range(most + 1), key=lambda x: (cost(x), x))


def _subset_keys(own: np.ndarray, hot: np.ndarray, boundary: int, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every subset that a light set shares with the sets it links with, one family per size pair,
    another 64 bits of it, and its kind. ``hot``: which shingles are frequent."""
    s, rare = len(own), (~hot).astype(np.int64)
    keys, checks, kinds = [], [], []
    mixed, again = X.mix(own + _KEY), X.mix(own ^ X._STEP[3])
    whole, whole_again = np.add.reduce(mixed, keepdims=True), np.add.reduce(again, keepdims=True)
    for t in partners(s, similarity):
        if not 0 < t <= boundary or (c := overlap(s, t, similarity)) > s:
            continue
        low, high = min(s, t), max(s, t)
        left = np.array(list(combinations(range(s), s - c)), np.int64).reshape(math.comb(s, c), s - c)     # the shingles left out
        keys.append(X.mix(whole - mixed[left].sum(axis=1, dtype=np.uint64) + np.array([low * 1000 + high], np.uint64) * X._STEP[2]))
        checks.append(X.mix(whole_again - again[left].sum(axis=1, dtype=np.uint64) + np.array([low * 1000 + high], np.uint64) * X._STEP[4]))
        kinds.append(np.where(rare[left].sum(axis=1) == rare.sum(), OFTEN, 0).astype(np.int8) + np.int8(SAME if s == t else MIXED))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int8)
    return np.concatenate(keys), np.concatenate(checks), np.concatenate(kinds)


def list_entries(docs: DataFrame, frequent: np.ndarray, boundary: int, k: int, similarity: int, buckets: int, copied: np.ndarray) -> DataFrame:
    """Packed entries per bucket of keys: subset keys of light sets, listed shingles of the others.

    ``frequent``: shingles by falling count; they come last in the global order, and their
    entries are dealt to buckets by document, not by key. ``copied``: fingerprint and
    representative (3 columns, sorted) of large classes, whose other rows have no entries."""
    lowest = -(-similarity * (boundary + 1) // 100)
    place = np.argsort(frequent)
    known = frequent[place]
    known_rank = (len(frequent) - place).astype(np.uint64)           # the most frequent one is last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, h, cuts in _chunk_sets(batch.column(1), k):
                size = np.diff(cuts)
                if len(copied):
                    f1, f2 = _fingerprints(h, cuts)
                    at = np.minimum(np.searchsorted(copied[:, 0], f1), len(copied) - 1)
                    other = (copied[at, 0] == f1) & (copied[at, 1] == f2) & (copied[at, 2] != ids[a:b].astype(np.int64).view(np.uint64))
                    h, size = h[np.repeat(~other, size)], np.where(other, 0, size)
                    cuts = np.r_[0, np.cumsum(size)]
                doc = np.repeat(np.arange(b - a), size)
                order_key = h.copy()
                hot = np.zeros(len(h), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hot = known[at] == h
                    order_key = np.where(hot, np.uint64(0x8000000000000000) + known_rank[at], h >> np.uint64(1))
                order = np.lexsort((order_key, doc))
                rank = np.arange(len(h)) - np.repeat(cuts[:-1], size)
                limit = np.where(size >= max(1, lowest), size - -(-similarity * size // 100) + 1, 0)
                listed = rank < limit[doc]
                key, owner, kind = [h[order][listed]], [doc[listed]], [np.where(hot[order][listed], OFTEN | LISTED, LISTED).astype(np.int8)]
                check = [np.zeros(len(key[0]), np.uint64)]
                for d in np.flatnonzero((size > 0) & (size <= boundary)):
                    own, own_check, own_kind = _subset_keys(h[cuts[d]:cuts[d + 1]], hot[cuts[d]:cuts[d + 1]], boundary, similarity)
                    key.append(own)
                    owner.append(np.full(len(own), d))
                    kind.append(own_kind)
                    check.append(own_check)
                key, owner, kind, check = (np.concatenate(x) for x in (key, owner, kind, check))
                node = ids[a:b].astype(np.int64)[owner]
                bucket = (X.mix(np.where(kind & OFTEN, X.mix(node.view(np.uint64)), key)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, owner, kind, check, node = key[order], owner[order], kind[order], check[order], node[order]
                at = np.searchsorted(bucket[order], np.arange(buckets + 1))
                present = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present, pa.int32()), *(pa.array([v[at[p]:at[p + 1]].tobytes() for p in present], pa.binary())
                     for v in (key, check, node, np.minimum(size[owner], 2**31 - 1).astype(np.int32), kind))],
                    names=["bucket", "keys", "checks", "docs", "sizes", "kinds"])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(X.lean(run), "bucket int, keys binary, checks binary, docs binary, sizes binary, kinds binary")


def _shared_keys(table: pa.Table) -> pa.Table:
    """One bucket: the entries of keys that two documents or more have, each once, and all entries of frequent shingles."""
    key, _ = X.joined(table.column("keys"), np.uint64)
    check, _ = X.joined(table.column("checks"), np.uint64)
    doc, _ = X.joined(table.column("docs"), np.int64)
    size, _ = X.joined(table.column("sizes"), np.int32)
    kind, _ = X.joined(table.column("kinds"), np.int8)
    order = np.lexsort((size, doc, check, key, kind))
    key, check, doc, size, kind = key[order], check[order], doc[order], size[order], kind[order]
    if len(key):                                                 # rows that repeat an id bring equal entries
        new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (kind[1:] != kind[:-1])]
        once = new | np.r_[True, (doc[1:] != doc[:-1]) | (size[1:] != size[:-1])]
        key, check, doc, size, kind, new = key[once], check[once], doc[once], size[once], kind[once], new[once]
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, len(key)])
        several = np.repeat(doc[first] != doc[np.r_[first[1:], len(key)] - 1], n) | (kind & OFTEN > 0)
        key, check, doc, size, kind = key[several], check[several], doc[several], size[several], kind[several]
    kind = kind & np.int8(~OFTEN)
    return pa.table({"key": pa.array(key.view(np.int64)), "check": pa.array(check.view(np.int64)), "doc": pa.array(doc),
                     "size": pa.array(size), "kind": pa.array(kind)})


def _light_links(subsets: DataFrame) -> DataFrame:
    """Links (a, b) between light sets that share a subset: in a family of one size to its least member,
    in a family of two sizes to the least member of the other size."""
    # the complement turns the greatest of (size, ~doc) into the least doc of the larger size
    ends = subsets.groupBy("kind", "key", "check").agg(F.min(F.struct("size", "doc")).alias("low"),
                                              F.max(F.struct("size", F.bitwise_not("doc").alias("other"))).alias("high"))
    least_high = F.bitwise_not("high.other")
    other = (F.when(F.col("kind") == SAME, F.col("low.doc")).when(F.col("size") < F.col("high.size"), least_high)
             .when(F.col("low.size") < F.col("size"), F.col("low.doc")))
    return subsets.join(ends, ["kind", "key", "check"]).select(F.col("doc").alias("a"), other.alias("b")).where("a <> b")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose texts link; only their texts are fetched, the least one of a repeated id."""
    needed = materialize(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "jaccard-needed")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(needed, "doc", "left_semi")
             .groupBy("doc").agg(F.min("text").alias("text")))
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
            for i in range(batch.num_rows):
                pair = []
                for c in (2, 3):
                    text = batch.column(c)[i].as_py()
                    if c == 3 and text == last[0]:               # pairs of one pivot follow each other
                        pair.append(last[1])
                        continue
                    raw = np.frombuffer(text.encode(), np.uint8)
                    own = shingle_sets(raw, np.array([0, len(raw)]), k)[0]
                    if c == 3:
                        last = (text, own)
                    pair.append(own)
                x, y = pair
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(X.lean(run), "a long, b long")


def _fits(similarity: int):
    return F.lit(100) * F.least("size", "psize") >= F.lit(similarity) * F.greatest("size", "psize")


def _possible(pairs: DataFrame, bits: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out."""
    def fold(own: str, other: str):
        half = (F.size(own) / 2).cast("int")
        folded = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(own) > F.size(other), folded).otherwise(F.col(own))

    differ = F.aggregate(F.zip_with(fold("x", "y"), fold("y", "x"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    ends = bits.select(F.col("doc").alias("b"), F.col("bits").alias("y")).join(pairs.select("b"), "b", "left_semi")
    both = pairs.join(bits.select(F.col("doc").alias("a"), F.col("bits").alias("x")), "a").join(ends, "b")
    total = F.col("size") + F.col("psize")
    # null: signatures of other sets of a repeated id, which cannot be compared
    allowed = F.lit(100 + similarity) * (total - differ) >= F.lit(2 * similarity) * total
    return both.where(F.coalesce(allowed, F.lit(True))).select("a", "b").distinct()


def _remaining_pairs(at: DataFrame, bits: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b, size, psize) of one list and different components that sizes and short signatures allow.

    Lists of equal members are looked at once. Members are compared in blocks of about
    ``BLOCK``: a task gets two blocks of a list, not the list, and returns only what the
    signatures (folded to the least width) leave."""
    one = (at.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
           .groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).alias("parts")))
    # folded before they are joined: a long set has many entries
    words = F.transform(F.sequence(F.lit(0), F.lit(SIGNATURE_WORDS - 1)), lambda i: F.aggregate(
        F.sequence(i, F.size("bits") - 1, F.lit(SIGNATURE_WORDS)), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get("bits", j))))
    short = bits.select("doc", F.when(F.size("bits") > SIGNATURE_WORDS, words).otherwise(F.col("bits")).alias("bits"))
    members = at.join(one, "key").join(short, "doc").withColumn("own", F.pmod(F.xxhash64("doc", F.lit(2)), F.col("parts")))
    cells = members.select("key", "own", "doc", "size", "component", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    cells = cells.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def run(table: pa.Table) -> pa.Table:
        own, doc, size, component = (table.column(c).combine_chunks().to_numpy() for c in ("own", "doc", "size", "component"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        column = table.column("bits").combine_chunks()
        cuts, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        short = np.array([np.bitwise_xor.reduce(flat[i:j].reshape(-1, SIGNATURE_WORDS), axis=0) for i, j in zip(cuts[:-1], cuts[1:])])
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        found = []
        for i in range(0, len(left), 64):
            x = left[i:i + 64]
            total = size[x][:, None].astype(np.int64) + size[right]
            ok = (component[x][:, None] != component[right]) & (100 * np.minimum(size[x][:, None], size[right]).astype(np.int64) >= similarity * np.maximum(size[x][:, None], size[right]).astype(np.int64))
            if low == high:
                ok &= x[:, None] < right
            u, v = np.nonzero(ok)
            differ = np.bitwise_count(short[x[u]] ^ short[right[v]]).sum(axis=1, dtype=np.int64)
            keep = (100 + similarity) * (total[u, v] - differ) >= 2 * similarity * total[u, v]
            found.append(np.stack([x[u[keep]], right[v[keep]]]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(doc[a]), "b": pa.array(doc[b]), "size": pa.array(size[a]), "psize": pa.array(size[b])})

    return cells.groupBy("key", "low", "high").applyInArrow(X.lean_group(run), "a long, b long, size int, psize int")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY, boundary: int | None = None,
                       groups: int | None = None, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    spark = docs.sparkSession
    described = materialize(describe_sets(docs, k), "jaccard-sets")
    rows = described.where("kind = 0").select("doc_id", "n_shingles", "f1", "f2")
    # written, so that the join below has an exchange of its own, whose hot classes can be split
    classes = materialize(rows.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2")
                          .agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "jaccard-classes")
    large = classes.where(F.col("rows") >= CLASS_ROWS).orderBy(F.desc("rows"), "rep").limit(KNOWN_CLASSES).select("f1", "f2", "rep").toPandas()     # bounded
    copied = large.to_numpy(np.int64).reshape(-1, 3).view(np.uint64)
    copied = copied[np.argsort(copied[:, 0], kind="stable")]
    classes = classes.drop("rows")

    repeated = described.where("kind = 1").groupBy(F.col("f1").alias("h")).agg(F.sum("n_shingles").alias("n"))
    top = repeated.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()              # bounded by FREQUENT
    frequent = top["h"].to_numpy(np.int64).view(np.uint64)
    if boundary is None:
        sizes = dict(rows.where(F.col("n_shingles").between(1, 2 * MAX_LIGHT)).groupBy("n_shingles").count().collect())
        total = rows.agg(F.sum("n_shingles")).first()[0] or 1
        boundary = choose_boundary(sizes, float((top["n"].to_numpy(float) ** 2).sum()) / total, similarity)

    if groups is None:
        listed = rows.agg(F.sum(F.ceil(F.col("n_shingles") * (100 - similarity) / 100) + 1)).first()[0] or 0
        groups = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(listed) // BUCKET_ENTRIES)
    entries = list_entries(docs, frequent, boundary, k, similarity, groups, copied)
    shared = entries.groupBy("bucket").applyInArrow(X.lean_group(_shared_keys), "key long, check long, doc long, size int, kind tinyint")
    # copies are known already: one entry per class (and node)
    node = materialize(rows.where("n_shingles > 0 and doc_id is not null").join(classes, ["n_shingles", "f1", "f2"])
                       .select(F.col("doc_id").alias("doc"), "rep").distinct(), "jaccard-reps")
    reps = node.where("doc = rep").select("doc")
    shared = materialize(shared.join(reps, "doc", "left_semi"), "jaccard-lists")
    copies = node.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    links = materialize(copies.union(_light_links(shared.where(F.col("kind") != LISTED))).distinct(), "jaccard-links")
    lists = shared.where(F.col("kind") == LISTED).select("key", "doc", "size")

    # rows that repeat an id bring a signature each; a pair stays if any two of them allow it
    bits = described.where("kind = 0 and n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("doc"), "bits")
    degree = used = None
    component = connected_components(links)
    for step in range(pivot_rounds + 1):
        # the lists hold class representatives; most are still their own component
        moved = component.where("node <> component").withColumnRenamed("node", "doc").join(reps, "doc", "left_semi")
        at = lists.join(materialize(moved, "jaccard-moved"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        split = (at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
                 .where("low <> high").select("key", "n"))
        at = materialize(at.join(split, "key"), "jaccard-open")
        if at.isEmpty():
            break
        lists = at.select("key", "doc", "size")      # a list within one component stays so
        if degree is None:                           # a text that others were copied from shares more of its lists than its copies do: the best pivots
            degree = materialize(at.groupBy("doc").agg(F.sum("n").alias("degree")), "jaccard-degree")
        if step < pivot_rounds:                      # one pivot per list, another one each round
            free = at.join(degree, "doc")
            free = free if used is None else free.join(used, "doc", "left_anti")
            pivot = materialize(free.groupBy("key").agg(F.max(F.struct("degree", "doc", "size", "component")).alias("p")).select("key", "p"), "jaccard-pivot")
            taken = pivot.select("p.doc").distinct()
            used = materialize(taken if used is None else used.union(taken), "jaccard-pivots")
            # a member takes one pivot, the one that most of its lists have
            pairs = (at.join(pivot, "key").where("component <> p.component")
                     .select(F.col("doc").alias("a"), F.col("p.doc").alias("b"), "size", F.col("p.size").alias("psize")).where(_fits(similarity))
                     .groupBy("a", "b", "size", "psize").agg(F.count("*").alias("votes"))
                     .groupBy("a").agg(F.max(F.struct("votes", "b", "size", "psize")).alias("p")).select("a", "p.b", "p.size", "p.psize"))
        else:
            pairs = _remaining_pairs(at, bits, similarity)
        pairs = materialize(pairs.where(_fits(similarity)).distinct(), "jaccard-candidates")
        pairs = materialize(_possible(pairs, bits, similarity), "jaccard-pairs")
        found = materialize(_verify(pairs, docs, k, similarity), "jaccard-verified")
        if found.isEmpty():
            continue
        component = connected_components(found, known=component)
    out = rows.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_per_component(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that represent their component: the one whose id is the component's.

    Of rows that repeat an id, the first by text and then by the other columns stays; rows
    with a null id stay."""
    chosen = jaccard_components(docs, **settings).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(chosen, "doc_id", "left_semi")
    order = [F.col("text"), F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))]    # maps and variants have no order of their own
    first = kept.withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).where("__n = 1").drop("__n")
    return first.union(docs.where("doc_id is null")).select(*docs.columns)
