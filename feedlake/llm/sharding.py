"""Sharding by balanced label propagation.

Linked documents share a hub (here: the same text); a hub of m documents stands for the
links between them without listing pairs. Every document has a label, its shard. In a round,

1. the labels of each hub are counted (one row per hub and shard, summed before the shuffle);
   its leading shards are the most frequent ones, as many as its size needs of full shards;
2. a join gives each linked document its hubs' votes: for its own shard if that leads, and for
   one leading shard; the shard with most votes is where it wants to go;
3. the wishes from shard to shard are counted, and the driver (which sees one number per pair
   of shards) lowers them to quotas such that no shard takes in more than it has room for and
   sends away;
4. of the documents that want the same move, those with the largest gain go, as many as the
   quota says.

Documents without links cost no cut wherever they are; they fill what the linked ones leave
of each shard. So all shards hold the same number of rows, or one more (law ``rows``).

Ranks among many rows (who goes, slots) are computed in two steps: counts per hash bucket,
cumulated, plus the row number within one bucket, so no task sees all rows of a shard.
Every round is a written table of ids; texts are read once and never shuffled.

Edge cases: a null text has no bytes and counts as an empty one, also as a link; a null id is
reported as null; rows that repeat an id, or a whole row, are placed one by one; fewer rows
than shards leave shards empty; an empty table gives no rows. Extra columns are ignored
unless named in ``carry``. Which of several equal rows goes where depends on the order of the input's rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from feedlake.session import materialize

SHARDS = 40
ROUNDS = 6
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: A round that moves fewer than this share of the linked documents is the last.
SETTLED = 0.001
#: Rows that one bucket of a rank should hold at most, on average, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 512


def dense_ranks(rows: DataFrame, keys: list[str], spread: str, n: int, order: list[Column] = (), name: str = "rank") -> DataFrame:
    """Adds ``name``: a gapless rank from 0 among the rows of equal ``keys``, ascending by ``order``.

    ``rows`` should be a written table of about ``n`` rows, ``spread`` a column that differs
    between them. ``order`` must have few values; ties are by bucket, then by ``spread``."""
    buckets = max(LEAST_BUCKETS, n // BUCKET_ROWS)
    cells = [*keys, *(f"__o{i}" for i in range(len(order))), "__b"]
    rows = rows.withColumns({f"__o{i}": c for i, c in enumerate(order)} | {"__b": F.pmod(F.xxhash64(spread), F.lit(buckets))})
    within = W.partitionBy(*keys).orderBy(*cells[len(keys):])
    counts = rows.groupBy(*cells).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(within.rowsBetween(W.unboundedPreceding, -1))).drop("__n")
    at = F.row_number().over(W.partitionBy(*cells).orderBy(spread)) - 1
    return (rows.join(before, cells).withColumn(name, (F.coalesce("__before", F.lit(0)) + at).cast("long"))
            .drop("__before", *cells[len(keys):]))


def row_quotas(n: int, shards: int) -> np.ndarray:
    """Rows of each shard: equal, or one more for the first ones."""
    return n // shards + (np.arange(shards) < n % shards).astype(np.int64)


def grant(wishes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Moves granted from shard to shard: at most the wishes, and into no shard more than its room and what leaves it."""
    moves = wishes.astype(np.int64).copy()
    np.fill_diagonal(moves, 0)
    while True:
        excess = np.maximum(moves.sum(axis=0) - moves.sum(axis=1) - room, 0)
        if not excess.any():
            return moves
        for b in np.flatnonzero(excess):
            column, less = moves[:, b], int(excess[b])
            cut = np.minimum(column, less * column // max(int(column.sum()), 1))
            rest = less - int(cut.sum())
            for a in np.argsort(cut - column, kind="stable"):                # the remainder from the largest ones
                take = min(rest, int(column[a] - cut[a]))
                cut[a] += take
                rest -= take
                if not rest:
                    break
            moves[:, b] = column - cut


def propose(members: DataFrame, place: DataFrame, quota: int, room: np.ndarray, step: int = 0) -> DataFrame:
    """node, shard, target, gain of every node that would rather be elsewhere.

    ``members``: node, hub; ``place``: node, shard. ``quota``: rows of a full shard. Of several
    leading shards, one with ``room`` is picked if there is any, another one in another ``step``."""
    labelled = members.join(place, "node")
    counts = labelled.groupBy("hub", "shard").agg(F.count("*").alias("n"))
    # by count, then by a hash that differs from hub to hub, so that ties do not favour one shard
    ranked = counts.groupBy("hub").agg(F.sum("n").alias("size"), F.sort_array(
        F.collect_list(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")), asc=False).alias("labels"))     # at most one per shard
    leading = ranked.select("hub", F.slice("labels", F.lit(1), F.ceil(F.col("size") / F.lit(max(quota, 1))).cast("int")).alias("lead"))
    votes = labelled.join(leading, "hub").withColumn("own", F.get(F.filter("lead", lambda x: x["shard"] == F.col("shard")), F.lit(0)))
    free = F.array(*(F.lit(bool(x > 0)) for x in room))
    votes = votes.withColumn("open", F.filter("lead", lambda x: F.element_at(free, x["shard"] + 1)))
    votes = votes.withColumn("open", F.when(F.size("open") > 0, F.col("open")).otherwise(F.col("lead")))
    pick = F.element_at("open", (F.pmod(F.xxhash64("node", "hub", F.lit(step)), F.size("open")) + 1).cast("int"))
    choice = F.when(F.col("own").isNotNull(), F.struct(F.col("shard").alias("s"), (F.col("own.n") - 1).alias("w"))).otherwise(
        F.struct(pick["shard"].alias("s"), pick["n"].alias("w")))
    sums = votes.select("node", "shard", choice.alias("c")).groupBy("node", "shard", "c.s").agg(F.sum("c.w").alias("w"))
    best = sums.groupBy("node", "shard").agg(F.max(F.struct("w", (F.col("s") == F.col("shard")).alias("stay"), F.col("s").alias("target"))).alias("best"),
                                             F.max(F.when(F.col("s") == F.col("shard"), F.col("w"))).alias("here"))
    return (best.where("best.target <> shard").select("node", "shard", "best.target", (F.col("best.w") - F.coalesce("here", F.lit(0))).alias("gain"))
            .where("gain > 0"))


def propagate(members: DataFrame, place: DataFrame, quotas: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """node, shard after at most ``rounds`` rounds; no shard gets more than its quota of the placed nodes.

    ``members`` (node, hub) and ``place`` (node, shard) should be written tables."""
    shards, n = len(quotas), place.count()
    spark = place.sparkSession
    for step in range(rounds):
        held = np.zeros(shards, np.int64)
        for r in place.groupBy("shard").count().collect():                   # one number per shard
            held[r["shard"]] = r["count"]
        movers = materialize(propose(members, place, int(quotas.max(initial=1)), quotas - held, step), "shard-wishes")
        wishes = np.zeros((shards, shards), np.int64)
        for r in movers.groupBy("shard", "target").count().collect():        # one number per pair of shards
            wishes[r["shard"], r["target"]] = r["count"]
        moves = grant(wishes, quotas - held)
        moved = int(moves.sum())
        if not moved:
            break
        limits = spark.createDataFrame([(int(a), int(b), int(moves[a, b])) for a, b in np.argwhere(moves)], "shard int, target int, quota long")
        # larger gains first, in powers of two
        ranked = dense_ranks(movers, ["shard", "target"], "node", int(wishes.sum()), [-F.floor(F.log2("gain"))])
        going = ranked.join(F.broadcast(limits), ["shard", "target"]).where("rank < quota").select("node", "target")     # at most shards * shards rows
        place = materialize(place.join(going, "node", "left").select("node", F.coalesce("target", "shard").alias("shard")), "shard-round")
        if moved < SETTLED * n:
            break
    return place


def cut_links(placed: DataFrame, hub: Column) -> DataFrame:
    """links, cut: pairs of rows of one hub, and those whose ends lie in different shards (from counts, no pairs are made)."""
    per = placed.groupBy(hub.alias("hub"), "shard").agg(F.count("*").cast("decimal(19,0)").alias("n"))
    hubs = per.groupBy("hub").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("together"))
    links = F.sum(F.col("m") * (F.col("m") - 1) / 2)
    return hubs.agg(links.cast("long").alias("links"), (links - F.sum("together")).cast("long").alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, carry: list[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns in ``carry`` of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = materialize(docs.select(F.col("doc_id").cast("long"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
                                   F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.md5(body.cast("binary"))).alias("hub"),
                                   F.monotonically_increasing_id().alias("node"), *carry), "shard-rows")
    # written, so that the join below has an exchange of its own, whose hot groups can be split
    linked = materialize(base.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"), "shard-hubs")
    base = materialize(base.join(linked, "hub", "left").withColumn("linked", F.col("n").isNotNull()).drop("n"), "shard-linked")
    n, m = base.agg(F.count("*"), F.coalesce(F.count_if("linked"), F.lit(0))).first()
    quotas = row_quotas(n, shards)
    members = base.where("linked").select("node", "hub")
    start = dense_ranks(members.select("node"), [], "node", m).select("node", (F.col("rank") % shards).cast("int").alias("shard"))
    place = propagate(members, materialize(start, "shard-start"), quotas, rounds) if m else start

    held = np.zeros(shards, np.int64)
    for r in place.groupBy("shard").count().collect():
        held[r["shard"]] = r["count"]
    # what the linked rows leave of each quota is filled by the others, in the order of their ranks
    bounds = np.cumsum(quotas - held)
    rest = dense_ranks(base.where("not linked"), [], "node", n - m)
    ends = F.array(*(F.lit(int(x)) for x in bounds))
    rest = rest.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("rank"))))
    start_of = F.array(*(F.lit(int(h - b)) for h, b in zip(held, np.r_[0, bounds[:-1]])))
    rest = rest.withColumn("slot", F.col("rank") + F.element_at(start_of, F.col("shard") + 1)).drop("rank")
    first = dense_ranks(place, ["shard"], "node", m, name="slot")
    whole = base.where("linked").join(first, "node").unionByName(rest)
    return whole.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"),
                        F.lit(None).cast("int").alias("grown_shard"), *carry)


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes one folder per shard, sorted by slot in each file; large shards are split over tasks by slot."""
    rows = F.floor(F.col("slot") / 1_000_000)
    placed.repartition("shard", rows).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
