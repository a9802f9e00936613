"""URL filters by temporal list join.

List entries are dated: from ``listed_at`` on, a host, domain or URL prefix is blocked or
allowed, or taken off the list (``remove``). Entries of one value become validity intervals
that end where its next entry begins. Every capture is judged by the entries active when it
was fetched: the keys of its URL (the host, its parent domains, the prefixes of its path)
are looked up by an as-of join, an equi-join on (key, month) with the interval condition,
where intervals are dealt into the months they cover within the captures' time range.
The longest matching value decides: prefix over host over domain.

Equal (URL, time) captures are judged once and the verdict joined back. Hot hosts are split
by adaptive execution (both joins are inner or left equi-joins), and list intervals per key
and month are few.

Edge cases: captures with a null url or time match nothing (verdict ``none``); hosts are
compared in lower case without port and user; entries with a null column are ignored; of
entries of one value and time, allow wins over block and block over remove; entry times are
inclusive, so a capture at the very time of an entry is judged by it. Repeated captures are
reported as often as they come. Extra columns pass through, whatever their names, but for those
named like a column of the result (``verdict``, ...), which give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_URL = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def url_keys(url: Column) -> Column:
    """Keys of a url: array of structs (kind, value)."""
    low = F.lower(F.trim(url))
    host = F.regexp_extract(low, _URL, 1)
    path = F.regexp_extract(F.trim(url), "(?i)" + _URL, 2)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path, "/")                       # "", "a", "b": prefixes host/, host/a/, host/a/b
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(
        host, F.array_join(F.slice(steps, F.lit(1), i), "/"), F.when(i < F.size(steps), F.lit("/")).otherwise(F.lit(""))))
    kind = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))
    every = F.concat(kind("domain", domains), kind("host", F.array(host)), kind("prefix", F.array_distinct(prefixes)))
    return F.when(host != "", every)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """kind, value, action, valid_from, valid_to (null: open) of dated entries; removals end an interval and start none."""
    value = F.when(F.col("kind") == "prefix", F.col("value")).otherwise(F.lower("value"))
    known = entries.select("kind", value.alias("value"), "action", "listed_at").dropna()
    one = known.groupBy("kind", "value", "listed_at").agg(F.min("action").alias("action"))
    after = F.lead("listed_at").over(W.partitionBy("kind", "value").orderBy("listed_at"))
    return one.select("kind", "value", "action", F.col("listed_at").alias("valid_from"), after.alias("valid_to")).where("action <> 'remove'")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched_at, ...) with verdict (block, allow, none), matched_kind, matched_value, listed_at."""
    low, high = captures.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    month = lambda c: F.date_trunc("month", c)
    lists = validity_intervals(entries)
    if low is not None:
        lists = lists.where((F.col("valid_from") <= F.lit(high)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(low))))
    lists = lists.select("*", F.explode(F.sequence(
        month(F.greatest("valid_from", F.lit(low))), month(F.least(F.coalesce("valid_to", F.lit(high)), F.lit(high))), F.expr("interval 1 month"))).alias("month")) \
        if low is not None else lists.withColumn("month", F.col("valid_from")).limit(0)
    # dealt anew, since a url has many keys: what fits one task before need not after
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = captures.select("url", "fetched_at").dropna().distinct().repartition(parts, "url", "fetched_at")
    keys = distinct.select("url", "fetched_at", month(F.col("fetched_at")).alias("month"), F.explode(url_keys(F.col("url"))).alias("k"))
    hit = (keys.select("url", "fetched_at", "month", "k.kind", "k.value").join(lists, ["kind", "value", "month"])
           .where((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))))
    weight = F.when(F.col("kind") == "prefix", 2).when(F.col("kind") == "host", 1).otherwise(0)
    best = hit.groupBy("url", "fetched_at").agg(F.max(F.struct(weight.alias("w"), F.length("value").alias("n"), "value", "kind", "action", "valid_from")).alias("m"))
    left, right = captures.alias("__capture"), best.alias("__best")
    same = (F.col("__capture.url") == F.col("__best.url")) & (F.col("__capture.fetched_at") == F.col("__best.fetched_at"))
    found = {"verdict": F.coalesce("__best.m.action", F.lit("none")), "matched_kind": F.col("__best.m.kind"),
             "matched_value": F.col("__best.m.value"), "listed_at": F.col("__best.m.valid_from")}
    kept = [F.col(f"__capture.`{c}`") for c in captures.columns if c not in found]
    return left.join(right, same, "left").select(*kept, *(c.alias(name) for name, c in found.items()))
