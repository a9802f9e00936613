"""Secret scan with multipart credential linking, in DataFrame functions only.

Base patterns (leftmost, non-overlapping, per kind) give strong spans:

* ``assign``: a keyword, a separator and a value of at least 6 characters;
* ``access``: an access identifier, AKIA and at least 16 more characters;
* ``hex``: a run of at least 24 lower-case hexadecimal digits.

Weak candidates are parts that mean little alone: ``secret`` (a 40-character base64 run with
both letter cases and a digit; it may follow an equals sign), ``ident`` (a client, account or user name in an assignment)
and ``endpoint`` (a URL or host with a port). Every part claims a scope, ``reach`` code
points to both sides. An interval join, by cells of ``reach`` code points so that it is an
equi-join, links parts of one document whose scopes hold each other. Weak candidates are
reported only if a complement is in scope: a secret needs an identifier (access, ident) or
an endpoint, an identifier needs a secret (any of assign, hex, secret), an endpoint needs
both an identifier and a secret.

Positions come from regexp_replace: matches are wrapped in two control characters and the
text is split there (control characters of the text itself are replaced by another one
first); running sums over the split lengths are window sums per document. Texts without a
match are filtered by rlike, so only matches are exploded and shuffled, never texts. A cell
holds at most ``reach`` characters, so the join's size is bounded by the matches.

Edge cases: null text is empty; rows that repeat id and text are scanned once and reported
once per row; a null id is matched null-safely; extra columns are ignored. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from feedlake.session import materialize

REACH = 200

_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
#: kind: (pattern, least length of the match, of an assignment's value); in the order of reporting.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"(AKIA)([A-Z0-9]+)", 20),
    "hex": (r"([0-9a-f])([0-9a-f]{23,})", 24),
}
WEAK = {
    "secret": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-]))(?=[^A-Z]{0,39}[A-Z])(?=[^a-z]{0,39}[a-z])(?=[^0-9]{0,39}[0-9])[A-Za-z0-9+/]{40}", 40),
    "ident": (r"""(?i:\b(client_?id|account_?id|access_?key_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", 3),
    "endpoint": (r"(?i:\b(https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://)([A-Za-z0-9._~%:/@-]{4,})", 8),
}
KINDS = [*BASE, *WEAK]
_IDENTIFIERS, _SECRETS = ("access", "ident"), ("assign", "hex", "secret")


#: A run that every hex and secret match lies in.
_LONG_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24}"


def _matches(text: Column, kind: str) -> Column:
    """The text split before every match, each match ended by a mark; null if there is none.

    A cheap condition that the pattern implies is tested first."""
    pattern = {**BASE, **WEAK}[kind][0]
    implied = {"access": text.contains("AKIA"), "hex": F.col("long_run"), "secret": F.col("long_run"), "endpoint": text.contains("://")}.get(
        kind, text.contains("=") | text.contains(":"))
    return F.when(implied & text.rlike(pattern), F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN))


def find_parts(docs: DataFrame) -> DataFrame:
    """doc_id, h, kind (index), start, end of every base match that is long enough and every weak candidate.

    ``h`` is the hash of the text; (doc_id, h) stands for equal rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = F.when(text.rlike("[\x01\x02]"), F.translate(text, _OPEN + _CLOSE, _OTHER * 2)).otherwise(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), clean.alias("text"))
    rows = rows.withColumn("long_run", F.col("text").rlike(_LONG_RUN))
    marked = rows.select("doc_id", "h", F.array(*[
        F.struct(F.lit(i).alias("kind"), _matches(F.col("text"), k).alias("parts")) for i, k in enumerate(KINDS)]).alias("found"))
    some = marked.select("doc_id", "h", F.explode(F.filter("found", lambda x: F.size(x["parts"]) > 1)).alias("f"))
    # one copy of rows with equal id and text, then one row per split part, in order
    once = some.select("doc_id", "h", "f.kind", F.transform("f.parts", _measure).alias("parts")).dropDuplicates(["doc_id", "h", "kind"])
    part = once.select("doc_id", "h", "kind", F.posexplode("parts").alias("pos", "p"))
    before = F.sum(F.col("p.size") + F.col("p.rest")).over(
        W.partitionBy("doc_id", "h", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    spans = part.select("doc_id", "h", "kind", "pos", "p.size", "p.value", F.coalesce(before, F.lit(0)).alias("start")).where("pos > 0")
    least = F.element_at(F.array(*[F.lit({**BASE, **WEAK}[k][1]) for k in KINDS]), F.col("kind") + 1)
    return spans.where(F.col("value") >= least).select("doc_id", "h", "kind", F.col("start").cast("long").alias("start"),
                                                       (F.col("start") + F.col("size")).cast("long").alias("end"))


def _measure(part: Column) -> Column:
    """Lengths of a split part: the match, what follows it, and the value that is tested.

    The first part has no match: it is all rest."""
    has = F.locate(_CLOSE, part) > 0
    match = F.substring_index(part, _CLOSE, 1)
    # the value of an assignment starts after the separator and a quote
    value = F.regexp_replace(match, r"""^(?i:password|passwd|secret|token|api_?key|client_?id|account_?id|access_?key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?""", "")
    return F.struct(F.when(has, F.char_length(match)).otherwise(0).alias("size"),
                    F.when(has, F.char_length(part) - F.char_length(match) - 1).otherwise(F.char_length(part)).alias("rest"),
                    F.when(has, F.char_length(value)).otherwise(0).alias("value"))


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak candidates of ``parts`` that have their complements in scope."""
    of = lambda names: F.col("kind").isin([KINDS.index(k) for k in names])
    role = F.when(of(_IDENTIFIERS), "i").when(of(_SECRETS), "s").otherwise("e")
    some = parts.withColumn("role", role)
    # documents with weak candidates only
    weak = some.where(F.col("kind") >= len(BASE))
    # a part lies in the cells it touches; a scope looks into the cells it reaches
    cells = some.select("doc_id", "h", "role", F.col("start").alias("s"), F.col("end").alias("e"), "kind",
                        F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach))).alias("cell"))
    scope = weak.select("doc_id", "h", "kind", "start", "end", "role",
                        F.explode(F.sequence(F.greatest(F.floor((F.col("start") - reach) / reach), F.lit(0)), F.floor((F.col("end") - 1 + reach) / reach))).alias("cell"))
    a, b = scope.alias("a"), cells.alias("b")
    near = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.cell") == F.col("b.cell"))
                  & (F.col("b.s") <= F.col("a.end") + reach) & (F.col("b.e") >= F.col("a.start") - reach)
                  # not the candidate itself, nor a part over the same characters
                  & ((F.col("b.e") <= F.col("a.start")) | (F.col("b.s") >= F.col("a.end"))))
    flag = lambda r: F.max(F.when(F.col("b.role") == r, 1).otherwise(0))
    seen = near.groupBy("a.doc_id", "a.h", "a.kind", "a.start", "a.end", "a.role").agg(flag("i").alias("i"), flag("s").alias("s"), flag("e").alias("e"))
    linked = ((F.col("role") == "s") & (F.col("i") + F.col("e") > 0)) | ((F.col("role") == "i") & (F.col("s") > 0)) | ((F.col("role") == "e") & (F.col("i") > 0) & (F.col("s") > 0))
    return seen.where(linked).select("doc_id", "h", "kind", "start", "end")


def _joined(spans: str, base_only: bool) -> Column:
    kept = F.filter(spans, lambda x: x["kind"] < len(BASE)) if base_only else F.col(spans)
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``."""
    parts = materialize(find_parts(docs), "secret-parts")
    reported = parts.where(F.col("kind") < len(BASE)).union(link_parts(parts, reach))
    per = reported.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("d")
    p = per.alias("p")
    out = rows.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.h") == F.col("p.h")), "left").select(
        "d.doc_id", F.coalesce("p.found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("found"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined("found", True), 256).alias("base_sha256"), _joined("found", False).alias("spans"))
