"""Text predicates and string helpers, all JVM-side column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(q: Column | str) -> Column:
    return q if isinstance(q, Column) else F.lit(q)


def contains_ci(c: Column | str, query: Column | str, wildcards: bool = True) -> Column:
    """``LOWER(c) LIKE LOWER('%q%')``.

    With ``wildcards=True`` the query keeps LIKE meaning for ``%`` and ``_``
    as in the reference, which splices the text into the pattern; the query is
    still passed as a value, never spliced into SQL. ``wildcards=False`` is a
    literal substring test.
    """
    c, q = _col(c), _lit(query)
    literal = F.contains(F.lower(c), F.lower(q))
    if not wildcards:
        return literal
    # a backslash is an ordinary character, not LIKE's escape
    escaped = F.replace(q, F.lit("\\"), F.lit("\\\\"))
    pattern = F.like(F.lower(c), F.lower(F.concat(F.lit("%"), escaped, F.lit("%"))))
    if isinstance(query, str):
        return pattern if any(ch in query for ch in "%_\\") else literal
    # a query without wildcard or escape characters means the same as a substring test,
    # which avoids compiling a pattern per row
    return F.when(q.rlike(r"[%_\\\\]"), pattern).otherwise(literal)


def like_any(c: Column | str, keywords: list[str], case_insensitive: bool = False) -> Column:
    """``c LIKE '%k1%' OR c LIKE '%k2%' ...``."""
    c = _col(c)
    if case_insensitive:
        return reduce(or_, [contains_ci(c, k) for k in keywords])
    return reduce(or_, [c.like(f"%{k}%") for k in keywords])


def preview(c: Column | str, n: int) -> Column:
    """First ``n`` characters (P18), 1-based like SUBSTRING."""
    return F.substring(_col(c), 1, n)


def char_length(c: Column | str) -> Column:
    """LENGTH in characters, as a 64-bit count."""
    return F.length(_col(c)).cast("long")


def md5_key(*parts: Column) -> Column:
    """Deterministic key in place of UUID_STRING: md5 of the parts joined by ``#``."""
    return F.md5(F.concat_ws("#", *[p.cast("string") for p in parts]))
