"""Vector expressions over ``array<float>`` columns.

All of them are Spark higher-order functions, so they run inside the JVM
without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(v: Column | str | list[float]) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.array(*[F.lit(float(x)) for x in v])


def _d(x: Column) -> Column:
    # a NULL element counts as 0, as it does in JavaScript arithmetic
    return F.coalesce(x.cast("double"), F.lit(0.0))


def dot(a: Column | str | list[float], b: Column | str | list[float]) -> Column:
    """Sum of element products (G14); NULL when the lengths differ."""
    a, b = _as_col(a), _as_col(b)
    prods = F.zip_with(a, b, lambda x, y: _d(x) * _d(y))
    return F.when(F.size(a) == F.size(b), F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x))


def sq_norm(a: Column | str | list[float]) -> Column:
    a = _as_col(a)
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + _d(x) * _d(x))


def cosine(a: Column | str | list[float], b: Column | str | list[float],
           empty: str = "zero", zero: str = "zero") -> Column:
    """Cosine similarity with the reference's three NULL/zero rules.

    * V1 ``empty="zero", zero="zero"``: NULL input or unequal length gives
      NULL, a zero norm (an empty array too) gives 0.
    * V2 ``empty="null", zero="zero"``: as V1 but an empty array gives NULL.
    * V3 ``empty="null", zero="error"``: a zero norm divides by zero, which
      raises under ANSI mode.
    """
    a, b = _as_col(a), _as_col(b)
    na, nb = F.sqrt(sq_norm(a)), F.sqrt(sq_norm(b))
    body = dot(a, b) / (na * nb)
    if zero == "zero":
        body = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(body)
    out = F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(None).cast("double"))
    if empty == "null":
        out = out.when(F.size(a) == 0, F.lit(None).cast("double"))
    return out.otherwise(body)
