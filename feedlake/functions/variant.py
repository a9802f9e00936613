"""Typed access into semi-structured (variant) columns, with the warehouse's cast rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(path: str) -> str:
    """``a:b:c`` (warehouse path) -> ``$.a.b.c`` (variant path)."""
    return path if path.startswith("$") else "$." + path.replace(":", ".")


def as_str(v: Column, path: str) -> Column:
    """``v:path::VARCHAR``: NULL for a missing path or JSON null."""
    return F.try_variant_get(v, json_path(path), "string")


def as_int(v: Column, path: str) -> Column:
    """``v:path::INT``: a fractional number rounds (half away from zero), a non-number gives NULL.

    Spark's integer extraction would truncate 0.6 to 0, so the value is read
    as a double and rounded first.
    """
    return F.round(F.try_variant_get(v, json_path(path), "double")).cast("long")


def as_bool(v: Column, path: str) -> Column:
    """``v:path::BOOLEAN``."""
    return F.try_variant_get(v, json_path(path), "boolean")
