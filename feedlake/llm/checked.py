"""Joins whose broadcast is decided by a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Largest side, in bytes of its values, that is sent to every executor.
BROADCAST_BYTES = 32 << 20


def join_lists(rows: DataFrame, lists: DataFrame, key: str, values: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Left join ``rows`` with one array ``values`` per ``key``.

    ``lists`` should be a written table: its size is measured first. Up to ``limit`` bytes it
    is broadcast and the rows stay where they are; beyond, it is a shuffled join, whose hot
    keys adaptive execution splits."""
    n, size = lists.agg(F.count("*"), F.sum(F.size(values))).first()
    small = (size or 0) * 8 + n * 64 <= limit
    return rows.join(F.broadcast(lists) if small else lists, key, "left")
