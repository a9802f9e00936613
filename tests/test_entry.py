"""The driver contract, and every registered query against its DuckDB oracle at sf0.001."""

import datetime as dt
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from feedlake.plans import registry

registry.load_all()

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["id", "title", "summary", "url", "published_at", "tags",
                                            "similarity_score"]


def test_registry_shapes():
    qs, sql = registry.QUERIES, registry.ORACLE
    assert len(qs) >= 89
    assert set(qs) <= set(E.queries()) and set(sql) <= set(E.oracle_sql())
    assert set(sql) <= set(qs)
    rows_only = set(qs) - set(sql)
    assert rows_only <= {"sample", "stream_idle"}


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ")
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_cell(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.sql(E.oracle_sql()[key])
    assert sorted(sdf.columns) == sorted(res.columns)
    drows = res.fetchall()
    assert len(srows) == len(drows)
    assert _digest(sdf.columns, srows) == _digest(res.columns, drows)
