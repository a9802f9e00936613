import math

import pytest
from pyspark.sql import functions as F

from feedlake.functions.vectors import cosine, dot

ROWS = [
    ("same", [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]),
    ("opposite", [1.0, 2.0], [-1.0, -2.0]),
    ("orthogonal", [1.0, 0.0], [0.0, 1.0]),
    ("null_a", None, [1.0]),
    ("unequal", [1.0, 2.0], [1.0]),
    ("empty", [], []),
    ("zero", [0.0, 0.0], [1.0, 2.0]),
]


def _frame(spark):
    return spark.createDataFrame(ROWS, "name string, a array<float>, b array<float>")


def _eval(spark, **kw):
    df = _frame(spark).select("name", cosine("a", "b", **kw).alias("c"))
    return {r["name"]: r["c"] for r in df.collect()}


def test_cosine_v1(spark):
    got = _eval(spark)
    assert math.isclose(got["same"], 1.0, abs_tol=1e-9)
    assert math.isclose(got["opposite"], -1.0, abs_tol=1e-9)
    assert math.isclose(got["orthogonal"], 0.0, abs_tol=1e-9)
    assert got["null_a"] is None and got["unequal"] is None
    assert got["empty"] == 0.0 and got["zero"] == 0.0


def test_cosine_v2_empty_is_null(spark):
    got = _eval(spark, empty="null")
    assert got["empty"] is None and got["zero"] == 0.0
    assert math.isclose(got["same"], 1.0, abs_tol=1e-9)


def test_cosine_v3_zero_norm_raises(spark):
    df = _frame(spark).where(F.col("name") == "zero").select(cosine("a", "b", empty="null", zero="error"))
    with pytest.raises(Exception):
        df.collect()
    ok = _frame(spark).where(F.col("name") == "same").select(cosine("a", "b", empty="null", zero="error"))
    assert math.isclose(ok.collect()[0][0], 1.0, abs_tol=1e-9)


def test_dot_and_literal_query(spark):
    df = _frame(spark).where(F.col("name") == "same")
    r = df.select(dot("a", [1.0, 1.0, 1.0]).alias("d"), cosine("a", [2.0, 4.0, 6.0]).alias("c")).collect()[0]
    assert r["d"] == 6.0 and math.isclose(r["c"], 1.0, abs_tol=1e-9)


def test_cosine_stays_in_jvm(spark):
    plan = _frame(spark).select(cosine("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
