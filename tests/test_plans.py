"""Plan-shape guards over every registered query."""

import pytest

from conftest import SF_SMALL
from feedlake.plans import registry

registry.load_all()

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_no_cross_join_and_no_row_python(spark, key):
    df = registry.QUERIES[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in FORBIDDEN if f in plan]
