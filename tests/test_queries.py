from pathlib import Path

import pytest
from oracle import compare

from ledgerspark.plans import registry

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables aren't here")


@here
@pytest.mark.parametrize("name", registry.ORACLES)
def test_equals_its_oracle(spark, name):
    compare(spark, FOLDER, registry.QUERIES[name], registry.ORACLES[name])


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES) == set(registry.COVERS)


@here
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@here
def test_filters_reach_the_scan(spark):
    plan = registry.QUERIES["submission_search_by_participant"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" in plan.split("PushedFilters", 1)[1]


@here
@pytest.mark.parametrize("name", registry.QUERIES)
def test_no_plan_pairs_everything(spark, name):
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan
