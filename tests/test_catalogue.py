import pytest

from tests.conftest import SF, same
from tidemark.plans import catalogue, evidence, studies  # noqa: F401 (the others register more queries)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df())


def test_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_markout_plan_prunes_columns_and_has_one_shuffle_by_key(spark):
    plan = catalogue.markout_forward(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ReadSchema: struct<event_id" in plan
