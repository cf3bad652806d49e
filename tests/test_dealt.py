"""What is many times as much as its documents is not shuffled."""

import os

import pytest

from tallyspark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["src2_chars_to_words", "src5_recorded_layouts"])
def test_only_texts_are_shuffled(spark, name):
    df = registry.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0] and "hashpartitioning(doc" in exchanges[0]


def test_neither_side_of_an_overlap_is_broadcast(spark):
    df = registry.QUERIES["jn7_roles_by_overlap"](spark, SF)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
