"""A task holds one row of an unfolded candidate set at a time, as each has the text of its set."""

import os

import pytest

from sharelens.jobs.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["a5_decision_counts", "a6_merge_decisions", "s3_parse_decision_log", "st4_decision_rounds"])
def test_rows_of_a_set_are_not_collected(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    unfolded = [line for line in plan.splitlines() if "Generate inline" in line and "ids#" in line]
    # Generated code (*) keeps what it unfolds from a row until all of it is there.
    assert unfolded and not [line for line in unfolded if "*(" in line.split("Generate")[0]]
