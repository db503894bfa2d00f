"""Picks within scenes shuffle the samples once, and no task of a scan holds its rows."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import slices as Z
from fieldloom.plans.views import samples

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_are_dealt_before_their_grouping(spark):
    plan = plan_of(samples(spark, SF))
    assert plan.count("Exchange ") == 1 and "Aggregate" not in plan.split("Exchange ")[1] and "Sort " not in plan.split("Exchange ")[1]


@pytest.mark.parametrize("labelled", [False, True])
def test_all_turns_of_a_budget_share_one_shuffle(spark, labelled):
    rows = samples(spark, SF).select("scene_id", "point_id", "x", "y", *[F.abs(f"sdf_{s}").alias(f"dist_{s}") for s in ("epi", "lv", "rv")])
    picked = Z.budget_pick(rows, 60, [0.01, 0.04], ["x", "y"], 5, labelled=labelled)
    plan = plan_of(picked)
    assert plan.count("Exchange ") == 1 and "Scan ExistingRDD" not in plan
    assert picked.count() == picked.select("scene_id", "point_id").distinct().count()
