"""Every box with its candidates, made where they are ranked."""

from veilmetrics.plans import registry


def test_boxes_and_candidates_are_not_joined(spark):
    p = registry.queries()["m12_fitted_boxes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in p and p.count("Exchange") == 1
