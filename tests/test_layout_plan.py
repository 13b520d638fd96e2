"""What the plan of layout lines shuffles."""

from lodestone.queries.chunking import layout_lines


def test_spans_are_not_shuffled(spark):
    plan = layout_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_COL" in plan
