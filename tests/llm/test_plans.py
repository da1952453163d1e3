"""One narrow pass where nothing needs to meet."""

from marketloom.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


def test_no_shuffle(spark):
    for name in ("p1_found", "p6_found", "p8_found", "p8_passages"):
        p = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in p, name


def test_no_cartesian_product(spark):
    for name in ("p2_found", "p5_found", "p9_found"):
        p = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
