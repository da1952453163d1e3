"""Plans that must not lose their shape."""

import re

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def count(text, word):
    return len(re.findall(rf"\b{word}\b", text))


def test_two_stages_and_a_bounded_broadcast(spark):
    p = plan(spark, "p3_price_stats")
    assert count(p, "Window") == 0 and "BroadcastHashJoin" in p and "CartesianProduct" not in p
    assert "ReadSchema: struct<record_id:bigint,source_id:int,price:double>" in p


def test_latest_per_key_is_pruned_before_the_shuffle(spark):
    p = plan(spark, "dedup_last_wins")
    assert count(p, "WindowGroupLimit") == 2


def test_groups_are_aggregates(spark):
    p = plan(spark, "price_compare_groups")
    assert "collect_list" not in p and count(p, "Exchange") == 1


def test_no_query_has_a_cartesian_product(spark):
    for name in ("bm25_multi_query", "vector_topk", "hybrid_topk", "upsert_last_wins", "platform_share", "quality_by_source", "second_choice_enrichment"):
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
