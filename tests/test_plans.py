"""What Spark makes of the queries: pruned scans, pushed filters, no product of two tables."""

import pytest

from strandwork.plans.catalogue import QUERIES


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_scans_read_only_what_is_used(spark, sf):
    text = plan(QUERIES["q_topk_group"](spark, sf))
    (schema,) = {line.strip() for line in text.splitlines() if "ReadSchema" in line}
    assert schema == "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>"


def test_filters_reach_the_scan(spark, sf):
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan(QUERIES["q_bfs_parts"](spark, sf))
    assert "EqualTo(quality,1)" in plan(QUERIES["q_publish_gate"](spark, sf))


@pytest.mark.parametrize("name", ["q_task_rank", "q_textscan_topn", "q_unique_owner", "q_overlap_smallest", "q_seed_expand", "q_snapshot_diff", "q_prefix_terms", "q_mentioned"])
def test_no_cartesian_product(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    spark.catalog.clearCache()


def test_definitions_of_spread_sources_are_not_broadcast(spark, sf):
    """An index was taken for as small as the suppliers' file, and its definitions sent whole to the driver for each join."""
    from pyspark.sql import functions as F

    from strandwork.functions import text
    from strandwork.plans import retrieval, source_queries

    index = retrieval.build_index(source_queries.sources(spark, sf))
    words = source_queries.tasks(spark, sf).select("task_id", F.explode(text.tokens(F.col("text"))).alias("key"))
    own = index.definitions.select("path", "text", F.explode(text.tokens(F.col("name"))).alias("key"))
    for met in (words.join(own, "key"), own.join(index.files, "path"), words.join(index.files.select("path", F.col("path").alias("key")), "key")):
        plan = met._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
