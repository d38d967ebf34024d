"""Physical plan checks over every registered query.

No Python UDF in any plan, no cartesian product or nested-loop join, and no
window that gathers the whole input into a single partition.
"""

import pytest

from batchtrail.plans.registry import all_queries
from tests.conftest import SMALL

QUERIES = all_queries()
FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_shape(spark, key):
    plan = _plan(QUERIES[key](spark, SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{key}: {bad}"
    assert "Exchange SinglePartition" not in plan or key in _SINGLE_ROW_OK, f"{key}: single partition exchange"


# Global aggregates and top-k reports end in one partition by nature (one row /
# k rows); contiguous id assignment runs its offsets window over per-day bucket
# totals (one row per day).  Everything else must stay distributed.
_SINGLE_ROW_OK = {
    "run_stats", "search_total", "performance_point_count", "performance_point_count_filtration",
    "performance_point_count_clarifier", "media_counts",
    "correction_counts", "latest_drafts", "fold_drafts_global", "derived_runs", "create_or_reuse_runs",
    "recent_runs", "recent_open_runs", "runs_page", "recent_blend_labels", "recent_split_labels", "activity_feed",
    "in_use_items", "extraction_listing", "filtration_listing", "clarifier_listing", "change_history",
    "change_history_run", "open_draft_sheets", "derived_sheet_copies", "derived_sheet_cells", "derived_extraction_copies",
    "derived_filtration_rows", "created_runs", "audit_all", "export_audits",
}


def test_flagship_pushes_filters_and_prunes(spark):
    df = QUERIES["machine_performance"](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text or "DataFilters" in text


def test_null_run_keys_are_spread_in_sort_merge_joins(spark):
    """Without broadcast, the NULL-key salt must be a partitioning key of the run join."""
    from pyspark.sql import functions as F
    from batchtrail.operators.joins import join_runs
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("run_id"))
        runs = spark.range(50).select("id", F.col("id").cast("string").alias("run_number"))
        j = join_runs(left, runs, ["run_number"])
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [run_id" in plan and "__salt_l" in plan.split("SortMergeJoin", 1)[1].splitlines()[0]
        # the NULL-key third of the rows lands in many partitions, not one
        sizes = j.filter(F.col("run_id").isNull()).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) > 1
        assert j.count() == 3000
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("key, parses", [("media_counts", 2), ("populated_rows", 1), ("cells_long", 1), ("packet_cells", 1)])
def test_a_payload_is_parsed_once(spark, key, parses):
    """Filtration and sheet payloads of the media feed are two columns; all filters and columns share their parse."""
    plan = QUERIES[key](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == parses


@pytest.mark.parametrize("key, most", [("fold_drafts", 3), ("fold_sheet_content", 3), ("finalize_runs", 8), ("derived_runs", 12), ("audit_all", 20),
                                       ("unique_name", 8), ("create_or_reuse_runs", 10)])
def test_shuffles_with_broadcast_off(spark, key, most):
    """Running values are written scans and checked requests a written table: what is left are joins and one aggregation."""
    import re
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plan = _plan(QUERIES[key](spark, SMALL))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan)) <= most
