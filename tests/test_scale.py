"""What grows with a table: rows of one file reach all tasks, derived columns are evaluated once, and rows made of a process stay with it."""

import re

import pytest

from tallyspark.plans.queries import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["extract_contract", "extract_composition", "extract_reservation", "extract_declaration", "deed_units", "norm_every_type", "layered_fields"])
def test_rows_of_one_file_reach_every_task(name, spark, sf):
    assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["extract_contract", "extract_composition", "extract_reservation", "extract_declaration", "deed_units", "layered_fields", "result_missing", "result_filter", "report_filter", "consolidated_values", "consolidated_conflicts"])
def test_filters_take_no_copy_of_what_they_follow(name, spark, sf):
    limit = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000000")
    try:
        plan = _plan(QUERIES[name](spark, sf))
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", limit)
    steps = re.split(r"(?m)^[ :+\-]*(?:\*\(\d+\) )?(?=[A-Z][A-Za-z]+ )", plan)
    assert max(len(s) for s in steps if s.startswith("Filter ")) < 5_000


@pytest.mark.parametrize("name", ["norm_every_type", "reconcile_every_source", "participant_summary", "consolidated_values", "missing_critical", "legacy_observations"])
def test_rows_of_a_process_are_made_where_they_are_grouped(name, spark, sf):
    """No evidence is shuffled, only what it is made of: customers or orders, and what is known of a run."""
    moved = re.findall(r"Exchange hashpartitioning\(([a-z_]+)#\d+L?(?:, ([a-z_]+)#)?", _plan(QUERIES[name](spark, sf)))
    assert moved and {m for m in moved if m[0] not in ("c_custkey", "o_orderkey", "o_custkey")} <= ({("process_id", "participant_id")} if name == "participant_summary" else set())
