"""Plans: what reaches the scan, and that nothing multiplies tables."""

import os
import re

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def nodes(plan):
    """A physical plan and all below it, through stages that adaptive execution wraps."""
    yield plan
    below = [plan.executedPlan()] if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else []
    children = plan.children()
    for child in below + [children.apply(i) for i in range(children.size())]:
        yield from nodes(child)


def one_row(plan):
    """Whether a plan gives one row at most: an aggregate without keys below what keeps the number of rows, or a limit of 1."""
    for node in nodes(plan):
        name = node.getClass().getSimpleName()
        if name.endswith("AggregateExec"):
            return node.groupingExpressions().isEmpty()
        if name.endswith(("JoinExec", "ScanExec", "GenerateExec", "UnionExec")) and "Project" not in name:
            return False
    return False


# Built from stored steps by the time the plan is there, so a plan says the same for the others: one of each kind of plan is enough here.
SLOW = ("stream", "incremental", "p1_", "p2_", "p3_", "p5_", "p8_", "p9_", "p10_")


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(SLOW)])
def test_no_cartesian_product(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan()
    for node in nodes(plan):
        kind = node.getClass().getSimpleName()
        assert kind != "CartesianProductExec"
        if kind == "BroadcastNestedLoopJoinExec":
            assert one_row(node.left()) or one_row(node.right()), f"{name}: a nested loop without a side of one row"


@pytest.mark.parametrize(
    ("name", "columns"),
    [("difficulty_counts", {"text"}), ("symbol_occurrences", {"neuralese_chain"}), ("stratified_split", {"corpus_id", "difficulty"}), ("json_props", {"event_type", "props"}), ("type_path_counts", {"type_path"})],
)
def test_only_needed_columns_are_read(spark, name, columns):
    scans = [line for line in plan(spark, name).splitlines() if "FileScan" in line and os.path.basename(SF) in line]  # of the tables; steps that were written have columns of their own
    assert scans
    for line in scans:
        schema = re.search(r"ReadSchema: struct<(.*)>", line).group(1)
        assert {c.split(":")[0] for c in schema.split(",") if ":" in c} <= columns


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan(spark, "pricing_summary")
    assert "EqualTo(source,chain_notes)" in plan(spark, "source_filter_limit")
