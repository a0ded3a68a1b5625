"""Plan checks: no Python UDF anywhere, no un-partitioned window, filters reach the scan."""

import re

from talentlake.functions import windows
from talentlake.plans.catalog import warehouse

STREAMING = {"stream_events_dedup", "stream_funnel", "stream_transitions"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(node):
    """All physical nodes, looking through adaptive wrappers."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(node.inputPlan())
        return
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def unpartitioned_windows(df):
    root = df._jdf.queryExecution().executedPlan()
    return [n for n in _nodes(root) if n.getClass().getSimpleName() == "WindowExec" and n.partitionSpec().isEmpty()]


def check_plan(name, df):
    """No Python UDF, no cross or nested-loop join and no un-partitioned window in a query's physical plan."""
    plan = _plan(df)
    for marker in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert marker not in plan, f"{name}: {marker}"
    assert not unpartitioned_windows(df), name
    for limit in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan):
        assert int(limit) <= windows.TOP_K, name  # its buffers are sized by the limit


def test_projection_is_pruned_at_the_scan(spark, sf_dir):
    plan = _plan(warehouse(spark, sf_dir).mart_funnel)
    # the funnel needs only user_id, ts and event_type from the events table
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "events" in line]
    assert scan and all("value" not in line.split("ReadSchema")[1] for line in scan)
