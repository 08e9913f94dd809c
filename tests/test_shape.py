"""Plans without the operators that do not scale, and results that do not depend on the order of the input."""

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.functions.normalize import null_marker
from fleetlens.operators import joins, ranking, rollups
from fleetlens.registry import bindings as b
from fleetlens.registry.base import Tables

QUERIES = entry.queries()
STREAMS = ("read_snapshots", "read_snapshot_stream", "late_reports", "sample_text_state", "sample_text_ttl_stream", "task_state_stream", "snapshot_state", "route_reports", "route_reports_stream", "topology_state_stream")


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(STREAMS)))
def test_plan_has_no_single_task_steps(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SinglePartition"):
        assert bad not in plan, f"{name} has {bad}"


def test_scan_reads_needed_columns_only(spark):
    frame = rollups.statement_rollup(b.statement_stats(Tables(spark, FOLDER)), b.databases(Tables(spark, FOLDER)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "l_suppkey" in line)
    assert "l_discount" not in scan and "l_shipdate" not in scan and "l_tax" not in scan


def test_filters_reach_the_scan(spark):
    """A filter on the server passes below the rollup, the join with the names and the top-k, down to the scan."""
    t = Tables(spark, FOLDER)
    rolled = rollups.statement_rollup(b.statement_stats(t), b.databases(t))
    for frame in (rolled, ranking.top_k_statements(rolled, "total_exec_time_us", 5)):
        lines = frame.filter("server_id = 3")._jdf.queryExecution().executedPlan().toString().splitlines()
        last = max(i for i, line in enumerate(lines) if "HashAggregate" in line)
        above = [line for line in lines[:next(i for i, line in enumerate(lines) if "HashAggregate" in line)] if "Filter" in line]
        assert any("Filter" in line and "l_suppkey" in line for line in lines[last:]) and not any("= 3" in line for line in above)


@pytest.mark.parametrize("count", [1, 7])
def test_order_and_partitions_do_not_matter(spark, count):
    t = Tables(spark, FOLDER)

    def mixed(df):
        return df.repartition(count, F.xxhash64(*df.columns)).sortWithinPartitions(F.md5(F.concat_ws("|", *[null_marker(F.col(c)) for c in df.columns])))

    def same(left, right):
        assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))
    stats, databases = b.statement_stats(t), b.databases(t)
    plain = rollups.statement_rollup_full(stats, databases)
    shuffled = rollups.statement_rollup_full(mixed(stats), mixed(databases))
    same(plain, shuffled)
    same(ranking.top_k_statements(plain, "mean_exec_time_us", 5), ranking.top_k_statements(shuffled, "mean_exec_time_us", 5))
    same(joins.latest_statement_text(b.statement_events(t)), joins.latest_statement_text(mixed(b.statement_events(t))))


def test_texts_stay_out_of_the_ranking(spark):
    """Texts are sorted nowhere: the statistics are ranked without them, and the winners' texts are read in the end."""
    t = Tables(spark, FOLDER)
    slim = rollups.statement_rollup_full(b.statement_stats(t), b.databases(t), with_text=False)
    assert "min(query" not in slim._jdf.queryExecution().executedPlan().toString() and "query" not in slim.columns
    found = QUERIES["top_k_statements"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "min(query" not in found and "ObjectHashAggregate" in found and "LeftSemi" in found
    want = ranking.top_k_statements(rollups.statement_rollup_full(b.statement_stats(t), b.databases(t)), "mean_exec_time_us", 7)
    got = ranking.top_k_with_texts(b.statement_stats(t), b.databases(t), "mean_exec_time_us", 7)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
