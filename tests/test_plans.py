"""Configuration plans, readiness and quotas by hand."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import ranking, security
from fleetlens.plans import change, config

PARAMETERS = "server_id int, scope string, name string, apply_type string, is_modifiable boolean, engine_modes array<string>, value string"


def plan(spark, parameters, recommendations, current=(), engine="aurora-postgresql", mode="provisioned", writer=True, **options):
    result = config.apply_plan_rds(
        spark.createDataFrame([(1, n, v) for n, v in recommendations], "server_id int, name string, value string"),
        spark.createDataFrame([(1, *p) for p in parameters], PARAMETERS),
        spark.createDataFrame([(1, n, v) for n, v in current], "server_id int, name string, value string"),
        spark.createDataFrame([(1, engine, mode, writer)], "server_id int, engine string, engine_mode string, is_cluster_writer boolean"), **options)
    return {r["name"]: (r["scope"], r["reason"], r["method"], r["planned"]) for r in result.collect()}


def test_order_of_rules(spark):
    parameters = [
        ("instance", "both", "dynamic", True, None, None), ("cluster", "both", "dynamic", False, None, None), ("instance", "fixed", "dynamic", False, None, None),
        ("instance", "modes", "dynamic", True, ["Serverless"], None), ("instance", "anymode", "Dynamic", True, ["PROVISIONED"], None), ("instance", "work_mem", "dynamic", True, None, None),
        ("instance", "shared_buffers", "static", True, None, "16384"), ("instance", "static", "static", True, None, None), ("instance", "odd", "never", True, None, None),
        ("cluster", "clustered", "dynamic", True, None, None), ("instance", "live", "dynamic", True, None, None)]
    wanted = [("both", "1"), ("fixed", "1"), ("modes", "1"), ("anymode", "1"), ("work_mem", "1025"), ("shared_buffers", "134217728"), ("static", "1"), ("odd", "1"), ("clustered", "1"),
              ("live", "7"), ("nowhere", "1")]
    got = plan(spark, parameters, wanted, [("live", "7"), ("both", "0")])
    assert got == {
        "both": ("instance", None, "immediate", "1"), "fixed": ("instance", "unmodifiable", None, None), "modes": ("instance", "unsupported-engine-mode", None, None),
        "anymode": ("instance", None, "immediate", "1"), "work_mem": ("instance", "invalid-value", None, None), "shared_buffers": ("instance", "unchanged", None, None),
        "static": ("instance", None, "pending-reboot", "1"), "odd": ("instance", "unsupported-apply-type", None, None), "clustered": ("cluster", None, "immediate", "1"),
        "live": ("instance", "unchanged", None, None), "nowhere": ("instance", "absent", None, None)}
    assert plan(spark, parameters, [("static", "1")], dynamic_only=True)["static"][1] == "not-dynamic"
    assert plan(spark, parameters, [("both", "1")], pending_reboot_only=True)["both"][2] == "pending-reboot"
    assert plan(spark, parameters, [("clustered", "1")], writer=False)["clustered"][1] == "not-cluster-writer"
    assert plan(spark, parameters, [("clustered", "1")], engine="postgres")["clustered"][1] == "cluster-not-supported"


@pytest.mark.parametrize("configured,attached,want", [("", "x", True), ("default.pg15", "default.pg15", True), ("Default.X", "Default.X", True), ("a", "b", True), ("a", "a", False), (None, None, True)])
def test_group_mismatch(spark, configured, attached, want):
    assert spark.range(1).select(config.group_mismatch(F.lit(configured).cast("string"), F.lit(attached).cast("string")).alias("x")).first()["x"] is want


def test_quota_counts_successes_only(spark):
    """210 statements: the five largest fail, five more have no plan; the quota passes take 100 and 100 more."""
    data = [(1, f"{i:03d}", 210 - i, i, i >= 10) for i in range(210)]
    statements = spark.createDataFrame(data, "server_id int, queryid string, total int, mean int, good boolean")
    first = ranking.plan_quota(statements, "total", F.col("good"))
    assert (first.count(), first.filter("good").count()) == (110, 100)
    both = ranking.two_rankings(statements, "total", "mean", F.col("queryid") >= "010")
    assert both.groupBy("ranking").count().orderBy("ranking").collect()[1]["count"] == 110
    assert both.select("queryid").distinct().count() == both.count() == 210
    assert both.filter("queryid >= '010'").count() == 200


def test_access_rules(spark):
    roles = spark.createDataFrame([(s, "Agent_Live", True, True) for s in range(6)] + [(2, "weak", False, True), (2, "locked", True, False)],
                                  "server_id int, rolname string, rolsuper boolean, rolcanlogin boolean")
    rules = spark.createDataFrame([
        (1, "host", "all", "127.0.0.1/32"), (2, "host", "all", "0.0.0.0/0"), (3, " HostSSL ", "agent_live, app", "10.0.0.0/8"), (4, "hostssl", "other", "10.0.0.0/8"), (5, "local", "all", "")],
        "server_id int, type string, user_name string, address string")
    got = sorted((r["server_id"], r["remote_conn_superuser"]) for r in security.pg_user_findings(roles, rules).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (2, 0), (2, 1), (3, 1), (4, 0), (5, 0)]


def test_batches_stop_their_scope(spark):
    planned = spark.createDataFrame([(s, scope, f"p{i:02d}") for s in (1, 2) for scope in ("instance", "cluster") for i in range(45)], "server_id int, scope string, name string")
    batched = ranking.batches(planned)
    failed = ((F.col("server_id") == 1) & (F.col("scope") == "instance") & (F.col("batch") == 2)) | ((F.col("server_id") == 2) & (F.col("scope") == "cluster") & (F.col("batch") == 1))
    got = {(r["server_id"], r["scope"], r["batch"], r["outcome"]): r["count"] for r in ranking.batch_outcomes(batched, failed).groupBy("server_id", "scope", "batch", "outcome").count().collect()}
    assert got == {
        (1, "instance", 1, "applied"): 20, (1, "instance", 2, "failed"): 20, (1, "instance", 3, "not-run"): 5, (1, "cluster", 1, "not-run"): 20, (1, "cluster", 2, "not-run"): 20,
        (1, "cluster", 3, "not-run"): 5, (2, "instance", 1, "applied"): 20, (2, "instance", 2, "applied"): 20, (2, "instance", 3, "applied"): 5, (2, "cluster", 1, "failed"): 20,
        (2, "cluster", 2, "not-run"): 20, (2, "cluster", 3, "not-run"): 5}


def test_change_gate(spark):
    schema = ("task_id int, statement_index int, schema_name string, ddl_statement string, syntax_valid boolean, target_schema string, target_table string, engine string, "
              "ok_online boolean, ok_copy_tool boolean, backup_wanted boolean, ok_recovery boolean, ok_physical boolean")
    fine = ("app", "ALTER TABLE t ADD a INT", True, "app", "t", "InnoDB", True, False, False, False, False)
    data = [
        (1, 0, *fine), (1, 1, "app", "x", False, "", "", "", False, False, False, False, False), (1, 2, *fine),
        (2, 0, *fine), (2, 1, " ", "x", True, "app", "t", "InnoDB", True, True, False, False, False),
        (3, 0, "app", "x", True, "app", "t", " ", True, True, False, False, False), (4, 0, "app", "x", True, "app", "t", "InnoDB", False, False, False, False, False),
        (5, 0, "app", "x", True, "app", "t", "InnoDB", True, True, True, False, True), (6, 0, "app", "x", True, "app", "t", "InnoDB", True, True, True, True, False), (7, 0, *fine)]
    statements = spark.createDataFrame(data, schema)
    tasks = spark.createDataFrame([(i, i != 7) for i in range(1, 9)], "task_id int, enabled boolean")
    gated = change.change_gate(statements, tasks)
    assert {(r["task_id"], r["statement_index"]): (r["exit_code"], r["backup"], r["run"]) for r in gated.collect()} == {
        (1, 0): (0, "none", True), (1, 1): (4, None, True), (1, 2): (0, "none", False), (2, 0): (2, None, True), (2, 1): (2, None, False), (3, 0): (5, None, True),
        (4, 0): (5, None, True), (5, 0): (6, None, True), (6, 0): (0, "logical", True), (7, 0): (10, None, True)}
    codes = {r["task_id"]: r["exit_code"] for r in change.task_gate(statements, gated, tasks).collect()}
    assert codes == {1: 4, 2: 2, 3: 5, 4: 5, 5: 6, 6: 0, 7: 10, 8: 3}
