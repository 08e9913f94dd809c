"""Answers that were wrong once, each on inputs that show it."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import rollups, security
from fleetlens.plans import change, config
from fleetlens.sources import read, write


def test_a_cluster_without_metadata_is_no_target(spark):
    wanted = spark.createDataFrame([(s, "max_connections", "10") for s in (1, 2, 3)], "server_id int, name string, value string")
    known = spark.createDataFrame([(s, "max_connections", "cluster", "dynamic", True, ["provisioned"], "5") for s in (1, 2, 3)],
                                  "server_id int, name string, scope string, apply_type string, is_modifiable boolean, engine_modes array<string>, value string")
    live = spark.createDataFrame([], "server_id int, name string, value string")
    servers = spark.createDataFrame([(2, "aurora-mysql", "provisioned", None), (3, "aurora-mysql", "provisioned", True)],
                                    "server_id int, engine string, engine_mode string, is_cluster_writer boolean")
    got = {r.server_id: (r.reason, r.method) for r in config.apply_plan_rds(wanted, known, live, servers).collect()}
    assert got == {1: ("cluster-not-supported", None), 2: ("not-cluster-writer", None), 3: (None, "immediate")}


def test_every_cloud_device_counts_and_a_local_one_once(spark):
    rows = [(1, "aws/rds", "d", "/a", 10, 1), (1, "aws/rds", "d", "/a", 20, 2), (1, "local", "d", "/a", 5, 7), (1, "local", "d", "/b", 5, 7), (1, "local", "e", "/c", 1, 1),
            (1, None, "d", "/a", 3, 4)]
    df = spark.createDataFrame(rows, "server_id int, provider string, device string, mount string, reads bigint, writes bigint")
    assert [tuple(r) for r in rollups.iops_total(df, ["server_id"]).collect()] == [(1, 39, 15)]


@pytest.mark.parametrize("version,privileges,plugin,secret,locked,expired,blank", [
    (50500, False, "auth_socket", "", None, None, 1), (50600, False, "auth_socket", "", None, None, 0), (50600, False, None, "", None, None, 0),
    (50700, False, "p", None, True, True, 1), (80000, False, "p", "", True, False, 0), (80000, False, "p", "", False, True, 0), (80000, False, "p", "", False, False, 1),
    (100400, True, "mysql_native_password", "", False, True, 1), (100400, True, "mysql_native_password", None, False, False, 0),
    (100400, True, "ed25519", "", False, False, 0), (100400, True, "mysql_native_password", "", True, False, 0)])
def test_blank_passwords_by_version(spark, version, privileges, plugin, secret, locked, expired, blank):
    df = spark.createDataFrame([(1, "ann", "%", plugin, secret, "local", privileges, version, locked, expired)],
                               "server_id int, user string, host string, plugin string, secret string, instance_type string, has_global_priv boolean, "
                               "version_number int, account_locked boolean, password_expired boolean")
    assert security.mysql_user_findings(df).first().blank_password == blank


def test_a_table_without_size_is_refused(spark):
    targets = spark.createDataFrame([(1, "s", "a"), (1, "s", "b")], "server_id int, table_schema string, table_name string")
    sizes = spark.createDataFrame([(1, "s", "a", 10, None)], "server_id int, table_schema string, table_name string, data_length bigint, index_length bigint")
    disks = spark.createDataFrame([(1, 1000, 500)], "server_id int, total_bytes bigint, free_bytes bigint")
    got = {r.table_name: r.reason for r in change.datadir_headroom(targets, sizes, disks).collect()}
    assert got == {"a": None, "b": "unknown-table"}


def test_of_two_names_the_smaller_is_taken(spark):
    stats = spark.createDataFrame([(1, 7)], "server_id int, dbid int")
    names = spark.createDataFrame([(1, 7, "z"), (1, 7, "b")], "server_id int, oid int, datname string")
    assert rollups.database_names(stats, names).first().datname == "b"


def test_numbers_inside_of_values_stay_numbers(spark):
    df = spark.createDataFrame([('{"a":{"b":1.5},"c":2.50,"d":[1,2],"e":"{x}"}',)], "document string")
    assert {r.name: r.value for r in read.parse_recommendations(df).collect()} == {"a": '{"b":1.5}', "c": "2.50", "d": "[1,2]", "e": "{x}"}


def test_names_with_spaces_in_the_stage_log(spark):
    line = "x Schema change check: task_id=1 statement_index=2 stage=copy status=failed table=my db.a table duration_ms=5 reason=\"no room\""
    df = spark.createDataFrame([(line,), (line.split(" duration")[0],)], "value string").filter(F.lit(True))
    assert [r.table for r in read.parse_stage_log(df).collect()] == ["my db.a table"] * 2


def test_snapshots_do_not_add_up(spark):
    rows = [(1, day, "innodb", "s", "t", "BASE TABLE", 10, 5) for day in (1, 2)]
    df = spark.createDataFrame(rows, "server_id int, collected_at int, engine string, table_schema string, table_name string, table_type string, data_length bigint, index_length bigint")
    assert [(r.collected_at, r.tables, int(r.total_size)) for r in rollups.engine_sizes(df).orderBy("collected_at").collect()] == [(1, 1, 15), (2, 1, 15)]
    sizes = rollups.table_type_sizes(df, F.col("data_length"))
    assert [(r.tables, int(r.total_size)) for r in rollups.size_totals(sizes).collect()] == [(1, 10), (1, 10)]
    assert [r.tables for r in rollups.row_count(df, "tables").collect()] == [1, 1]
    assert rollups.schema_list(df).count() == 2 and rollups.bytes_required(df).count() == 2
    assert [r.tables for r in rollups.engine_sizes(df, ["server_id"]).collect()] == [2]
    stats = spark.createDataFrame([(1, day, 7, 3, True, 2, 4.0) for day in (1, 2)],
                                  "server_id int, collected_at int, dbid int, queryid bigint, toplevel boolean, calls bigint, total_exec_time double")
    names = spark.createDataFrame([(1, day, 7, f"d{day}") for day in (1, 2)], "server_id int, collected_at int, oid int, datname string")
    assert sorted((r.collected_at, r.datname, r.calls) for r in rollups.statement_rollup(stats, names).collect()) == [(1, "d1", 2), (2, "d2", 2)]


def test_the_apply_result_names_group_and_error(spark):
    import json

    rows = [(1, "instance", "a", "applied", None, None, "g1"), (1, "instance", "b", "failed", None, "aws-api:Throttling", "g1"), (1, "cluster", "c", "skipped", "absent", None, None)]
    df = spark.createDataFrame(rows, "server_id int, scope string, name string, outcome string, reason string, error string, group_name string")
    got = json.loads(write.write_apply_result(df).first().result)
    assert got == {"instance": {"group": "g1", "applied": ["a"], "skipped": [], "failed": [{"parameters": ["b"], "error": "aws-api:Throttling"}]},
                   "cluster": {"applied": [], "skipped": [{"name": "c", "reason": "absent"}], "failed": []}}
