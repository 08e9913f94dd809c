"""Hand-written cases of the normalisers."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import maps
from fleetlens.functions import normalize as n
from fleetlens.operators import hosts, rollups
from fleetlens.plans import config
from fleetlens.sources import read


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    (" 12 ", 12), ("13.75", 13), ("+Inf", 2**64 - 1), ("18446744073709551615", 2**64 - 1), ("-1", 0), ("NaN", 0), ("-Inf", 0), ("twelve", 0),
    (None, 0), ("18446744073709551616", 2**64 - 1), ("9007199254740993", 9007199254740993), ("1e3", 1000), ("12d", 0), ("", 0), ("0", 0), (".5", 0)])
def test_to_size(spark, text, want):
    assert int(one(spark, n.to_size(F.lit(text).cast("string")))) == want


@pytest.mark.parametrize("value,want", [(11.75, 11), (-1.0, 0), (float("nan"), 0), (float("inf"), 2**64 - 1), (1e19, 10**19), (9.5e15, 9500000000000000)])
def test_to_size_double(spark, value, want):
    assert int(one(spark, n.to_size_double(F.lit(value)))) == want


def test_effective_ram(spark):
    total = F.lit("33554432").cast("decimal(20,0)")
    assert int(one(spark, n.effective_ram(F.lit("aws/rds"), total))) == 33554432 * 1024
    assert int(one(spark, n.effective_ram(F.lit("local"), total))) == 33554432
    assert int(one(spark, n.effective_ram(F.lit("aws/rds"), F.lit("18446744073709551615").cast("decimal(20,0)")))) == 2**64 - 1


@pytest.mark.parametrize("text,want", [
    ("-3947659967107627740", "14499084106601923876"), ("14499084106601923876", "14499084106601923876"), ("7", "7"), (" 7 ", "7"), ("+7", "7"),
    ("", ""), ("abc", "abc"), ("99999999999999999999", "99999999999999999999"), ("-1", "18446744073709551615"), ("-9223372036854775808", "9223372036854775808")])
def test_normalize_query_id(spark, text, want):
    assert one(spark, n.normalize_query_id(F.lit(text))) == want


def test_statement_identity(spark):
    def identity(db, query, level):
        return one(spark, n.statement_identity(F.lit(db), F.lit(query), F.lit(level).cast("boolean")))
    golden = identity("16384", "-3947659967107627740", True)
    assert golden == "9435790011664841955"
    assert identity("16384", "14499084106601923876", True) == golden
    assert len({golden, identity("16385", "-3947659967107627740", True), identity("16384", "-3947659967107627740", False),
                identity("16384", "-3947659967107627740", None)}) == 4


@pytest.mark.parametrize("name,value,want", [
    ("shared_buffers", "134217728", "16384"), ("work_mem", "4194304", "4096"), ("maintenance_work_mem", "67108864", "65536"),
    ("effective_cache_size", "1073741824", "131072"), ("wal_buffers", "16777216", "2048"), ("work_mem", "1025", None), ("work_mem", "4MB", None), ("max_connections", "7", "7")])
def test_native_units(spark, name, value, want):
    assert one(spark, n.native_units(F.lit("postgresql"), F.lit(name), F.lit(value))) == want
    assert one(spark, n.native_units(F.lit("mysql"), F.lit(name), F.lit(value))) == value


@pytest.mark.parametrize("value,want", [("75.9", "75"), ("-0.5", "0"), ("x", None), ("90", "90")])
def test_truncated_percent(spark, value, want):
    assert one(spark, n.parameter_value(F.lit("innodb_max_dirty_pages_pct"), F.lit(value))) == want
    assert one(spark, n.parameter_value(F.lit("other"), F.lit(value))) == value


@pytest.mark.parametrize("value,want", [(1e20, "100000000000000000000"), (0.5, "0.5"), (100.0, "100"), (float("nan"), None), (float("inf"), None)])
def test_plain_number(spark, value, want):
    assert one(spark, n.plain_number(F.lit(value))) == want


@pytest.mark.parametrize("left,right,want", [
    (" ON", "on", True), ("100", "100.0", True), ("1e2", "100", True), ("100", "100.1", False), ("a", "b", False), (None, "", True), ("0.1", "0.10000000001", True)])
def test_values_equal(spark, left, right, want):
    assert one(spark, n.values_equal(F.lit(left).cast("string"), F.lit(right))) is want


@pytest.mark.parametrize("left,right,key,want", [
    ('{"a":1,"b":2}', '{"b":3,"c":[1]}', None, '{"a":1,"b":3,"c":[1]}'), ('{"b":1}', '{"a":2}', "k", '{"b":1,"k":{"a":2}}'), ("[1]", '["x"]', None, '[1,"x"]'),
    ('[{"a":1},5]', '{"b":2}', None, '[{"a":1,"b":2},5]'), ('[{"a":1}]', '{"b":2}', "k", '[{"a":1,"k":{"b":2}}]'), ('{"a":1}', "[2]", None, '[{"a":1},[2]]'), ("1", '"x"', None, '[1,"x"]'),
    ("", '{"a":1}', None, '{"a":1}'), ('{"a":1}', "", None, '{"a":1}'), ("{", "{}", None, None)])
def test_merge_json(spark, left, right, key, want):
    assert one(spark, maps.merge_json(F.lit(left), F.lit(right), key)) == want


@pytest.mark.parametrize("tables,size,ram,large", [
    (1000, 5 * 2**30, 2**30, False), (1001, 4 * 2**30, 2**30, False), (1001, 4 * 2**30 + 1, 2**30, True), (1001, 5, 0, False), (1001, 2**64 - 1, 2**63, False)])
def test_size_class(spark, tables, size, ram, large):
    def number(x):
        return F.lit(str(x)).cast("decimal(20,0)")
    got = one(spark, hosts.size_class(number(ram), F.lit(tables), number(size), threshold=1000, factor=4, ttl=604800))
    assert (got["large"], got["ttl_seconds"]) == (large, 604800 if large else 42900)


def test_versions(spark):
    assert one(spark, n.mysql_version(F.lit("10.6.12-MariaDB-log"))) == "10.6.12"
    assert one(spark, n.mysql_version(F.lit("8.0.35"))) == "8.0.35"
    assert one(spark, n.postgres_version(F.lit("PostgreSQL 14.5 (Debian 14.5-1)"))) == "14.5"


def test_old_statement_layouts(spark):
    """A server without level and row counter, with the older name of the time column in doubles."""
    stats = spark.createDataFrame([("1", "7", "select 1", 2, 0.1), ("1", "7", "select 2", 3, 0.2), ("1", None, "x", 1, 9.0)],
                                  "dbid string, queryid string, query string, calls bigint, total_time double").withColumn("server_id", F.lit(1))
    databases = spark.createDataFrame([(1, "2", "app")], "server_id int, oid string, datname string")
    row = rollups.statement_rollup_full(stats, databases, "total_time", has_toplevel=False, has_rows=False).first()
    assert (row["datname"], row["calls"], row["rows"], row["query"], row["toplevel"]) == ("NULL", 5, 0, "select 1", None)
    assert row["total_exec_time_us"] == pytest.approx(300.0) and row["mean_exec_time_us"] == pytest.approx(60.0)


@pytest.mark.parametrize("text,want", [
    ("true", "ON"), ("false", "OFF"), ("null", ""), ('"  On "', "On"), ('"true"', "true"), ('""', ""), ("100.0", "100"), ("100", "100"), ("-0.50", "-0.5"),
    ("1e3", "1000"), ("2.5e-7", "0.00000025"), ("9223372036854775807", "9223372036854775807"), ("18446744073709551615", "18446744073709551615"),
    ("0.10", "0.1"), ("10", "10"), ("[1,2]", "[1,2]")])
def test_config_text(spark, text, want):
    assert one(spark, n.config_text(F.parse_json(F.lit(text)))) == want
    assert one(spark, n.config_text(F.try_parse_json(F.lit("no json")))) == ""


@pytest.mark.parametrize("text,want", [
    (r"plain", "plain"), (r'a\"b\\n', 'a"b\\n'), (r"\\\n", "\\\n"), (r"\a\b\f\r\t\v", "\a\b\f\r\t\v"), (r"\x00\x7f", "\x00\x7f"), (r"\xff", "�"),
    (r"\u200b\U000e0001é", "\u200b\U000e0001é"), ("", ""), (r"100\\x41", r"100\x41")])
def test_unquoted(spark, text, want):
    assert one(spark, read.unquoted(F.lit(text))) == want


def test_azure_plan_names_and_values(spark):
    wanted = spark.createDataFrame([(1, "a_b", " 5 "), (1, "c", "x"), (1, "d", "7"), (2, "e", "1")], "server_id int, name string, value string")
    live = spark.createDataFrame([(1, "a_b", "4"), (1, "d", "7.0")], "server_id int, name string, value string")
    known = spark.createDataFrame([(1, "A_B", "4", False, False, False), (2, "E", "0", True, True, False)],
                                  "server_id int, name string, value string, read_only boolean, dynamic boolean, pending_restart boolean")
    plan = config.apply_plan_azure(wanted, live, known)
    got = {(r.server_id, r.name): (r.action, r.restart, r.provider_name, r.stored, r.sent) for r in plan.collect()}
    assert got == {(1, "a_b"): ("update", True, "A_B", "4", "5"), (1, "c"): ("unknown", False, None, None, None),
                   (1, "d"): ("equal", False, None, None, None), (2, "e"): ("read-only", False, "E", "0", None)}
    ends = {r.server_id: (r.updates, r.unknown, r.read_only, r.exit_code, r.task_status) for r in config.azure_exit(plan, restarting=False).collect()}
    assert ends == {1: (1, 1, 0, 10, 4), 2: (0, 0, 1, 0, 1)}
    assert {r.task_status for r in config.azure_exit(plan, restarting=True).collect()} == {1}
