"""Plans of joins between tables that grow with the fleet: the files' sizes do not decide to broadcast them."""

import json

from pyspark.sql import functions as F

from fleetlens.operators import catalog, ranking
from fleetlens.registry import landing, sections
from fleetlens.registry.base import Tables
from fleetlens.sources import read


def table(spark, columns, *rows):
    """Rows whose size Spark takes for small, as it does for a few files."""
    names = [c.split()[0] for c in columns.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{columns}>>")))


def attributes(spark):
    """Many columns out of few rows, as an ``explode`` makes them."""
    return spark.range(3).select(
        F.lit(1).cast("bigint").alias("server_id"), F.col("id").alias("attrelid"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(9).cast("bigint"))).alias("attnum")).withColumns(
        {"attname": F.concat(F.lit("c"), F.col("attnum").cast("string")), "attcollation": F.lit(0).cast("bigint"), "data_type": F.lit("bigint")})


def indexes(spark):
    return table(spark, "server_id long, indexrelid long, indrelid long, key_count long, indkey array<long>, indcollation array<long>, indclass array<long>, indoption array<long>, definitions array<string>",
                 (1, 10, 1, 1, [2, 9], [0, 0], [0, 0], [0, 0], ["c2", "c9"]), (1, 11, 2, 1, [99], [0], [0], [3], ["c99"]))


def sorting(spark):
    return (table(spark, "server_id long, oid long, collname string, collnamespace long"), table(spark, "server_id long, oid long, opcname string, opcnamespace long, opcdefault boolean"),
            table(spark, "server_id long, oid long, nspname string", (1, 5, "app")))


def sorted_joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


def test_index_keys_sorts_the_columns(spark):
    found = catalog.index_keys(indexes(spark), attributes(spark), *sorting(spark))
    assert sorted_joins(found) == 1
    assert {r.indexrelid: ([k.column_name for k in r["keys"]], r.include_columns) for r in found.collect()} == {10: (["c2"], ["c9"]), 11: ([None], [])}


def test_index_rows_sorts_all_large_sides(spark):
    base = indexes(spark).drop("key_count").withColumns({
        "version": F.lit(170000), "indnatts": F.size("indkey").cast("bigint"), "indnkeyatts": F.lit(1).cast("bigint"), "indnullsnotdistinct": F.lit(False), "database": F.lit("db"), "indpred": F.lit(None).cast("string"),
        "indexdef": F.lit("d"), **{f"indis{f}": F.lit(False) for f in ("unique", "primary", "valid", "ready", "exclusion", "clustered", "replident")}})
    classes = table(spark, "server_id long, oid long, relname string, relnamespace long, relkind string, relam long",
                    (1, 1, "t1", 5, "r", None), (1, 2, "t2", 5, "r", None), (1, 10, "i10", 5, "i", 7), (1, 11, "i11", 5, "i", 7))
    methods, usage = table(spark, "server_id long, oid long, amname string", (1, 7, "btree")), table(spark, "server_id long, indexrelid long, idx_scan long, last_idx_scan string", (1, 10, 3, "x"))
    found = catalog.index_rows(base, classes, methods, attributes(spark), *sorting(spark), usage, table(spark, "server_id long, stats_reset string", (1, "r")), table(spark, "server_id long, inhrelid long", (1, 11)))
    assert sorted_joins(found) == 6
    assert sorted((r.name, r.table, r.idx_scan, r.is_attached_partition, r.include_columns) for r in found.collect()) == [("i10", "t1", 3, False, ["c9"]), ("i11", "t2", 0, True, [])]


def test_sequence_ownership_sorts_all_large_sides(spark):
    texts = ("data_type", "start_value", "min_value", "max_value", "increment_by", "cache_size", "last_value", "cycle")
    sequences = table(spark, "server_id long, schemaname string, sequencename string", (1, "app", "s"), (1, "app", "alone")).withColumns({c: F.lit("1") for c in texts})
    classes = table(spark, "server_id long, oid long, relname string, relnamespace long, relkind string", (1, 20, "s", 5, "S"), (1, 2, "t2", 5, "r"))
    dependencies = table(spark, "server_id long, objid long, objsubid int, deptype string, refobjid long, refobjsubid long", (1, 20, 0, "a", 2, 3))
    found = catalog.sequence_ownership(sequences, sorting(spark)[2], classes, dependencies, attributes(spark))
    assert sorted_joins(found) == 4
    assert sorted((r.sequencename, r.owned_table_name, r.owned_column_name) for r in found.collect()) == [("alone", None, None), ("s", "t2", "c3")]


def test_foreign_keys_sort_all_large_sides(spark):
    constraints = table(spark, "server_id long, oid long, conname string, contype string, conrelid long, confrelid long, conindid long, conkey array<long>, confkey array<long>, confmatchtype string, confupdtype string, confdeltype string",
                        (1, 30, "fk", "f", 1, 2, 40, [4], [6], "s", "a", "a"), (1, 31, "pk", "p", 2, None, 40, [5, 6], None, None, None, None))
    classes = table(spark, "server_id long, oid long, relname string, relnamespace long", (1, 1, "t1", 5), (1, 2, "t2", 5))
    found = catalog.key_column_usage(constraints, classes, sorting(spark)[2], attributes(spark))
    assert sorted_joins(found) == 5 and sorted_joins(catalog.referential_constraints(constraints, classes, sorting(spark)[2])) == 4
    assert [(r.column_name, r.referenced_column_name, r.position_in_unique_constraint) for r in found.collect()] == [("c4", "c6", "2")]


def test_included_columns_alone_sort_the_columns(spark):
    found = catalog.index_keys(indexes(spark), attributes(spark), *sorting(spark)).select("indexrelid", "include_columns")
    assert sorted_joins(found) == 1 and sorted(map(tuple, found.collect())) == [(10, ["c9"]), (11, [])]


def test_section_rows_meet_their_layout_as_values(spark, tmp_path):
    """The maps of a report's rows do not cross the shuffle, and neither do they on the way into a report."""
    rows = spark.createDataFrame([(1, "information_schema_columns", {"TABLE_NAME": "t", "GENERATION_EXPRESSION": "a"}), (1, "information_schema_columns", {"TABLE_NAME": "u"}), (2, "information_schema_columns", {"TABLE_NAME": "v"})],
                                 "server_id long, section string, row map<string,string>").withColumn("collected_at", F.lit(0).cast("timestamp"))
    found = read.mysql_section(rows, "information_schema_columns")
    plan = found._jdf.queryExecution().optimizedPlan()
    join = next(p for p in (plan.children().head(), plan) if p.nodeName() == "Join")
    assert "map" not in join.schema().simpleString()
    assert {r.TABLE_NAME: r.GENERATION_EXPRESSION for r in found.collect()} == {"t": "a", "u": "NULL", "v": "NULL"}
    spark.range(1, 4).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("2024-01-01").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    reports = sections.section_reports(Tables(spark, str(tmp_path)), "information_schema_columns")
    assert reports.count() == 3
    assert "collect_list" not in reports._jdf.queryExecution().optimizedPlan().toString()


def test_landed_reports_are_compressed_and_whole(spark):
    reports = spark.range(50).select(F.col("id").alias("server_id"), F.lit("2026-01-01T00:00:00Z").alias("collected_at"), F.lit("Metrics").alias("report_type"),
                                     F.struct(F.repeat(F.lit("x"), 5000).alias("text")).alias("document"))
    path = landing.landed(Tables(spark, ""), reports)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = [f for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.getPath().getName().startswith("part-")]
    assert held and all(f.getPath().getName().endswith(".json.gz") for f in held) and sum(f.getLen() for f in held) < 50_000
    found = read.read_snapshots(spark, path).collect()
    assert sorted(r.server_id for r in found) == list(range(50)) and all(r.error is None and len(r.document) == 5011 for r in found)


def test_quota_places_do_not_move_the_candidates(spark):
    """Candidates stay where they are: how few places there are is known when they are joined."""
    rows = spark.range(300_000).select((F.col("id") % 3).alias("server_id"), F.lpad(F.col("id").cast("string"), 60, "0").alias("queryid"), (F.col("id") % 1000).cast("double").alias("time"))
    found = ranking.plan_quota(rows, "time", F.col("queryid").endswith("7"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert found.groupBy("server_id").count().count() == 3 and found.filter(F.col("queryid").endswith("7")).count() == 15


def test_plan_outcomes_reads_the_statements_once(spark):
    """Members and candidates come from what was stored; the smallest id of a plan decides, and missing keys have no members."""
    rows = table(spark, "server_id long, queryid string, datname string, total_exec_time_us double, mean_exec_time_us double, plan string, ok boolean, why string",
                 (1, "b", "d", 9.0, 1.0, "p", False, "x"), (1, "a", "d", 1.0, 2.0, "p", True, None), (1, None, "d", 5.0, 5.0, "p", False, None),
                 (1, "c", None, 3.0, 3.0, "q", True, None), (1, "e", "d", 4.0, 4.0, None, True, None), (None, "f", "d", 4.0, 4.0, "p", True, None))
    found = ranking.plan_outcomes(rows, F.lit(True), F.col("plan"), F.col("datname"), F.col("ok"), F.lit(False), F.col("why"))
    assert "Range (" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.queryid, r.attempt, r.outcome) for r in found.collect()), key=str) == [("a", "a", "planned"), ("b", "a", "planned"), (None, "a", "planned")]
