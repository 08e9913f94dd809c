"""Queries of the readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..sources import read, write
from . import bindings as b
from . import landing
from .base import Tables, query


def at(df):
    return df.withColumn("collected_at", F.unix_timestamp("collected_at"))


REPORT = """CASE o_orderstatus WHEN 'F' THEN 'Metrics' WHEN 'O' THEN 'Queries' ELSE 'Configurations' END"""
SERVER = "o_custkey AS server_id, CAST(epoch(o_orderdate) AS BIGINT) AS collected_at"


@query("read_snapshots", f"""SELECT {SERVER}, {REPORT} AS report_type, CAST(o_custkey AS VARCHAR) AS uptime, 't' || CAST(o_orderkey AS VARCHAR) AS first_table FROM orders""")
def read_snapshots(t: Tables):
    reports = read.read_snapshots(t.spark, landing.landed(t, landing.report_documents(t)))
    return at(reports).filter(F.col("error").isNull()).select(
        "server_id", "collected_at", "report_type", F.get_json_object("document", "$.DB.Metrics.Status.Uptime").alias("uptime"),
        F.get_json_object("document", "$.DB.DatabaseSchema.information_schema_tables[0].TABLE_NAME").alias("first_table"))


@query("explode_status", f"""SELECT {SERVER}, 'status' AS scope, 'Uptime' AS name, CAST(o_custkey AS VARCHAR) AS value FROM orders
UNION ALL SELECT {SERVER}, 'status', 'Threads', CAST(o_orderkey % 7 AS VARCHAR) FROM orders
UNION ALL SELECT {SERVER}, 'variables', 'version', '8.' || CAST(o_custkey % 9 AS VARCHAR) FROM orders UNION ALL SELECT {SERVER}, 'variables', 'port', '3306' FROM orders""")
def explode_status(t: Tables):
    return at(read.explode_status(landing.bronze(t)))


@query("explode_sections", """SELECT o_custkey AS server_id, section, count(*) AS rows FROM (
  SELECT o_custkey, 'information_schema_tables' AS section FROM orders UNION ALL SELECT o_custkey, 'information_schema_tables' FROM orders
  UNION ALL SELECT o_custkey, 'information_schema_columns' FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
  UNION ALL SELECT o_custkey, 'information_schema_columns' FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0) GROUP BY ALL""")
def explode_sections(t: Tables):
    return read.section_counts(read.explode_sections(landing.bronze(t)))


@query("mysql_sections", f"""SELECT {SERVER}, 'app' AS "TABLE_SCHEMA", 'NULL' AS "TABLE_NAME", 'c' || CAST(o_orderkey AS VARCHAR) AS "COLUMN_NAME", '' AS "EXTRA", 'NULL' AS "GENERATION_EXPRESSION"
  FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
UNION ALL SELECT {SERVER}, 'app', 'NULL', 'c' || CAST(o_orderkey AS VARCHAR), '', 'a+b' FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0""")
def mysql_sections(t: Tables):
    columns = read.mysql_section(read.explode_sections(landing.bronze(t)), "information_schema_columns")
    return at(columns).select("server_id", "collected_at", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "EXTRA", "GENERATION_EXPRESSION")


@query("info_grants", """SELECT o_custkey AS server_id, "grant", count(*) AS rows FROM (SELECT o_custkey, 'GRANT ' || o_orderstatus AS "grant" FROM orders
  UNION ALL SELECT o_custkey, 'GRANT SELECT' FROM orders) GROUP BY ALL""")
def info_grants(t: Tables):
    return read.info_grants(landing.bronze(t)).groupBy("server_id", "grant").agg(F.count(F.lit(1)).alias("rows"))


@query("info_tables", """SELECT o_custkey AS server_id, 'plpgsql' AS name, CASE WHEN o_orderkey % 2 = 0 THEN '1.0' ELSE 'NULL' END AS version, 'pg_catalog' AS schema, count(*) AS rows
FROM orders GROUP BY ALL""")
def info_tables(t: Tables):
    return read.info_extensions(landing.bronze(t)).groupBy("server_id", "name", "version", "schema").agg(F.count(F.lit(1)).alias("rows"))


@query("info_rules", f"""SELECT {SERVER}, 'host' AS type, 'all' AS database, CASE WHEN o_orderkey % 5 <> 0 THEN 'u' || CAST(o_custkey AS VARCHAR) ELSE '' END AS user_name,
  '10.0.0.0/8' AS address, '' AS auth_method, '' AS error FROM orders""")
def info_rules(t: Tables):
    return at(read.info_rules(landing.bronze(t)))


@query("stat_views", """SELECT user_id AS server_id, event_id, 'pg_stat_bgwriter' AS view, CAST(0 AS INTEGER) AS row, 'checkpoints' AS name, CAST(event_id % 9 AS VARCHAR) AS value FROM events
UNION ALL SELECT user_id, event_id, 'pg_stat_database', CAST(r AS INTEGER), 'datname', event_type || CAST(r AS VARCHAR) FROM events, (SELECT unnest([0, 1]) AS r) WHERE event_id % 2 = 0""")
def stat_views(t: Tables):
    event = F.col("event_id")
    database = F.concat(F.lit('"pg_stat_database":[{"datname":"'), F.col("event_type"), F.lit('0"},{"datname":"'), F.col("event_type"), F.lit('1"}],'))
    document = F.concat(F.lit('{"pg_stat_bgwriter":[{"checkpoints":"'), (event % 9).cast("string"), F.lit('"}],'), F.when(event % 2 == 0, database).otherwise(""),
                        F.lit('"other":[{"a":"b"}]}'))
    reports = t.events.select(F.col("user_id").alias("server_id"), event.alias("collected_at"), document.alias("document"))
    return read.stat_views(reports).withColumnRenamed("collected_at", "event_id")


@query("parse_host_json", """SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE user_id % 8 + 1 END AS vcpus, CASE WHEN event_id % 10 <> 3 THEN CAST(event_id % 50 AS DOUBLE) + value END AS reads,
  CASE WHEN event_id % 10 <> 3 THEN event_id * 1024 END AS memory_total, event_id % 10 = 3 AS is_error FROM events""")
def parse_host_json(t: Tables):
    return read.parse_host_json(host_documents(t)).select(
        "event_id", F.col("host.numVCPUs").alias("vcpus"), (F.col("host.diskIO")[0]["readIOsPS"] + F.col("host.diskIO")[1]["readIOsPS"]).alias("reads"),
        F.col("host.memory.total").alias("memory_total"), F.col("error").isNotNull().alias("is_error"))


def host_documents(t: Tables):
    """Host documents as text; every tenth is cut off."""
    event = F.col("event_id")
    disks = F.array(F.struct(F.lit("a").alias("device"), (event % 50).cast("double").alias("readIOsPS"), F.lit(1.5).alias("writeIOsPS")),
                    F.struct(F.lit("b").alias("device"), F.col("value").alias("readIOsPS"), F.lit(2.0).alias("writeIOsPS")))
    document = F.to_json(F.struct(
        F.lit("aurora").alias("engine"), (F.col("user_id") % 8 + 1).alias("numVCPUs"), F.lit("1 day").alias("uptime"), disks.alias("diskIO"),
        F.struct((event * 1024).alias("total")).alias("memory"), F.struct((event * 10).cast("double").alias("total")).alias("swap"), F.lit("x").alias("unknownField")))
    message = F.when(event % 10 == 3, F.concat(F.substring(document, 1, 40), F.lit("{"))).otherwise(document)
    return t.events.select("event_id", F.col("user_id").alias("server_id"), b.seconds("ts").alias("collected_at"), message.alias("message"))


@query("parse_recommendations", """WITH k AS (SELECT event_id, event_id % 5 AS kind, user_id FROM events)
SELECT event_id, NULL AS error, 'a' AS name, CAST(user_id AS VARCHAR) || '.50' AS value FROM k WHERE kind < 3
UNION ALL SELECT event_id, NULL, 'b', 'text' FROM k WHERE kind < 3
UNION ALL SELECT event_id, CASE kind WHEN 3 THEN '{"a": 1} tail' ELSE '[1]' END, NULL, NULL FROM k WHERE kind >= 3""")
def parse_recommendations(t: Tables):
    event = F.col("event_id") % 5
    document = (F.when(event < 3, F.concat(F.lit(' {"a": '), F.col("user_id").cast("string"), F.lit('.50, "b": "text"}'))).when(event == 3, '{"a": 1} tail').otherwise("[1]"))
    return read.parse_recommendations(t.events.select("event_id", document.alias("document")))


@query("parse_stage_log", """SELECT event_id, CAST(user_id AS INTEGER) AS task_id, CAST(event_id % 4 AS INTEGER) AS statement_index, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'started' ELSE 'failed' END AS status,
  CASE WHEN user_id % 5 = 0 THEN 'db.my t' ELSE 'db.t' END || CAST(user_id AS VARCHAR) AS "table", CASE WHEN event_id % 3 <> 0 THEN event_id % 1000 END AS duration_ms, CASE WHEN event_id % 3 = 2 THEN CASE event_id % 4 WHEN 0 THEN 'disk "x" full'
  WHEN 1 THEN 'line' || chr(10) || 'tab' || chr(9) || 'C:\\new\\table' WHEN 2 THEN 'bell' || chr(7) || ' null' || chr(1) || ' join' || chr(8203) || 'er' ELSE 'wide ' || chr(917505) || 'é' END END AS reason
FROM events WHERE event_id % 7 <> 0""")
def parse_stage_log(t: Tables):
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    name = F.concat(F.when(F.col("user_id") % 5 == 0, "db.my t").otherwise("db.t"), user)
    reason = (F.when(event % 4 == 0, r'disk \"x\" full').when(event % 4 == 1, r"line\ntab\tC:\\new\\table")
              .when(event % 4 == 2, r"bell\a null\x01 join\u200ber").otherwise(r"wide \U000e0001é"))
    line = F.concat(F.lit("2024-01-01 INFO Schema change check: task_id="), user, F.lit(" statement_index="), (event % 4).cast("string"), F.lit(" stage="), F.col("event_type"),
                    F.when(event % 3 == 0, F.concat(F.lit(" status=started table="), name))
                    .otherwise(F.concat(F.lit(" status=failed table="), name, F.lit(" duration_ms="), (event % 1000).cast("string"))),
                    F.when(event % 3 == 2, F.concat(F.lit(' reason="'), reason, F.lit('"'))).otherwise(""))
    lines = t.events.select("event_id", F.when(event % 7 == 0, "other line").otherwise(line).alias("value"))
    return read.parse_stage_log(lines)


@query("parse_event_log", """SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'aws_rds_apply_batch' ELSE 'aws_rds_discovery' END END AS event,
  CASE WHEN event_id % 6 <> 0 AND event_id % 2 = 0 THEN CAST(event_id % 5 AS INTEGER) END AS batch, CASE WHEN event_id % 6 <> 0 AND event_id % 2 = 0 THEN 'a,' || event_type END AS names,
  CASE WHEN event_id % 6 <> 0 AND event_id % 2 = 1 THEN 'db' || CAST(user_id AS VARCHAR) END AS instance, event_id % 6 = 0 AS unreadable FROM events""")
def parse_event_log(t: Tables):
    event = F.col("event_id")
    batch = F.to_json(F.struct(F.lit("aws_rds_apply_batch").alias("event"), F.lit("instance").alias("scope"), (event % 5).alias("batch"), F.array(F.lit("a"), F.col("event_type")).alias("names")))
    found = F.to_json(F.struct(F.lit("aws_rds_discovery").alias("event"), F.lit("live").alias("source"),
                               F.struct(F.concat(F.lit("db"), F.col("user_id").cast("string")).alias("db_instance_identifier")).alias("metadata")))
    lines = t.events.select("event_id", F.when(event % 6 == 0, "plain text").when(event % 2 == 0, batch).otherwise(found).alias("value"))
    return read.parse_event_log(lines).select("event_id", "event", "batch", F.array_join("names", ",").alias("names"),
                                              F.col("metadata")["db_instance_identifier"].alias("instance"), F.col("unreadable").isNotNull().alias("unreadable"))


MODES = ("Configurations", "Metrics", "Event", "Task", "TaskByName", "Other")
KINDS = ("Set", "Get", "GetJson", "GetInitial", "Queries", "Status", "custom")
ROUTE = """CASE mode WHEN 'Configurations' THEN CASE kind WHEN 'Get' THEN 'db/config/get' WHEN 'GetJson' THEN 'db/config/get' WHEN 'GetInitial' THEN 'db/config/initial' ELSE 'db/config/set' END
  WHEN 'Metrics' THEN CASE kind WHEN 'Queries' THEN 'db/metrics/queries' ELSE 'db/metrics' END WHEN 'Event' THEN 'events/' || kind
  WHEN 'Task' THEN CASE kind WHEN 'Get' THEN 'tasks/get' WHEN 'Status' THEN 'tasks/status' END WHEN 'TaskByName' THEN 'tasks/by-name/' || kind END"""


ROUTED = f"""WITH r AS (SELECT ({b.sql_list(MODES)})[CAST(o_orderkey % 6 AS INTEGER) + 1] AS mode, ({b.sql_list(KINDS)})[CAST(o_custkey % 7 AS INTEGER) + 1] AS kind, o_orderdate FROM orders)
SELECT replace({ROUTE}, '/', '_') AS route, CAST(CAST(date_trunc('year', o_orderdate) AS DATE) AS VARCHAR) AS day, count(*) AS reports FROM r GROUP BY ALL"""


def routable(t: Tables):
    from .catalog import pick

    return t.orders.select(F.col("o_custkey").alias("server_id"), F.date_trunc("YEAR", "o_orderdate").alias("collected_at"), pick(MODES, "o_orderkey").alias("mode"),
                           pick(KINDS, "o_custkey").alias("report_type"))


def routed_counts(t: Tables, path: str):
    return t.spark.read.parquet(path).groupBy("route", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("reports"))


@query("route_reports", ROUTED)
def route_reports(t: Tables):
    """Reports are written below their route and day (here the first day of the year) and read back."""
    path = landing.fresh_dir(t, "routed")
    write.write_routed(routable(t), path)
    return routed_counts(t, path)


@query("route_reports_stream", ROUTED)
def route_reports_stream(t: Tables):
    """The same through the stream, in bounded batches."""
    landed, path = landing.fresh_dir(t, "landed"), landing.fresh_dir(t, "routed")
    reports = routable(t)
    reports.write.parquet(landed)
    files = t.spark.sparkContext.defaultParallelism
    stream = t.spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", files).parquet(landed)
    write.write_routed_stream(stream, path, landing.fresh_dir(t, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return routed_counts(t, path)


@query("redact", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || ' pass=' || CAST(user_id AS VARCHAR) || '.* end' ELSE event_type || ' pass=*** end' END AS reason,
  '{"Host":"h' || CAST(user_id AS VARCHAR) || '"}' AS conf FROM events""")
def redact(t: Tables):
    secret = F.concat(F.col("user_id").cast("string"), F.lit(".*"))
    reason = F.concat(F.lit(" "), F.col("event_type"), F.lit(" \n pass="), secret, F.lit("\t end "))
    conf = F.concat(F.lit('{"MysqlPassword":"s","Host":"h'), F.col("user_id").cast("string"), F.lit('","PgPassword":"t"}'))
    return t.events.select("event_id", write.log_reason(reason, F.when(F.col("event_id") % 4 != 0, secret)).alias("reason"), write.without_secrets(conf).alias("conf"))


@query("pg_sections", f"""SELECT o_custkey AS server_id, section, CAST(list_position({b.sql_list(catalog.POSTGRES_SECTIONS)}, section) AS INTEGER) AS position, count(*) AS rows FROM (
  SELECT o_custkey, 'information_schema_tables' AS section FROM orders UNION ALL SELECT o_custkey, 'information_schema_tables' FROM orders
  UNION ALL SELECT o_custkey, 'information_schema_columns' FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
  UNION ALL SELECT o_custkey, 'information_schema_columns' FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0) GROUP BY ALL""")
def pg_sections(t: Tables):
    return read.postgres_sections(read.explode_sections(landing.bronze(t)), catalog.POSTGRES_SECTIONS)
