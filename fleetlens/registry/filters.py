"""Queries of the predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import rollups
from . import bindings as b
from .base import Tables, query

ALLOWED = "CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'db1996,db1998' ELSE 'db1997, db1999,db2000' END"


@query("schema_allowed", f"""WITH s AS (SELECT l_suppkey, 'db' || CAST(year(l_shipdate) AS VARCHAR) AS schema_name, {ALLOWED} AS allowed FROM lineitem)
SELECT l_suppkey AS server_id, schema_name, count(*) AS rows FROM s WHERE allowed = '' OR list_contains(string_split(allowed, ','), schema_name) GROUP BY ALL""")
def schema_allowed(t: Tables):
    allowed = F.when(F.col("l_suppkey") % 3 == 0, "").when(F.col("l_suppkey") % 3 == 1, "db1996,db1998").otherwise("db1997, db1999,db2000")
    schema = F.concat(F.lit("db"), F.year("l_shipdate").cast("string"))
    rows = t.lineitem.select(F.col("l_suppkey").alias("server_id"), schema.alias("schema_name"), allowed.alias("allowed"))
    return rows.filter(f.schema_allowed(F.col("schema_name"), F.col("allowed"))).groupBy("server_id", "schema_name").agg(F.count(F.lit(1)).alias("rows"))


SCHEMAS = ("public", "information_schema", "pg_catalog", "pg_toast", "pg_toast_temp_1", "pg_temp_3", "pg_tempx1", "app", "pg_temp")
KINDS = ("r", "p", "v", "m", "f", "t", "i", "S")


@query("user_schema", f"""WITH s AS (SELECT p_partkey, ({list(SCHEMAS)})[CAST(p_partkey % 9 AS INTEGER) + 1] AS nspname FROM part)
SELECT p_partkey, nspname FROM s WHERE nspname NOT IN ('information_schema', 'pg_catalog') AND nspname NOT LIKE 'pg_toast%' AND nspname NOT LIKE 'pg_temp_%'""")
def user_schema(t: Tables):
    name = F.array(*[F.lit(x) for x in SCHEMAS])[(F.col("p_partkey") % 9).cast("int")]
    return t.part.select("p_partkey", name.alias("nspname")).filter(f.user_schema(F.col("nspname")))


@query("relkind_filter", f"""WITH s AS (SELECT p_partkey, ({list(KINDS)})[CAST(p_partkey % 8 AS INTEGER) + 1] AS relkind FROM part)
SELECT p_partkey, relkind, relkind IN ('r', 'p', 'v', 'm', 'f') AS in_tables, relkind IN ('r', 't', 'm', 'p') AS in_statistics FROM s""")
def relkind_filter(t: Tables):
    kind = F.array(*[F.lit(x) for x in KINDS])[(F.col("p_partkey") % 8).cast("int")]
    return t.part.select("p_partkey", kind.alias("relkind"), f.relkind_filter(kind).alias("in_tables"), f.relkind_filter(kind, True).alias("in_statistics"))


INSTANCES = (" AWS/RDS ", "gcp/cloudsql", "azure/postgresql", "local")
DATABASES = ("rdsadmin", "CloudSQLAdmin", "azure_maintenance", "postgres", " rdsadmin ")


@query("managed_internal_db", f"""WITH d AS (SELECT o_orderkey, ({list(INSTANCES)})[CAST(o_orderkey % 4 AS INTEGER) + 1] AS instance_type,
  ({list(DATABASES)})[CAST(o_custkey % 5 AS INTEGER) + 1] AS datname FROM orders)
SELECT o_orderkey, instance_type, datname FROM d WHERE NOT ((lower(trim(instance_type)), lower(trim(datname))) IN
  (('aws/rds', 'rdsadmin'), ('gcp/cloudsql', 'cloudsqladmin'), ('azure/postgresql', 'azure_maintenance')))""")
def managed_internal_db(t: Tables):
    rows = t.orders.select("o_orderkey", F.array(*[F.lit(x) for x in INSTANCES])[(F.col("o_orderkey") % 4).cast("int")].alias("instance_type"),
                           F.array(*[F.lit(x) for x in DATABASES])[(F.col("o_custkey") % 5).cast("int")].alias("datname"))
    return rows.filter(f.not_managed_database(F.col("instance_type"), F.col("datname")))


@query("active_sessions", """WITH s AS (SELECT user_id % 10 AS server_id, event_id AS pid, 'db' || CAST(user_id AS VARCHAR) AS datname, 'u' || CAST(user_id AS VARCHAR) AS usename,
  CASE WHEN event_id % 3 <> 0 THEN '10.0.0.' || CAST(user_id AS VARCHAR) END AS client_addr, CASE WHEN event_id % 4 <> 0 THEN event_id % 1000 END AS client_port,
  CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'idle' WHEN 'error' THEN NULL ELSE 'idle in transaction' END AS state,
  CASE WHEN event_id % 5 <> 0 THEN 'Lock' END AS wt, CASE WHEN event_id % 7 <> 0 THEN 'tuple' END AS we, ts,
  CASE WHEN event_id % 2 = 0 THEN ts END AS xact_start, props AS query,
  CASE WHEN event_id % 11 <> 0 THEN 'app' || CAST(user_id % 7 AS VARCHAR) ELSE '' END AS application_name, CASE WHEN event_id % 13 = 0 THEN 'walsender' ELSE 'client backend' END AS backend_type FROM events)
SELECT server_id, pid, datname, usename, coalesce(client_addr, 'local') || coalesce(':' || CAST(client_port AS VARCHAR), '') AS client_address, application_name, backend_type, state,
  concat_ws(' ', wt, we) AS wait_event, CAST(round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1000000.0::DOUBLE, 0) AS BIGINT) AS query_time,
  CAST(round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(xact_start)) / 1000000.0::DOUBLE, 0) AS BIGINT) AS tx_time,
  CAST(round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1000000.0::DOUBLE, 0) AS BIGINT) AS state_time, query FROM s WHERE state IS NOT NULL""")
def active_sessions(t: Tables):
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    sessions = t.events.select(
        (F.col("user_id") % 10).alias("server_id"), event.alias("pid"), F.concat(F.lit("db"), user).alias("datname"), F.concat(F.lit("u"), user).alias("usename"),
        F.when(event % 3 != 0, F.concat(F.lit("10.0.0."), user)).alias("client_addr"), F.when(event % 4 != 0, event % 1000).alias("client_port"),
        F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "click", "idle").when(F.col("event_type") == "error", None)
        .otherwise("idle in transaction").alias("state"),
        F.when(event % 5 != 0, "Lock").alias("wait_event_type"), F.when(event % 7 != 0, "tuple").alias("wait_event"),
        F.col("ts").alias("query_start"), F.when(event % 2 == 0, F.col("ts")).alias("xact_start"), F.col("ts").alias("state_change"),
        F.col("props").alias("query"),
        F.when(event % 11 != 0, F.concat(F.lit("app"), (F.col("user_id") % 7).cast("string"))).otherwise("").alias("application_name"),
        F.when(event % 13 == 0, "walsender").otherwise("client backend").alias("backend_type"))
    return f.active_sessions(sessions, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), b.micros)


TEXTS = ("select * from t where a = 1", "SELECT SQL_NO_CACHE * FROM t", "select SQL_NO_CACHE * from t where a = 1", "EXPLAIN FORMAT=JSON select 1",
         "insert into t values (1)", "/* app */ with x as (select 1) select * from x", "select a from ...", "", "-- c\nselect 2", "update t set a = 1")
SCHEMA_NAMES = ("app", "shop", "mysql", "NULL", "crm", "performance_schema")


@query("mysql_candidate_filter", f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  ({b.sql_list(TEXTS)})[CAST(l_partkey % 10 AS INTEGER) + 1] AS q, ({b.sql_list(SCHEMA_NAMES)})[CAST(l_suppkey % 6 AS INTEGER) + 1] AS s,
  CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'app,crm,mysql' END AS allowed, l_linenumber = 2 AS resolved, CAST(epoch(l_shipdate) AS BIGINT) AS last_seen FROM lineitem),
r AS (SELECT *, CASE WHEN q = '' THEN 'no-text' WHEN allowed <> '' AND NOT list_contains(string_split(allowed, ','), s) THEN 'schema-not-allowed'
  WHEN (contains(q, 'SELECT') OR contains(q, 'select')) AND contains(q, 'SQL_NO_CACHE') AND NOT (contains(q, 'WHERE') OR contains(q, 'where')) THEN 'dump'
  WHEN contains(q, 'EXPLAIN FORMAT=JSON') THEN 'own-plan' WHEN s IN ('mysql', 'information_schema', 'performance_schema', 'NULL') THEN 'system-schema'
  WHEN NOT regexp_matches(lower(q), '^(\\s|--[^\\n]*|/\\*.*?\\*/)*(select|with)\\b') THEN 'not-explainable' WHEN resolved THEN 'resolved'
  WHEN q LIKE '%...' THEN 'need_full_query' WHEN last_seen < CAST(epoch(TIMESTAMP '1998-06-01') AS BIGINT) - 604800 THEN 'not-seen-lately' ELSE 'candidate' END AS reason FROM d)
SELECT s AS schema_name, q AS query_text, reason, count(*) AS rows FROM r GROUP BY ALL""")
def mysql_candidate_filter(t: Tables):
    digests = t.lineitem.select(
        F.array(*[F.lit(x) for x in TEXTS])[(F.col("l_partkey") % 10).cast("int")].alias("query_text"),
        F.array(*[F.lit(x) for x in SCHEMA_NAMES])[(F.col("l_suppkey") % 6).cast("int")].alias("schema_name"),
        F.when(F.col("l_orderkey") % 2 == 0, "").otherwise("app,crm,mysql").alias("allowed"),
        F.when(F.col("l_linenumber") == 2, "{}").alias("explain"), F.lit(None).cast("string").alias("explain_error"), b.seconds("l_shipdate").alias("last_seen"))
    reason = f.mysql_candidate_reason(digests, F.col("allowed"), b.seconds(F.lit("1998-06-01 00:00:00")))
    return digests.groupBy("schema_name", "query_text", F.coalesce(reason, F.lit("candidate")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


PG_DATABASES = ("app", "template0", "template1", "NULL", "shop", "crm")


@query("pg_candidate_filter", f"""WITH d AS (SELECT ({b.sql_list(TEXTS)})[CAST(l_partkey % 10 AS INTEGER) + 1] AS q, ({b.sql_list(PG_DATABASES)})[CAST(l_suppkey % 6 AS INTEGER) + 1] AS s,
  CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'app,shop' END AS allowed, l_linenumber = 2 AS failed FROM lineitem),
r AS (SELECT *, CASE WHEN s IN ('template0', 'template1', 'NULL') THEN 'system-database' WHEN NOT regexp_matches(lower(q), '^(\\s|--[^\\n]*|/\\*.*?\\*/)*(select|with)\\b') THEN 'not-explainable'
  WHEN allowed <> '' AND NOT list_contains(string_split(allowed, ','), s) THEN 'schema-not-allowed' WHEN failed THEN 'database-failed' ELSE 'candidate' END AS reason FROM d)
SELECT s AS datname, q AS query, reason, count(*) AS rows FROM r GROUP BY ALL""")
def pg_candidate_filter(t: Tables):
    rows = t.lineitem.select(
        F.array(*[F.lit(x) for x in TEXTS])[(F.col("l_partkey") % 10).cast("int")].alias("query"),
        F.array(*[F.lit(x) for x in PG_DATABASES])[(F.col("l_suppkey") % 6).cast("int")].alias("datname"),
        F.when(F.col("l_orderkey") % 2 == 0, "").otherwise("app,shop").alias("allowed"), (F.col("l_linenumber") == 2).alias("failed"))
    reason = f.postgres_candidate_reason(F.col("datname"), F.col("query"), F.col("allowed"), F.col("failed"))
    return rows.groupBy("datname", "query", F.coalesce(reason, F.lit("candidate")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query("null_query_id", f"WITH {b.STATEMENT_STATS} SELECT server_id, dbid, count(*) AS rows FROM stats WHERE queryid IS NOT NULL GROUP BY ALL")
def null_query_id(t: Tables):
    return f.null_query_id(b.statement_stats(t)).groupBy("server_id", "dbid").agg(F.count(F.lit(1)).alias("rows"))


@query("process_fields", """SELECT doc_id % 10 AS server_id, CAST(doc_id AS VARCHAR) AS "ID", source AS "USER", 'NULL' AS "HOST",
  CASE WHEN doc_id % 4 = 0 THEN 'NULL' ELSE lang END AS "DB", 'Query' AS "COMMAND", CAST(n_chars AS VARCHAR) AS "TIME", 'NULL' AS "STATE", coalesce(text, 'NULL') AS "INFO" FROM documents""")
def process_fields(t: Tables):
    processes = t.documents.select(
        (F.col("doc_id") % 10).alias("server_id"), F.col("doc_id").alias("Id"), F.col("source").alias("User"), F.lit(None).cast("string").alias("Host"),
        F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("db"), F.lit("Query").alias("Command"), F.col("n_chars").alias("Time"),
        F.lit(None).cast("string").alias("State"), F.col("text").alias("Info"), F.lit(1).alias("Rows_sent"))
    return f.process_fields(processes)


@query("index_usage_cutoff", f"""WITH {b.TABLE_CATALOG}, counts AS (SELECT server_id, table_schema, count(*) * 20000 AS tables FROM catalog GROUP BY ALL)
SELECT c.table_schema AS server_id, c.table_name FROM catalog c JOIN (SELECT table_schema, sum(tables) AS tables FROM counts GROUP BY 1) n ON n.table_schema = c.table_schema
WHERE n.tables <= 1600000""")
def index_usage_cutoff(t: Tables):
    """Schemas stand for servers and every table for 20,000, so that some servers pass the limit."""
    usage = b.table_catalog(t).select(F.col("table_schema").alias("server_id"), "table_name")
    counts = rollups.row_count(usage, "tables").withColumn("tables", F.col("tables") * 20000)
    return f.index_usage_cutoff(usage, counts, 1_600_000)
