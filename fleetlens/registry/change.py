"""Queries of change readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups
from ..plans import change
from . import bindings as b
from .base import Tables, query

STATEMENTS = """
base AS (SELECT l_orderkey AS task_id, l_linenumber AS statement_index, max(l_partkey) AS p, max(l_suppkey) AS q FROM lineitem GROUP BY ALL),
stmts AS (SELECT task_id, statement_index, CASE WHEN p % 50 = 0 THEN ' ' ELSE 'db' || CAST(q % 9 AS VARCHAR) END AS schema_name, CASE WHEN p % 61 = 0 THEN '' ELSE 'ALTER TABLE t' || CAST(p AS VARCHAR) || ' ADD c INT' END AS ddl,
  p % 11 <> 0 AS syntax_valid, CASE WHEN p % 37 = 0 THEN '' ELSE 'db' || CAST(q % 9 AS VARCHAR) END AS target_schema, 't' || CAST(p AS VARCHAR) AS target_table, CASE WHEN p % 13 = 0 THEN '' ELSE 'InnoDB' END AS engine,
  p % 3 <> 0 AS ok_online, p % 2 <> 0 AS ok_copy_tool, q % 4 = 0 AS backup_wanted, q % 8 <> 0 AS ok_recovery, p % 5 <> 0 AS ok_physical FROM base),
tasks AS (SELECT o_orderkey AS task_id, o_orderkey % 10 <> 0 AS enabled FROM orders),
spoiled AS (SELECT task_id, bool_or(trim(schema_name) = '' OR trim(ddl) = '' OR (syntax_valid AND (trim(target_schema) = '' OR trim(target_table) = ''))) AS spoiled FROM stmts GROUP BY 1),
coded AS (SELECT s.task_id, s.statement_index, CASE WHEN NOT t.enabled THEN 10 WHEN x.spoiled THEN 2 WHEN NOT syntax_valid THEN 4 WHEN engine = '' THEN 5 WHEN NOT ok_online AND NOT ok_copy_tool THEN 5
    WHEN backup_wanted AND NOT ok_recovery THEN 6 ELSE 0 END AS exit_code, CASE WHEN backup_wanted THEN CASE WHEN ok_physical THEN 'physical' ELSE 'logical' END ELSE 'none' END AS kind
  FROM stmts s LEFT JOIN tasks t ON t.task_id = s.task_id LEFT JOIN spoiled x ON x.task_id = s.task_id),
gated AS (SELECT task_id, statement_index, exit_code, CASE WHEN exit_code = 0 THEN kind END AS backup, coalesce(bool_and(exit_code = 0) OVER (PARTITION BY task_id ORDER BY statement_index
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS run FROM coded)"""


def statements(t: Tables):
    p, q = F.col("p"), F.col("q")
    base = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("statement_index")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("q"))
    schema = F.concat(F.lit("db"), (q % 9).cast("string"))
    return base.select(
        "task_id", "statement_index", F.when(p % 50 == 0, " ").otherwise(schema).alias("schema_name"),
        F.when(p % 61 == 0, "").otherwise(F.concat(F.lit("ALTER TABLE t"), p.cast("string"), F.lit(" ADD c INT"))).alias("ddl_statement"), (p % 11 != 0).alias("syntax_valid"),
        F.when(p % 37 == 0, "").otherwise(schema).alias("target_schema"), F.concat(F.lit("t"), p.cast("string")).alias("target_table"), F.when(p % 13 == 0, "").otherwise("InnoDB").alias("engine"),
        (p % 3 != 0).alias("ok_online"), (p % 2 != 0).alias("ok_copy_tool"), (q % 4 == 0).alias("backup_wanted"), (q % 8 != 0).alias("ok_recovery"), (p % 5 != 0).alias("ok_physical"))


def tasks(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 10 != 0).alias("enabled"))


@query("change_gate", f"WITH {STATEMENTS} SELECT * FROM gated")
def change_gate(t: Tables):
    return change.change_gate(statements(t), tasks(t)).select("task_id", "statement_index", "exit_code", "backup", "run")


@query("task_gate", f"""WITH {STATEMENTS}, first AS (SELECT task_id, arg_min(exit_code, statement_index) AS code FROM coded WHERE exit_code <> 0 GROUP BY 1)
SELECT t.task_id, CASE WHEN NOT t.enabled THEN 10 WHEN s.task_id IS NULL THEN 3 ELSE coalesce(f.code, 0) END AS exit_code
FROM tasks t LEFT JOIN (SELECT DISTINCT task_id FROM stmts) s ON s.task_id = t.task_id LEFT JOIN first f ON f.task_id = t.task_id""")
def task_gate(t: Tables):
    return change.task_gate(statements(t), change.change_gate(statements(t), tasks(t)), tasks(t))


FILESYSTEMS = """
filesystems AS (SELECT server_id, CASE WHEN server_id = 9 THEN 0 ELSE (server_id + 1) * 1500000 END AS total_bytes, CASE WHEN server_id = 3 THEN 500000 ELSE (server_id + 1) * 200000 END AS free_bytes
  FROM (SELECT DISTINCT p_partkey % 10 AS server_id FROM part))"""


def filesystems(t: Tables):
    server = F.col("server_id")
    return t.part.select((F.col("p_partkey") % 10).alias("server_id")).distinct().select(
        "server_id", F.when(server == 9, 0).otherwise((server + 1) * 1500000).alias("total_bytes"), F.when(server == 3, 500000).otherwise((server + 1) * 200000).alias("free_bytes"))


@query("datadir_headroom", f"""WITH {b.TABLE_CATALOG}, {FILESYSTEMS}
SELECT c.server_id, c.table_schema, c.table_name, CASE WHEN f.total_bytes <= 0 THEN 'invalid-filesystem' WHEN f.free_bytes / f.total_bytes <= 0.10::DOUBLE THEN 'low-free-space'
  WHEN (f.total_bytes - f.free_bytes + coalesce(data_length, 0) + coalesce(index_length, 0)) / f.total_bytes > 0.90::DOUBLE THEN 'no-room-for-copy' END AS reason
FROM catalog c JOIN filesystems f ON f.server_id = c.server_id""")
def datadir_headroom(t: Tables):
    tables = b.table_catalog(t)
    sizes = tables.select("server_id", "table_schema", "table_name", "data_length", "index_length")
    return change.datadir_headroom(tables.select("server_id", "table_schema", "table_name"), sizes, filesystems(t))


@query("backup_headroom", f"""WITH {b.TABLE_CATALOG}, {FILESYSTEMS}, needed AS (SELECT server_id, table_schema, table_name, coalesce(data_length, 0) + coalesce(index_length, 0) AS table_bytes FROM catalog),
sized AS (SELECT *, CAST(floor(CASE WHEN table_bytes = 0 THEN 0.1::DOUBLE ELSE table_bytes::DOUBLE * 2.0::DOUBLE / 1048576 END * 1048576) AS BIGINT) AS logical FROM needed),
buffered AS (SELECT *, logical + CAST(floor(logical::DOUBLE * 20.0::DOUBLE / 100.0::DOUBLE) AS BIGINT) AS required_bytes FROM sized)
SELECT b.server_id, table_schema, table_name, required_bytes, free_bytes >= required_bytes AS fits FROM buffered b JOIN filesystems f ON f.server_id = b.server_id""")
def backup_headroom(t: Tables):
    return change.backup_headroom(rollups.bytes_required(b.table_catalog(t)), filesystems(t), "logical").select(
        "server_id", "table_schema", "table_name", "required_bytes", "fits")


@query("backup_headroom_physical", f"""WITH {b.TABLE_CATALOG}, {FILESYSTEMS}, needed AS (SELECT server_id, table_schema, table_name, coalesce(sum(data_length + index_length) OVER (PARTITION BY server_id, table_schema), 0) AS schema_bytes FROM catalog),
sized AS (SELECT *, CAST(floor(CASE WHEN schema_bytes = 0 THEN 0.1::DOUBLE ELSE schema_bytes::DOUBLE * 1.2::DOUBLE / 1048576 END * 1048576) AS BIGINT) AS physical FROM needed),
buffered AS (SELECT *, physical + CAST(floor(physical::DOUBLE * 20.0::DOUBLE / 100.0::DOUBLE) AS BIGINT) AS required_bytes FROM sized)
SELECT b.server_id, table_schema, table_name, required_bytes, free_bytes >= required_bytes AS fits FROM buffered b JOIN filesystems f ON f.server_id = b.server_id""")
def backup_headroom_physical(t: Tables):
    return change.backup_headroom(rollups.bytes_required(b.table_catalog(t)), filesystems(t), "physical").select(
        "server_id", "table_schema", "table_name", "required_bytes", "fits")


REQUESTS = """
requests AS (SELECT o_custkey AS task_id, o_orderkey AS request_index, o_custkey % 10 AS server_id, CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE 'db' || CAST(o_orderkey % 12 AS VARCHAR) END AS schema_name,
  CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'select ' || CAST(o_orderkey AS VARCHAR) END AS query_text, CASE o_orderkey % 5 WHEN 0 THEN 'error: need_grant_permission' WHEN 1 THEN 'other' END AS explain_error FROM orders),
checked AS (SELECT *, CASE WHEN trim(schema_name) = '' OR trim(query_text) = '' THEN 3 WHEN NOT (CAST(substr(schema_name, 3) AS INTEGER) < 11) THEN 4 WHEN schema_name = 'db' || CAST(server_id AS VARCHAR) AND server_id % 2 = 0 THEN 5
  WHEN contains(explain_error, 'need_grant_permission') THEN 6 WHEN explain_error IS NOT NULL THEN 7 ELSE 0 END AS exit_code FROM requests),
reached AS (SELECT *, coalesce(bool_and(NOT exit_code BETWEEN 1 AND 5) OVER (PARTITION BY task_id ORDER BY request_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS run FROM checked)"""


def requests(t: Tables):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(
        cust.alias("task_id"), order.alias("request_index"), (cust % 10).alias("server_id"), F.when(order % 23 == 0, " ").otherwise(F.concat(F.lit("db"), (order % 12).cast("string"))).alias("schema_name"),
        F.when(order % 41 == 0, "").otherwise(F.concat(F.lit("select "), order.cast("string"))).alias("query_text"),
        F.when(order % 5 == 0, "error: need_grant_permission").when(order % 5 == 1, "other").alias("explain_error"))
    known = t.orders.select((cust % 10).alias("server_id"), F.concat(F.lit("db"), (order % 11).cast("string")).alias("schema_name"))
    server = F.col("c_custkey") % 10
    broken = t.customer.select(server.alias("server_id"), F.concat(F.when(server % 2 == 0, "db").otherwise("another"), server.cast("string")).alias("schema_name"))
    return change.explain_request_check(rows, known, broken)


@query("explain_request_check", f"WITH {REQUESTS} SELECT task_id, request_index, exit_code, run FROM reached")
def explain_request_check(t: Tables):
    return requests(t).select("task_id", "request_index", "exit_code", "run")


@query("explain_task_codes", f"""WITH {REQUESTS}, failed AS (SELECT task_id, arg_max(exit_code, request_index) AS code FROM reached WHERE run AND exit_code <> 0 GROUP BY task_id)
SELECT c_custkey AS task_id, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 2 ELSE coalesce(f.code, 0) END AS exit_code FROM customer LEFT JOIN failed f ON f.task_id = c_custkey""")
def explain_task_codes(t: Tables):
    return change.explain_task_codes(t.customer.select(F.col("c_custkey").alias("task_id")), requests(t))


@query("collected_schemas", f"WITH {REQUESTS} SELECT DISTINCT task_id, schema_name FROM reached WHERE run AND (exit_code = 0 OR exit_code > 5)")
def collected_schemas(t: Tables):
    return change.collected_schemas(requests(t))


@query("task_selection", """WITH t AS (SELECT o_orderkey - 5 AS task_id, o_orderkey % 10 - 1 AS task_type_id, CASE o_custkey % 3 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'full' ELSE CASE WHEN o_custkey % 9 = 2 THEN 'other' ELSE 'full' END END AS apply_mode,
  CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '{broken' ELSE '{"configuration_status_id": ' || CAST(o_custkey % 7 - 2 AS VARCHAR) || '}' END AS task_details, o_custkey % 5 AS k, o_custkey % 7 - 2 AS chosen FROM orders),
e AS (SELECT *, CASE WHEN task_id <= 0 OR task_type_id < 0 THEN 'no-task' WHEN apply_mode NOT IN ('dynamic', 'full') THEN 'invalid-mode' WHEN k = 0 AND task_type_id = 8 THEN 'selection-required'
  WHEN k = 1 THEN 'invalid-details' WHEN k > 1 AND chosen < 0 THEN 'invalid-selection' WHEN k > 1 AND task_type_id = 8 AND chosen = 0 THEN 'selection-required' END AS error FROM t)
SELECT task_id, task_type_id, error, CASE WHEN error IS NULL THEN CASE WHEN k = 0 THEN 0 ELSE CAST(chosen AS INTEGER) END END AS configuration_id FROM e""")
def task_selection(t: Tables):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    mode = F.when(cust % 3 == 0, "dynamic").when(cust % 3 == 1, "full").when(cust % 9 == 2, "other").otherwise("full")
    details = F.when(cust % 5 == 0, "").when(cust % 5 == 1, "{broken").otherwise(F.concat(F.lit('{"configuration_status_id": '), (cust % 7 - 2).cast("string"), F.lit("}")))
    rows = t.orders.select((order - 5).alias("task_id"), (order % 10 - 1).alias("task_type_id"), mode.alias("apply_mode"), details.alias("task_details"))
    return change.task_selection(rows).select("task_id", "task_type_id", "error", "configuration_id")
