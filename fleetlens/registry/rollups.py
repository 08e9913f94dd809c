"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import timer_to_us
from ..operators import rollups
from . import bindings as b
from .base import Tables, query


STATEMENT_COLUMNS = ("server_id, dbid, datname, pg_queryid, toplevel, queryid, calls, total_exec_time_us, mean_exec_time_us")


@query("statement_rollup", f"WITH {b.STATEMENT_STATS} SELECT {STATEMENT_COLUMNS} FROM statements")
def statement_rollup(t: Tables):
    return (rollups.statement_rollup(b.statement_stats(t), b.databases(t))
            .withColumn("calls", F.col("calls").cast("bigint")))


@query("statement_rollup_full", f"WITH {b.STATEMENT_STATS} SELECT {STATEMENT_COLUMNS}, query, rows FROM statements")
def statement_rollup_full(t: Tables):
    return (rollups.statement_rollup_full(b.statement_stats(t), b.databases(t))
            .withColumn("calls", F.col("calls").cast("bigint")).withColumn("rows", F.col("rows").cast("bigint")))


@query("database_names", f"""WITH {b.STATEMENT_STATS}
SELECT s.server_id, s.dbid, coalesce(d.datname, 'NULL') AS datname, count(*) AS statements
FROM stats s LEFT JOIN databases d ON d.server_id = s.server_id AND d.oid = s.dbid GROUP BY ALL""")
def database_names(t: Tables):
    named = rollups.database_names(b.statement_stats(t), b.databases(t))
    return named.groupBy("server_id", "dbid", "datname").agg(F.count(F.lit(1)).alias("statements"))


LIGHT = f"""server_id, snapshot_id, line, coalesce(schema_name, 'NULL') AS schema_name, coalesce(digest, 'NULL') AS query_id,
  count_star AS calls, (avg_timer_wait + 500000) // 1000000 AS avg_time_us,
  CAST((sum_timer_wait + 500000) // 1000000 AS BIGINT) AS sum_time_us"""


def _times(df):
    return df.withColumn("avg_time_us", F.col("avg_time_us").cast("bigint")).withColumn("sum_time_us", F.col("sum_time_us").cast("bigint"))


@query("digest_summary_light", f"WITH {b.DIGEST_SUMMARY} SELECT {LIGHT} FROM digests")
def digest_summary_light(t: Tables):
    return _times(rollups.digest_summary_light(b.digest_summary(t)))


@query("digest_summary_full", f"""WITH {b.DIGEST_SUMMARY} SELECT {LIGHT}, coalesce(digest_text, 'NULL') AS query,
  coalesce(query_sample_text, 'NULL') AS query_text, {', '.join(b.COUNTERS)},
  CAST(CAST(epoch(first_seen) AS BIGINT) AS DOUBLE) AS "FIRST_SEEN", CAST(CAST(epoch(last_seen) AS BIGINT) AS DOUBLE) AS "LAST_SEEN"
FROM digests""")
def digest_summary_full(t: Tables):
    full = _times(rollups.digest_summary_full(b.digest_summary(t), b.COUNTERS, b.seconds))
    return full.withColumns({c: F.col(c).cast("bigint") for c in b.COUNTERS})


@query("timer_to_us", f"""WITH {b.DIGEST_SUMMARY} SELECT server_id, CAST(sum((sum_timer_wait + 500000) // 1000000) AS BIGINT) AS sum_time_us
FROM digests GROUP BY server_id""")
def timers(t: Tables):
    rows = b.digest_summary(t).select("server_id", timer_to_us(F.col("sum_timer_wait")).alias("us"))
    return rows.groupBy("server_id").agg(F.sum("us").cast("bigint").alias("sum_time_us"))


ENGINE_SIZES = f"""{b.TABLE_CATALOG}, sizes AS (
  SELECT server_id, engine, count(*) AS tables, CAST(coalesce(sum(data_length + index_length), 0) AS BIGINT) AS total_size,
    CAST(coalesce(sum(data_length), 0) AS BIGINT) AS data_size, CAST(coalesce(sum(index_length), 0) AS BIGINT) AS index_size
  FROM catalog WHERE engine IS NOT NULL GROUP BY server_id, engine)"""


def bigints(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query("engine_sizes", f"WITH {ENGINE_SIZES} SELECT * FROM sizes")
def engine_sizes(t: Tables):
    return bigints(rollups.engine_sizes(b.table_catalog(t)), "total_size", "data_size", "index_size")


@query("engine_sizes_by_snapshot", f"""WITH {b.TABLE_CATALOG}, taken AS (SELECT *, unnest([100, 200]) AS collected_at FROM catalog)
SELECT server_id, collected_at, engine, count(*) AS tables, CAST(coalesce(sum(data_length + index_length), 0) AS BIGINT) AS total_size,
  CAST(coalesce(sum(data_length), 0) AS BIGINT) AS data_size, CAST(coalesce(sum(index_length), 0) AS BIGINT) AS index_size
FROM taken WHERE engine IS NOT NULL GROUP BY server_id, collected_at, engine""")
def engine_sizes_by_snapshot(t: Tables):
    catalog = b.table_catalog(t)
    taken = catalog.withColumn("collected_at", F.lit(100)).unionByName(catalog.withColumn("collected_at", F.lit(200)))
    return bigints(rollups.engine_sizes(taken), "total_size", "data_size", "index_size")


@query("table_type_sizes", f"""WITH {b.TABLE_CATALOG}
SELECT server_id, table_type, count(*) AS tables,
  CAST(coalesce(sum(coalesce(data_length, 0) + coalesce(index_length, 0)), 0) AS BIGINT) AS total_size
FROM catalog GROUP BY server_id, table_type""")
def table_type_sizes(t: Tables):
    size = F.coalesce("data_length", F.lit(0)) + F.coalesce("index_length", F.lit(0))
    return bigints(rollups.table_type_sizes(b.table_catalog(t), size), "total_size")


@query("size_totals", f"""WITH {ENGINE_SIZES}, scaled AS (SELECT server_id, tables, total_size::HUGEINT * 10000000000 AS size FROM sizes)
SELECT server_id, CAST(sum(tables) AS BIGINT) AS tables,
  CAST(least(sum(least(size, 18446744073709551615)), 18446744073709551615::HUGEINT) AS VARCHAR) AS total_size
FROM scaled GROUP BY server_id""")
def size_totals(t: Tables):
    """Sizes are scaled up so that some servers reach the limit."""
    from ..functions.normalize import saturated

    sizes = rollups.engine_sizes(b.table_catalog(t)).withColumn(
        "total_size", saturated(F.col("total_size") * F.lit(10000000000).cast("decimal(11,0)")))
    totals = rollups.size_totals(sizes)
    return totals.withColumn("total_size", F.col("total_size").cast("string"))


@query("schema_list", f"WITH {b.TABLE_CATALOG} SELECT DISTINCT server_id, table_schema FROM catalog")
def schema_list(t: Tables):
    return rollups.schema_list(b.table_catalog(t))


@query("table_count", f"WITH {b.TABLE_CATALOG} SELECT server_id, count(*) AS tables FROM catalog GROUP BY server_id")
def table_count(t: Tables):
    return rollups.row_count(b.table_catalog(t), "tables")


@query("digest_count", f"WITH {b.DIGEST_SUMMARY} SELECT server_id, count(*) AS statements FROM digests GROUP BY server_id")
def digest_count(t: Tables):
    return rollups.row_count(b.digest_summary(t), "statements")


DEVICES = """
devices AS (
  SELECT l_suppkey % 10 AS server_id, l_orderkey AS snapshot_id,
    CASE l_linestatus WHEN 'O' THEN 'local' ELSE 'aws/rds' END AS provider,
    'disk' || CAST(l_partkey % 3 AS VARCHAR) AS device, '/m' || CAST(l_linenumber AS VARCHAR) AS mount,
    CAST(l_quantity AS BIGINT) AS reads, CAST(floor(l_extendedprice) AS BIGINT) AS writes FROM lineitem)"""


@query("iops_total", f"""WITH {DEVICES}, once AS (
  SELECT server_id, snapshot_id, min(reads) AS reads, min(writes) AS writes FROM devices WHERE provider = 'local' GROUP BY server_id, snapshot_id, device
  UNION ALL SELECT server_id, snapshot_id, reads, writes FROM devices WHERE provider <> 'local')
SELECT server_id, snapshot_id, CAST(sum(reads) AS BIGINT) AS iop_read, CAST(sum(writes) AS BIGINT) AS iop_write
FROM once GROUP BY server_id, snapshot_id""")
def iops_total(t: Tables):
    devices = t.lineitem.select(
        (F.col("l_suppkey") % 10).alias("server_id"), F.col("l_orderkey").alias("snapshot_id"),
        F.when(F.col("l_linestatus") == "O", "local").otherwise("aws/rds").alias("provider"),
        F.concat(F.lit("disk"), (F.col("l_partkey") % 3).cast("string")).alias("device"),
        F.concat(F.lit("/m"), F.col("l_linenumber").cast("string")).alias("mount"),
        F.col("l_quantity").cast("bigint").alias("reads"), F.floor("l_extendedprice").alias("writes"))
    return rollups.iops_total(devices, ["server_id", "snapshot_id"])


BUDGET = 100_000


@query("text_budget", f"""WITH processes AS (
  SELECT doc_id % 10 AS server_id, doc_id, coalesce(CASE WHEN doc_id % 19 <> 0 THEN text END, 'NULL') AS info,
    strlen(coalesce(CASE WHEN doc_id % 19 <> 0 THEN text END, 'NULL')) AS size FROM documents),
limits AS (SELECT unnest([65536, 32768, 16384, 8192, 4096, 2048, 1024, 512, 256, 128, 64]) AS byte_limit),
fits AS (
  SELECT server_id, byte_limit FROM processes, limits GROUP BY server_id, byte_limit HAVING sum(least(size, byte_limit)) <= {BUDGET}),
chosen AS (
  SELECT server_id, CASE WHEN sum(size) <= {BUDGET} THEN NULL
    ELSE coalesce((SELECT max(f.byte_limit) FROM fits f WHERE f.server_id = p.server_id), 64) END AS byte_limit
  FROM processes p GROUP BY server_id)
SELECT p.server_id, p.doc_id, c.byte_limit, least(p.size, coalesce(c.byte_limit, p.size)) AS bytes,
  substr(lower(hex(encode(p.info))), 1, CAST(2 * least(p.size, coalesce(c.byte_limit, p.size)) AS BIGINT)) AS info_hex
FROM processes p JOIN chosen c ON c.server_id = p.server_id""")
def text_budget(t: Tables):
    processes = t.documents.select(
        (F.col("doc_id") % 10).alias("server_id"), "doc_id", F.when(F.col("doc_id") % 19 != 0, F.col("text")).alias("info"))
    cut = rollups.text_budget(processes, ["server_id"], budget=BUDGET)
    return cut.select("server_id", "doc_id", "byte_limit", F.octet_length("info_bytes").cast("bigint").alias("bytes"),
                      F.lower(F.hex("info_bytes")).alias("info_hex"))


@query("section_failures", """WITH failures AS (
  SELECT o_custkey % 50 AS server_id, 'db' || CAST(o_custkey % 7 AS VARCHAR) AS database,
    CASE WHEN o_orderkey % 5 = 0 THEN '__database_connection__' ELSE 'section_' || lower(substr(o_orderpriority, 3)) END AS section,
    o_orderkey AS ordinal FROM orders),
named AS (
  SELECT server_id, CASE WHEN section = '__database_connection__' THEN database || ':' || section ELSE section END AS section, ordinal
  FROM failures),
first AS (SELECT server_id, section, min(ordinal) AS ordinal FROM named GROUP BY server_id, section)
SELECT server_id, string_agg(section, '|' ORDER BY ordinal, section) AS failed_sections FROM first GROUP BY server_id""")
def section_failures(t: Tables):
    failures = t.orders.select(
        (F.col("o_custkey") % 50).alias("server_id"),
        F.concat(F.lit("db"), (F.col("o_custkey") % 7).cast("string")).alias("database"),
        F.when(F.col("o_orderkey") % 5 == 0, rollups.CONNECTION_SECTION)
        .otherwise(F.concat(F.lit("section_"), F.lower(F.expr("substr(o_orderpriority, 3)")))).alias("section"),
        F.col("o_orderkey").alias("ordinal"))
    return rollups.section_failures(failures).withColumn("failed_sections", F.array_join("failed_sections", "|"))


@query("consumer_strategy", """WITH consumers AS (
  SELECT user_id AS server_id, CASE event_type WHEN 'view' THEN 'events_statements_current' WHEN 'click' THEN 'events_statements_history'
      WHEN 'error' THEN 'events_statements_cpu' WHEN 'purchase' THEN 'events_waits_current' ELSE 'thread_instrumentation' END AS name,
    CASE WHEN max(value) > 100 THEN 'YES' ELSE 'NO' END AS enabled
  FROM events GROUP BY user_id, event_type),
counted AS (
  SELECT server_id, count(*) FILTER (WHERE enabled = 'YES' AND name LIKE 'events_statements_%' AND name <> 'events_statements_cpu')
    AS enabled_consumers FROM consumers GROUP BY server_id)
SELECT server_id, enabled_consumers, CASE WHEN enabled_consumers >= 2 THEN 10 WHEN enabled_consumers > 0 THEN 1 ELSE 600 END AS period_seconds
FROM counted""")
def consumer_strategy(t: Tables):
    names = F.create_map(*[F.lit(x) for x in ("view", "events_statements_current", "click", "events_statements_history", "error",
                                              "events_statements_cpu", "purchase", "events_waits_current", "signup",
                                              "thread_instrumentation")])
    consumers = t.events.groupBy(F.col("user_id").alias("server_id"), names[F.col("event_type")].alias("name")).agg(
        F.when(F.max("value") > 100, "YES").otherwise("NO").alias("enabled"))
    return rollups.consumer_strategy(consumers)


STAGES = """
stages AS (
  SELECT l_orderkey AS task_id, l_linenumber AS statement_index,
    CASE l_partkey % 4 WHEN 0 THEN 'validate' WHEN 1 THEN 'preflight' WHEN 2 THEN 'backup' ELSE 'execute' END AS stage,
    CASE l_returnflag WHEN 'A' THEN 'started' WHEN 'N' THEN 'passed' ELSE 'failed' END AS status,
    CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS BIGINT) * 10 END AS duration_ms,
    CAST(epoch(l_shipdate) AS BIGINT) AS logged_at FROM lineitem)"""


def stages(t: Tables):
    names = F.array(*[F.lit(x) for x in ("validate", "preflight", "backup", "execute")])
    return t.lineitem.select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("statement_index"),
        names[(F.col("l_partkey") % 4).cast("int")].alias("stage"),
        F.when(F.col("l_returnflag") == "A", "started").when(F.col("l_returnflag") == "N", "passed").otherwise("failed").alias("status"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity").cast("bigint") * 10).alias("duration_ms"),
        b.seconds("l_shipdate").alias("logged_at"))


@query("stage_durations", f"""WITH {STAGES} SELECT stage, status, count(*) AS stages, CAST(sum(duration_ms) AS BIGINT) AS total_ms,
  max(duration_ms) AS max_ms FROM stages GROUP BY stage, status""")
def stage_durations(t: Tables):
    return rollups.stage_durations(stages(t))


@query("last_stage", f"""WITH {STAGES} SELECT task_id, statement_index, stage, status FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id, statement_index ORDER BY logged_at DESC, stage DESC, status DESC) AS n FROM stages)
WHERE n = 1""")
def last_stage(t: Tables):
    return rollups.last_stage(stages(t))


@query("rls_enabled", """SELECT o_custkey AS server_id,
  coalesce(bool_or(o_orderstatus IN ('F', 'P') AND o_orderpriority <> '1-URGENT' AND o_orderkey % 40 = 0), false) AS rls_enabled
FROM orders GROUP BY o_custkey""")
def rls_enabled(t: Tables):
    classes = t.orders.select(
        F.col("o_custkey").alias("server_id"),
        F.when(F.col("o_orderstatus") == "F", "r").when(F.col("o_orderstatus") == "P", "p").otherwise("v").alias("relkind"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "pg_catalog").otherwise("app").alias("nspname"),
        (F.col("o_orderkey") % 40 == 0).alias("relrowsecurity"))
    return rollups.rls_enabled(classes)


@query("public_privileges", """SELECT c_custkey AS server_id, concat_ws(',', CASE WHEN c_acctbal > 0 THEN 'USAGE' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'CREATE' END) AS privileges FROM customer""")
def public_privileges(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("server_id"), rollups.public_privileges(
        F.col("c_acctbal") > 0, F.col("c_custkey") % 3 == 0).alias("privileges"))


@query("bytes_required", f"""WITH {b.TABLE_CATALOG}, schemas AS (
  SELECT server_id, table_schema, sum(data_length + index_length) AS size FROM catalog GROUP BY ALL),
joined AS (SELECT c.*, coalesce(data_length, 0) + coalesce(index_length, 0) AS table_bytes, s.size
  FROM catalog c JOIN schemas s USING (server_id, table_schema))
SELECT server_id, table_schema, table_name, table_bytes,
  CAST(floor(CASE WHEN table_bytes = 0 THEN 0.1::DOUBLE ELSE table_bytes::DOUBLE * 2.0::DOUBLE / 1048576 END * 1048576) AS BIGINT) AS logical_bytes,
  CAST(floor(CASE WHEN coalesce(size, 0) = 0 THEN 0.1::DOUBLE ELSE size::DOUBLE * 1.2::DOUBLE / 1048576 END * 1048576) AS BIGINT) AS physical_bytes
FROM joined""")
def bytes_required(t: Tables):
    return rollups.bytes_required(b.table_catalog(t)).select(
        "server_id", "table_schema", "table_name", "table_bytes", "logical_bytes", "physical_bytes")


@query("latency_share", f"""WITH {b.STATEMENT_STATS}, times AS (SELECT server_id, CAST(floor(mean_exec_time_us) AS BIGINT) AS us FROM statements),
shares AS (SELECT server_id, us, cume_dist() OVER (PARTITION BY server_id ORDER BY us) AS share FROM times)
SELECT server_id, min(us) AS latency FROM shares WHERE share > 0.95 GROUP BY server_id""")
def latency_share(t: Tables):
    statements = rollups.statement_rollup(b.statement_stats(t), b.databases(t)).select(
        "server_id", F.floor("mean_exec_time_us").alias("us"))
    return rollups.latency_share(statements, "us")
