"""Explicit schemas of everything that is read; nothing is inferred."""

from __future__ import annotations

# Bronze: one report per line. The document stays JSON text.
REPORT = "server_id BIGINT, collected_at TIMESTAMP, report_type STRING, document STRING, _corrupt STRING"

# The parts of a report document that are exploded to rows; each reader parses its own part only.
STATUS = "STRUCT<DB: STRUCT<Metrics: STRUCT<Status: MAP<STRING, STRING>>, Conf: STRUCT<Variables: MAP<STRING, STRING>>>>"
SECTIONS = "STRUCT<DB: STRUCT<DatabaseSchema: MAP<STRING, ARRAY<MAP<STRING, STRING>>>>>"
FAILED_SECTIONS = "STRUCT<DB: STRUCT<FailedDatabaseSchema: ARRAY<STRING>>>"
GRANTS = "STRUCT<DB: STRUCT<Info: STRUCT<Grants: ARRAY<STRING>>>>"
EXTENSIONS = "STRUCT<DB: STRUCT<Info: STRUCT<Extensions: ARRAY<STRUCT<name: STRING, version: STRING, schema: STRING>>>>>"
RULES = """STRUCT<DB: STRUCT<Info: STRUCT<PgHba: ARRAY<STRUCT<
  type: STRING, database: STRING, user_name: STRING, address: STRING, auth_method: STRING, error: STRING>>>>>"""

_DISK = """STRUCT<device: STRING, readIOsPS: DOUBLE, writeIOsPS: DOUBLE, avgQueueLen: DOUBLE, avgReqSz: DOUBLE, await: DOUBLE,
  readKb: BIGINT, readKbPS: DOUBLE, rrqmPS: DOUBLE, tps: DOUBLE, util: DOUBLE, writeKb: BIGINT, writeKbPS: DOUBLE, wrqmPS: DOUBLE,
  diskQueueDepth: DOUBLE, readLatency: DOUBLE, readThroughput: DOUBLE, writeLatency: DOUBLE, writeThroughput: DOUBLE>"""

# Host metrics document of the provider that sends JSON.
HOST = f"""STRUCT<
  engine: STRING, instanceID: STRING, instanceResourceID: STRING, numVCPUs: BIGINT, timestamp: STRING, uptime: STRING, version: DOUBLE,
  serverlessDatabaseCapacity: DOUBLE,
  cpuUtilization: STRUCT<guest: DOUBLE, idle: DOUBLE, irq: DOUBLE, nice: DOUBLE, steal: DOUBLE, system: DOUBLE, total: DOUBLE, user: DOUBLE, wait: DOUBLE>,
  diskIO: ARRAY<{_DISK}>, physicalDeviceIO: ARRAY<{_DISK}>,
  fileSys: ARRAY<STRUCT<maxFiles: BIGINT, mountPoint: STRING, name: STRING, total: BIGINT, used: BIGINT, usedFilePercent: DOUBLE, usedFiles: BIGINT, usedPercent: DOUBLE>>,
  loadAverageMinute: STRUCT<fifteen: DOUBLE, five: DOUBLE, one: DOUBLE>,
  memory: STRUCT<active: BIGINT, buffers: BIGINT, cached: BIGINT, dirty: BIGINT, free: BIGINT, hugePagesFree: BIGINT, hugePagesRsvd: BIGINT,
    hugePagesSize: BIGINT, hugePagesSurp: BIGINT, hugePagesTotal: BIGINT, inactive: BIGINT, mapped: BIGINT, pageTables: BIGINT, slab: BIGINT,
    total: BIGINT, writeback: BIGINT>,
  network: ARRAY<STRUCT<interface: STRING, rx: DOUBLE, tx: DOUBLE>>,
  processList: ARRAY<STRUCT<cpuUsedPc: DOUBLE, id: BIGINT, memoryUsedPc: DOUBLE, name: STRING, parentID: BIGINT, rss: BIGINT, tgid: BIGINT, vss: BIGINT>>,
  swap: STRUCT<cached: DOUBLE, free: DOUBLE, total: DOUBLE, in: DOUBLE, out: DOUBLE>,
  tasks: STRUCT<blocked: BIGINT, running: BIGINT, sleeping: BIGINT, stopped: BIGINT, total: BIGINT, zombie: BIGINT>,
  _corrupt: STRING>"""

TASK = """STRUCT<task_id: INT, task_type_id: INT, task_details: STRING, task_status: INT, task_output: STRING, task_error: STRING,
  task_exit_code: INT, _corrupt: STRING>"""

# Structured log events: the common part and the fields of each kind.
EVENT = """STRUCT<event: STRING, scope: STRING, `group`: STRING, batch: INT, names: ARRAY<STRING>, outcome: STRING, error: STRING,
  source: STRING, metadata: MAP<STRING, STRING>, modified_scopes: MAP<STRING, STRING>, scope_outcomes: MAP<STRING, STRING>, _corrupt: STRING>"""

# Columns of the catalogue sections.
SECTION_COLUMNS = {
    "information_schema_tables": [
        "TABLE_SCHEMA", "TABLE_NAME", "TABLE_TYPE", "ENGINE", "ROW_FORMAT", "TABLE_ROWS", "AVG_ROW_LENGTH", "MAX_DATA_LENGTH", "DATA_LENGTH",
        "INDEX_LENGTH", "TABLE_COLLATION", "DATA_FREE", "AUTO_INCREMENT"],
    "information_schema_columns": [
        "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION", "COLUMN_DEFAULT", "IS_NULLABLE", "DATA_TYPE", "CHARACTER_MAXIMUM_LENGTH",
        "NUMERIC_PRECISION", "NUMERIC_SCALE", "CHARACTER_SET_NAME", "COLLATION_NAME", "COLUMN_TYPE", "COLUMN_KEY", "EXTRA", "GENERATION_EXPRESSION"],
    "information_schema_indexes": [
        "TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME", "NON_UNIQUE", "SEQ_IN_INDEX", "COLUMN_NAME", "COLLATION", "CARDINALITY", "SUB_PART", "PACKED",
        "NULLABLE", "INDEX_TYPE", "EXPRESSION", "IS_VISIBLE"],
    "information_schema_referential_constraints": [
        "CONSTRAINT_SCHEMA", "CONSTRAINT_NAME", "UNIQUE_CONSTRAINT_SCHEMA", "UNIQUE_CONSTRAINT_NAME", "MATCH_OPTION", "UPDATE_RULE", "DELETE_RULE",
        "TABLE_NAME", "REFERENCED_TABLE_NAME"],
    "information_schema_key_column_usage": [
        "CONSTRAINT_SCHEMA", "CONSTRAINT_NAME", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION", "POSITION_IN_UNIQUE_CONSTRAINT",
        "REFERENCED_TABLE_SCHEMA", "REFERENCED_TABLE_NAME", "REFERENCED_COLUMN_NAME"],
    "information_schema_table_constraints": ["CONSTRAINT_SCHEMA", "CONSTRAINT_NAME", "TABLE_SCHEMA", "TABLE_NAME", "CONSTRAINT_TYPE"],
    "information_schema_triggers": ["TRIGGER_SCHEMA", "TRIGGER_NAME", "EVENT_MANIPULATION", "EVENT_OBJECT_SCHEMA", "EVENT_OBJECT_TABLE"],
    "performance_schema_table_io_waits_summary_by_index_usage": [
        "OBJECT_TYPE", "OBJECT_SCHEMA", "OBJECT_NAME", "INDEX_NAME", "COUNT_STAR", "SUM_TIMER_WAIT", "MIN_TIMER_WAIT", "AVG_TIMER_WAIT", "MAX_TIMER_WAIT",
        "COUNT_READ", "SUM_TIMER_READ", "MIN_TIMER_READ", "AVG_TIMER_READ", "MAX_TIMER_READ",
        "COUNT_WRITE", "SUM_TIMER_WRITE", "MIN_TIMER_WRITE", "AVG_TIMER_WRITE", "MAX_TIMER_WRITE",
        "COUNT_FETCH", "SUM_TIMER_FETCH", "MIN_TIMER_FETCH", "AVG_TIMER_FETCH", "MAX_TIMER_FETCH",
        "COUNT_INSERT", "SUM_TIMER_INSERT", "MIN_TIMER_INSERT", "AVG_TIMER_INSERT", "MAX_TIMER_INSERT",
        "COUNT_UPDATE", "SUM_TIMER_UPDATE", "MIN_TIMER_UPDATE", "AVG_TIMER_UPDATE", "MAX_TIMER_UPDATE",
        "COUNT_DELETE", "SUM_TIMER_DELETE", "MIN_TIMER_DELETE", "AVG_TIMER_DELETE", "MAX_TIMER_DELETE"],
}
SERVER_VIEWS = ["pg_stat_archiver", "pg_stat_bgwriter", "pg_stat_database", "pg_stat_database_conflicts", "pg_stat_checkpointer"]
DATABASE_VIEWS = ["pg_stat_user_tables", "pg_statio_user_tables", "pg_stat_user_indexes", "pg_statio_user_indexes"]
