"""The telemetry tables as they are derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Tables


def seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            column.cast("timestamp_ntz"))


def text(*names: str) -> list[Column]:
    """The named columns as text, for exact comparison of wide numbers."""
    return [F.col(n).cast("string").alias(n) for n in names]


def sql_list(values) -> str:
    """Texts as a list literal in SQL."""
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def statement_stats(t: Tables) -> DataFrame:
    """Statement statistics with times in whole milliseconds; some rows have no query id."""
    part = F.col("l_partkey")
    return t.lineitem.select(
        (F.col("l_suppkey") % 10).alias("server_id"),
        F.col("l_suppkey").cast("string").alias("dbid"),
        F.when(F.col("l_orderkey") % 97 != 0, F.when(F.col("l_linenumber") % 2 == 0, -part).otherwise(part))
        .cast("string").alias("queryid"),
        F.when(F.col("l_returnflag") != "A", F.col("l_linestatus") == "O").alias("toplevel"),
        F.concat(F.when(F.col("l_linenumber") == 3, "update t set a = $1 -- ").otherwise("select * from t"),
                 (part % 64).cast("string"), F.lit(" "), F.col("l_returnflag")).alias("query"),
        F.col("l_quantity").cast("bigint").alias("calls"),
        F.floor("l_extendedprice").alias("total_exec_time"),
        (F.col("l_orderkey") % 1000).alias("rows"),
    )


STATEMENT_STATS = """
stats AS (
  SELECT l_suppkey % 10 AS server_id, CAST(l_suppkey AS VARCHAR) AS dbid,
    CASE WHEN l_orderkey % 97 <> 0 THEN CAST(CASE WHEN l_linenumber % 2 = 0 THEN -l_partkey ELSE l_partkey END AS VARCHAR) END
      AS queryid,
    CASE WHEN l_returnflag <> 'A' THEN l_linestatus = 'O' END AS toplevel,
    (CASE WHEN l_linenumber = 3 THEN 'update t set a = $1 -- ' ELSE 'select * from t' END)
      || CAST(l_partkey % 64 AS VARCHAR) || ' ' || l_returnflag AS query,
    CAST(l_quantity AS BIGINT) AS calls, CAST(floor(l_extendedprice) AS BIGINT) AS total_exec_time,
    l_orderkey % 1000 AS rows
  FROM lineitem),
databases AS (
  SELECT s_suppkey % 10 AS server_id, CAST(CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey ELSE -1 - s_suppkey END AS VARCHAR) AS oid, s_name AS datname
  FROM supplier),
unsigned AS (
  SELECT *, CAST(CASE WHEN CAST(queryid AS HUGEINT) < 0 THEN CAST(queryid AS HUGEINT) + 18446744073709551616
                      ELSE CAST(queryid AS HUGEINT) END AS VARCHAR) AS unsigned_id FROM stats),
rollup_rows AS (
  SELECT s.server_id, s.dbid, coalesce(d.datname, 'NULL') AS datname, s.queryid AS pg_queryid, s.unsigned_id, s.toplevel,
    min(s.query) AS query, CAST(sum(s.calls) AS BIGINT) AS calls,
    CAST(sum(s.total_exec_time) AS DOUBLE) * 1000.0 AS total_exec_time_us,
    coalesce(CAST(sum(s.total_exec_time) AS DOUBLE) / nullif(CAST(sum(s.calls) AS DOUBLE), 0.0), 0.0) * 1000.0
      AS mean_exec_time_us,
    CAST(sum(s.rows) AS BIGINT) AS rows
  FROM unsigned s LEFT JOIN databases d ON d.server_id = s.server_id AND d.oid = s.dbid
  WHERE s.queryid IS NOT NULL
  GROUP BY s.server_id, s.dbid, d.datname, s.queryid, s.unsigned_id, s.toplevel),
statements AS (
  SELECT *, CAST(CAST('0x' || substr(sha256('pgss:v1:' || dbid || ':' || unsigned_id || ':' ||
      coalesce(CAST(toplevel AS VARCHAR), 'unknown')), 1, 16) AS UBIGINT) AS VARCHAR) AS queryid
  FROM rollup_rows)"""


def databases(t: Tables) -> DataFrame:
    """Database names; some statements have none."""
    key = F.col("s_suppkey")
    return t.supplier.select(
        (key % 10).alias("server_id"),
        F.when(key % 7 != 0, key).otherwise(-1 - key).cast("string").alias("oid"),
        F.col("s_name").alias("datname"),
    )


def digest_summary(t: Tables) -> DataFrame:
    """Statement digests, one row per source row; some names are missing."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    counters = {name: (F.col("l_orderkey") + i) % (i + 11) for i, name in enumerate(COUNTERS)}
    return t.lineitem.select(
        (F.col("l_suppkey") % 10).alias("server_id"),
        F.when(line != 7, F.concat(F.lit("db"), F.year("l_shipdate").cast("string"))).alias("schema_name"),
        F.when(part % 13 != 0, F.md5(part.cast("string"))).alias("digest"),
        F.concat(F.lit("select "), part.cast("string")).alias("digest_text"),
        F.when(line != 5, F.concat(F.lit("select "), part.cast("string"), F.lit(" /* "), F.col("l_returnflag"),
                                   F.lit(" */"))).alias("query_sample_text"),
        F.col("l_quantity").cast("bigint").alias("count_star"),
        F.col("l_orderkey").alias("snapshot_id"),
        line.cast("bigint").alias("line"),
        (F.floor("l_extendedprice") * 123456789).alias("sum_timer_wait"),
        (F.floor("l_extendedprice") * 12345).alias("avg_timer_wait"),
        *[c.alias(n) for n, c in counters.items()],
        F.col("l_shipdate").alias("first_seen"),
        (F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS")).alias("last_seen"),
    )


# The counters of the full statement digest.
COUNTERS = [
    "SUM_LOCK_TIME", "SUM_ERRORS", "SUM_WARNINGS", "SUM_ROWS_AFFECTED", "SUM_ROWS_SENT", "SUM_ROWS_EXAMINED",
    "SUM_CREATED_TMP_DISK_TABLES", "SUM_CREATED_TMP_TABLES", "SUM_SELECT_FULL_JOIN", "SUM_SELECT_FULL_RANGE_JOIN",
    "SUM_SELECT_RANGE", "SUM_SELECT_RANGE_CHECK", "SUM_SELECT_SCAN", "SUM_SORT_MERGE_PASSES", "SUM_SORT_RANGE",
    "SUM_SORT_ROWS", "SUM_SORT_SCAN", "SUM_NO_INDEX_USED", "SUM_NO_GOOD_INDEX_USED",
]

DIGEST_SUMMARY = """
digests AS (
  SELECT l_suppkey % 10 AS server_id,
    CASE WHEN l_linenumber <> 7 THEN 'db' || CAST(year(l_shipdate) AS VARCHAR) END AS schema_name,
    CASE WHEN l_partkey % 13 <> 0 THEN md5(CAST(l_partkey AS VARCHAR)) END AS digest,
    'select ' || CAST(l_partkey AS VARCHAR) AS digest_text,
    CASE WHEN l_linenumber <> 5 THEN 'select ' || CAST(l_partkey AS VARCHAR) || ' /* ' || l_returnflag || ' */' END
      AS query_sample_text,
    CAST(l_quantity AS BIGINT) AS count_star, l_orderkey AS snapshot_id, CAST(l_linenumber AS BIGINT) AS line,
    CAST(floor(l_extendedprice) AS BIGINT) * 123456789 AS sum_timer_wait,
    CAST(floor(l_extendedprice) AS BIGINT) * 12345 AS avg_timer_wait,
    """ + ",\n    ".join(f"(l_orderkey + {i}) % {i + 11} AS {name}" for i, name in enumerate(COUNTERS)) + """,
    l_shipdate AS first_seen, l_shipdate + INTERVAL 3 DAY AS last_seen
  FROM lineitem)"""


def statement_events(t: Tables) -> DataFrame:
    """Statement events with their text."""
    return t.events.select(
        (F.col("user_id") % 10).alias("server_id"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("db"), (F.col("user_id") % 20).cast("string"))).alias("schema_name"),
        F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("digest"),
        micros("ts").alias("timer_start"),
        F.col("event_id"),
        F.col("props").alias("sql_text"),
    )


STATEMENT_EVENTS = """
statement_events AS (
  SELECT user_id % 10 AS server_id, CASE WHEN event_id % 11 <> 0 THEN 'db' || CAST(user_id % 20 AS VARCHAR) END AS schema_name,
    CASE WHEN event_id % 17 <> 0 THEN event_type END AS digest, epoch_us(ts) AS timer_start, event_id, props AS sql_text
  FROM events)"""


def table_catalog(t: Tables) -> DataFrame:
    """Tables with engine and sizes; some engines and sizes are missing."""
    key = F.col("p_partkey")
    return t.part.select(
        (key % 10).alias("server_id"),
        F.col("p_brand").alias("table_schema"),
        F.concat(F.lit("t"), key.cast("string")).alias("table_name"),
        F.when(key % 5 == 0, "VIEW").otherwise("BASE TABLE").alias("table_type"),
        F.when(key % 9 != 0, F.col("p_type")).alias("engine"),
        F.when(key % 11 != 0, F.col("p_size").cast("bigint") * 4096).alias("data_length"),
        F.when(key % 12 != 0, F.floor("p_retailprice") * 1024).alias("index_length"),
    )


TABLE_CATALOG = """
catalog AS (
  SELECT p_partkey % 10 AS server_id, p_brand AS table_schema, 't' || CAST(p_partkey AS VARCHAR) AS table_name,
    CASE WHEN p_partkey % 5 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
    CASE WHEN p_partkey % 9 <> 0 THEN p_type END AS engine,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS BIGINT) * 4096 END AS data_length,
    CASE WHEN p_partkey % 12 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) * 1024 END AS index_length
  FROM part)"""
