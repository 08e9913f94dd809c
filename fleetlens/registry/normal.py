"""Queries of the normalisers and of error classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as c
from ..functions import maps
from ..functions import normalize as n
from ..operators import catalog
from . import bindings as b
from .base import Tables, query


@query("null_marker", f"""WITH {b.STATEMENT_EVENTS}
SELECT event_id, coalesce(schema_name, 'NULL') AS schema_marker, coalesce(digest, 'NULL') AS digest_marker,
  CASE WHEN coalesce(digest, 'NULL') NOT IN ('', 'NULL') THEN digest END AS digest_value,
  nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE sql_text END, '') AS text_value FROM statement_events""")
def null_marker(t: Tables):
    events = b.statement_events(t)
    marker = n.null_marker(F.col("digest"))
    return events.select(
        "event_id", n.null_marker(F.col("schema_name")).alias("schema_marker"), marker.alias("digest_marker"),
        n.from_null_marker(marker).alias("digest_value"),
        n.from_null_marker(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("sql_text"))).alias("text_value"))


@query("server_version", """WITH v AS (SELECT o_orderkey AS server_id,
  '8.' || CAST(o_custkey % 5 AS VARCHAR) || '.' || CAST(o_orderkey % 40 AS VARCHAR) ||
    CASE o_orderstatus WHEN 'F' THEN '-log' WHEN 'P' THEN '-0ubuntu-mariadb' ELSE '' END AS mysql,
  'PostgreSQL ' || CAST(9 + o_orderkey % 9 AS VARCHAR) || '.' || CAST(o_custkey % 20 AS VARCHAR) ||
    CASE WHEN o_orderkey % 2 = 0 THEN '.1' ELSE '' END || ' (Debian 1.2) on x86' AS postgres FROM orders)
SELECT server_id, CASE WHEN contains(mysql, '-') THEN regexp_extract(mysql, '^([^-]*)-', 1) ELSE mysql END AS mysql_version,
  split_part(split_part(postgres, ' ', 2), '.', 1) || '.' || split_part(split_part(postgres, ' ', 2), '.', 2) AS postgres_version
FROM v""")
def server_version(t: Tables):
    key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    mysql = F.concat(F.lit("8."), (cust % 5).cast("string"), F.lit("."), (key % 40).cast("string"),
                     F.when(status == "F", "-log").when(status == "P", "-0ubuntu-mariadb").otherwise(""))
    postgres = F.concat(F.lit("PostgreSQL "), (9 + key % 9).cast("string"), F.lit("."), (cust % 20).cast("string"),
                        F.when(key % 2 == 0, ".1").otherwise(""), F.lit(" (Debian 1.2) on x86"))
    return t.orders.select(key.alias("server_id"), n.mysql_version(mysql).alias("mysql_version"),
                           n.postgres_version(postgres).alias("postgres_version"))


SIZE_TEXT = """CASE event_id % 12 WHEN 0 THEN '  ' || CAST(event_id AS VARCHAR) || ' ' WHEN 1 THEN CAST(value AS VARCHAR)
  WHEN 2 THEN '-' || CAST(value AS VARCHAR) WHEN 3 THEN 'NaN' WHEN 4 THEN '+Inf' WHEN 5 THEN 'twelve' WHEN 6 THEN NULL
  WHEN 7 THEN '18446744073709551615' WHEN 8 THEN '99999999999999999999' || CAST(event_id AS VARCHAR)
  WHEN 9 THEN CAST(event_id AS VARCHAR) || 'e3' WHEN 10 THEN '000' || CAST(event_id AS VARCHAR) || '.75' ELSE '1e30' END"""


@query("to_size", f"""WITH m AS (SELECT event_id, trim({SIZE_TEXT}) AS x FROM events),
d AS (SELECT *, TRY_CAST(x AS DOUBLE) AS f FROM m)
SELECT event_id, CASE WHEN regexp_full_match(x, '[0-9]+') THEN
    CASE WHEN length(x) > 20 THEN '18446744073709551615' ELSE CAST(CAST(x AS HUGEINT) AS VARCHAR) END
  WHEN f IS NULL OR isnan(f) OR f <= 0 THEN '0' WHEN f >= 18446744073709551615 THEN '18446744073709551615'
  ELSE CAST(CAST(trunc(f) AS HUGEINT) AS VARCHAR) END AS size FROM d""")
def to_size(t: Tables):
    event, value = F.col("event_id"), F.col("value").cast("string")
    text = event.cast("string")
    metric = (F.when(event % 12 == 0, F.concat(F.lit("  "), text, F.lit(" "))).when(event % 12 == 1, value)
              .when(event % 12 == 2, F.concat(F.lit("-"), value)).when(event % 12 == 3, "NaN").when(event % 12 == 4, "+Inf")
              .when(event % 12 == 5, "twelve").when(event % 12 == 6, None).when(event % 12 == 7, "18446744073709551615")
              .when(event % 12 == 8, F.concat(F.lit("99999999999999999999"), text)).when(event % 12 == 9, F.concat(text, F.lit("e3")))
              .when(event % 12 == 10, F.concat(F.lit("000"), text, F.lit(".75"))).otherwise("1e30"))
    return t.events.select("event_id", n.to_size(metric).cast("string").alias("size"))


@query("effective_ram", """SELECT o_orderkey AS server_id, CAST(CASE WHEN o_orderkey % 3 = 0
  THEN least(CAST(floor(o_totalprice) AS HUGEINT) * 1000000000000 * 1024, 18446744073709551615::HUGEINT)
  ELSE CAST(floor(o_totalprice) AS HUGEINT) * 1000000000000 END AS VARCHAR) AS ram FROM orders""")
def effective_ram(t: Tables):
    instance = F.when(F.col("o_orderkey") % 3 == 0, "aws/rds").when(F.col("o_orderkey") % 3 == 1, "local").otherwise("gcp/cloudsql")
    total = F.floor("o_totalprice").cast("decimal(20,0)") * F.lit(1000000000000).cast("decimal(13,0)")
    return t.orders.select(F.col("o_orderkey").alias("server_id"), n.effective_ram(instance, total).cast("string").alias("ram"))


QUERY_ID = """CASE l_linenumber WHEN 1 THEN CAST(-l_partkey AS VARCHAR) WHEN 2 THEN CAST(-9223372036854775807 + l_partkey AS VARCHAR)
  WHEN 3 THEN CAST(18446744073709551615 - l_partkey AS VARCHAR) WHEN 4 THEN ' ' || CAST(l_partkey AS VARCHAR) || ' '
  WHEN 5 THEN 'q' || CAST(l_partkey AS VARCHAR) WHEN 6 THEN '' ELSE '99999999999999999999' END"""


def _query_id():
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    text = part.cast("string")
    return (F.when(line == 1, (-part).cast("string")).when(line == 2, (F.lit(-9223372036854775807) + part).cast("string"))
            .when(line == 3, (F.lit("18446744073709551615").cast("decimal(20,0)") - part).cast("decimal(20,0)").cast("string"))
            .when(line == 4, F.concat(F.lit(" "), text, F.lit(" "))).when(line == 5, F.concat(F.lit("q"), text)).when(line == 6, "")
            .otherwise("99999999999999999999"))


UNSIGNED_ID = """CASE WHEN number BETWEEN -9223372036854775808 AND 18446744073709551615
  THEN CAST(CASE WHEN number < 0 THEN number + 18446744073709551616 ELSE number END AS VARCHAR) ELSE query_id END"""


@query("normalize_query_id", f"""WITH ids AS (SELECT DISTINCT {QUERY_ID} AS query_id FROM lineitem),
numbers AS (SELECT *, TRY_CAST(nullif(trim(query_id), '') AS HUGEINT) AS number FROM ids)
SELECT query_id, {UNSIGNED_ID} AS unsigned_id FROM numbers""")
def normalize_query_id(t: Tables):
    ids = t.lineitem.select(_query_id().alias("query_id")).distinct()
    return ids.withColumn("unsigned_id", n.normalize_query_id(F.col("query_id")))


@query("statement_identity", f"""WITH ids AS (SELECT DISTINCT {QUERY_ID} AS query_id, CAST(l_suppkey AS VARCHAR) AS dbid,
  CASE WHEN l_returnflag <> 'A' THEN l_linestatus = 'O' END AS toplevel FROM lineitem),
numbers AS (SELECT *, TRY_CAST(nullif(trim(query_id), '') AS HUGEINT) AS number FROM ids)
SELECT dbid, query_id, toplevel, CAST(CAST('0x' || substr(sha256('pgss:v1:' || dbid || ':' || {UNSIGNED_ID} || ':' ||
  coalesce(CAST(toplevel AS VARCHAR), 'unknown')), 1, 16) AS UBIGINT) AS VARCHAR) AS identity FROM numbers""")
def statement_identity(t: Tables):
    ids = t.lineitem.select(_query_id().alias("query_id"), F.col("l_suppkey").cast("string").alias("dbid"),
                            F.when(F.col("l_returnflag") != "A", F.col("l_linestatus") == "O").alias("toplevel")).distinct()
    return ids.withColumn("identity", n.statement_identity(F.col("dbid"), F.col("query_id"), F.col("toplevel")))


@query("digest_key", f"""WITH {b.DIGEST_SUMMARY} SELECT coalesce(schema_name, 'NULL') AS schema_name, coalesce(digest, 'NULL') AS query_id,
  count(*) AS statements FROM digests GROUP BY ALL""")
def digest_key(t: Tables):
    """Schema and digest stay two columns; joined text would mix up some keys."""
    keys = b.digest_summary(t).select(n.null_marker(F.col("schema_name")).alias("schema_name"), n.null_marker(F.col("digest")).alias("query_id"))
    return keys.groupBy("schema_name", "query_id").agg(F.count(F.lit(1)).alias("statements"))


STATUS = """
status AS (SELECT user_id AS server_id, CASE WHEN event_id % 2 = 0 THEN 'session' ELSE 'global' END AS scope, event_type AS name,
  arg_max(CAST(value AS VARCHAR), event_id) AS value FROM events GROUP BY ALL)"""


def status_rows(t: Tables):
    return t.events.groupBy(F.col("user_id").alias("server_id"),
                            F.when(F.col("event_id") % 2 == 0, "session").otherwise("global").alias("scope"),
                            F.col("event_type").alias("name")).agg(F.max_by(F.col("value").cast("string"), "event_id").alias("value"))


@query("uptime", f"""WITH {STATUS}, u AS (SELECT server_id, max(value) FILTER (WHERE name = 'signup' AND server_id % 7 <> 0) AS value
  FROM status GROUP BY server_id) SELECT server_id, coalesce(value, '0') AS uptime FROM u""")
def uptime(t: Tables):
    value = F.max(F.when((F.col("name") == "signup") & (F.col("server_id") % 7 != 0), F.col("value")))
    return status_rows(t).groupBy("server_id").agg(n.uptime(value).alias("uptime"))


@query("overlay_rows", f"""WITH {STATUS} SELECT server_id, name, arg_max(value, CASE scope WHEN 'global' THEN 1 ELSE 0 END) AS value
FROM status GROUP BY server_id, name""")
def overlay_rows(t: Tables):
    rows = status_rows(t).withColumn("priority", (F.col("scope") == "global").cast("int"))
    return maps.overlay_rows(rows, ["server_id", "name"], "value", "priority")


@query("overlay_maps", """WITH pairs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  'k' || CAST(l_partkey % 3 AS VARCHAR) AS a, 'k' || CAST(l_suppkey % 3 AS VARCHAR) AS c FROM lineitem)
SELECT name, value, count(*) AS rows FROM (
  SELECT a AS name, CAST(l_partkey AS VARCHAR) AS value FROM pairs WHERE a <> c
  UNION ALL SELECT c AS name, CAST(l_suppkey AS VARCHAR) AS value FROM pairs
  UNION ALL SELECT 'uptime' AS name, CAST(l_linenumber AS VARCHAR) AS value FROM pairs) GROUP BY name, value""")
def overlay_maps(t: Tables):
    def key(column):
        return F.concat(F.lit("k"), (F.col(column) % 3).cast("string"))
    left = F.create_map(key("l_partkey"), F.col("l_partkey").cast("string"), F.lit("uptime"), F.col("l_linenumber").cast("string"))
    right = F.create_map(key("l_suppkey"), F.col("l_suppkey").cast("string"))
    rows = t.lineitem.select(F.explode(maps.overlay_maps(left, right)).alias("name", "value"))
    return rows.groupBy("name", "value").agg(F.count(F.lit(1)).alias("rows"))


@query("merge_json", """WITH j AS (SELECT event_id, event_id % 7 AS kind, CAST(user_id AS VARCHAR) AS u, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id,
  CASE kind WHEN 0 THEN '{"a":' || u || ',"b":"y","k":' || k || '}' WHEN 1 THEN '[' || k || ',{"b":1},' || u || ']'
    WHEN 2 THEN '[{"a":' || u || ',"b":"y","k":' || k || '},7,{"a":' || u || ',"b":"y"}]' WHEN 3 THEN '[{"k":' || k || '},"x"]'
    WHEN 4 THEN '{"k": ' || k || '}' WHEN 5 THEN '{"a": ' || u || ', "b": "y"}' ELSE NULL END AS merged,
  CASE kind WHEN 0 THEN '{"k":' || k || ',"r":{"a":' || u || ',"b":"y"}}' END AS nested FROM j""")
def merge_json(t: Tables):
    kind, user = F.col("event_id") % 7, F.col("user_id").cast("string")
    k = F.get_json_object("props", "$.k")
    pair = F.concat(F.lit('{"a": '), user, F.lit(', "b": "y"}'))
    left = (F.when(kind == 1, F.concat(F.lit("["), k, F.lit("]")))
            .when(kind == 2, F.concat(F.lit('[{"b": "x", "k": '), k, F.lit('}, 7, {"b": "x"}]')))
            .when(kind == 5, "").when(kind == 6, "{broken").otherwise(F.col("props")))
    right = (F.when(kind == 1, F.concat(F.lit('[{"b": 1}, '), user, F.lit("]"))).when(kind == 3, '"x"').when(kind == 4, "").otherwise(pair))
    rows = t.events.select("event_id", kind.alias("kind"), left.alias("l"), right.alias("r"))
    return rows.select("event_id", maps.merge_json(F.col("l"), F.col("r")).alias("merged"),
                       F.when(F.col("kind") == 0, maps.merge_json(F.col("l"), F.col("r"), "r")).alias("nested"))


PARAMETER = """CASE l_partkey % 6 WHEN 0 THEN 'innodb_max_dirty_pages_pct' WHEN 1 THEN 'work_mem' WHEN 2 THEN 'shared_buffers'
  WHEN 3 THEN 'wal_buffers' WHEN 4 THEN 'effective_cache_size' ELSE 'max_connections' END"""


def parameters(t: Tables):
    names = F.array(*[F.lit(x) for x in ("innodb_max_dirty_pages_pct", "work_mem", "shared_buffers", "wal_buffers",
                                         "effective_cache_size", "max_connections")])
    cents = F.floor("l_extendedprice")
    value = (F.when(F.col("l_linenumber") == 1, (cents * 8192).cast("string")).when(F.col("l_linenumber") == 2, (cents * 1024).cast("string"))
             .when(F.col("l_linenumber") == 3, F.concat(F.col("l_linenumber").cast("string"), F.lit("."), cents.cast("string")))
             .when(F.col("l_linenumber") == 4, F.concat(F.lit("-"), F.col("l_partkey").cast("string"), F.lit(".5")))
             .when(F.col("l_linenumber") == 5, "default").otherwise(cents.cast("string")))
    return t.lineitem.select(
        F.col("l_orderkey").alias("server_id"), names[(F.col("l_partkey") % 6).cast("int")].alias("name"), value.alias("value"),
        F.when(F.col("l_suppkey") % 2 == 0, "postgresql").otherwise("mysql").alias("database_type")).distinct()


PARAMETERS = f"""
parameters AS (SELECT DISTINCT l_orderkey AS server_id, {PARAMETER} AS name,
  CASE l_linenumber WHEN 1 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) * 8192 AS VARCHAR)
    WHEN 2 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) * 1024 AS VARCHAR)
    WHEN 3 THEN CAST(l_linenumber AS VARCHAR) || '.' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)
    WHEN 4 THEN '-' || CAST(l_partkey AS VARCHAR) || '.5' WHEN 5 THEN 'default' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS value,
  CASE WHEN l_suppkey % 2 = 0 THEN 'postgresql' ELSE 'mysql' END AS database_type FROM lineitem)"""


@query("parameter_value", f"""WITH {PARAMETERS} SELECT server_id, name, value, database_type,
  CASE WHEN name = 'innodb_max_dirty_pages_pct' THEN CAST(CAST(trunc(TRY_CAST(value AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE value END AS canonical
FROM parameters""")
def parameter_value(t: Tables):
    return parameters(t).withColumn("canonical", n.parameter_value(F.col("name"), F.col("value")))


@query("native_units", f"""WITH {PARAMETERS}, divided AS (SELECT *, CASE WHEN database_type = 'postgresql' THEN
    CASE WHEN name = 'work_mem' THEN 1024 WHEN name IN ('shared_buffers', 'wal_buffers', 'effective_cache_size') THEN 8192 END END AS divisor,
  CASE WHEN regexp_full_match(value, '[0-9]+') THEN CAST(value AS HUGEINT) END AS number FROM parameters)
SELECT server_id, name, value, database_type, CASE WHEN divisor IS NULL THEN value
  WHEN number % divisor = 0 THEN CAST(number // divisor AS VARCHAR) END AS native FROM divided""")
def native_units(t: Tables):
    return parameters(t).withColumn("native", n.native_units(F.col("database_type"), F.col("name"), F.col("value")))


@query("values_equal", """WITH pairs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice,
  CASE l_linenumber WHEN 1 THEN ' On' WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0' WHEN 3 THEN 'a' ELSE CAST(l_partkey % 3 AS VARCHAR) END AS a,
  CASE l_linenumber WHEN 1 THEN 'ON ' WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 3 THEN NULL ELSE CAST(l_suppkey % 3 AS VARCHAR) || '.00' END AS c
  FROM lineitem), e AS (SELECT *, trim(coalesce(a, '')) AS x, trim(coalesce(c, '')) AS y FROM pairs)
SELECT l_linenumber, lower(x) = lower(y) OR coalesce(abs(TRY_CAST(nullif(x, '') AS DOUBLE) - TRY_CAST(nullif(y, '') AS DOUBLE)) < 1e-9, false) AS equal, count(*) AS rows
FROM e GROUP BY ALL""")
def values_equal(t: Tables):
    line, whole = F.col("l_linenumber"), F.col("l_quantity").cast("bigint").cast("string")
    a = (F.when(line == 1, " On").when(line == 2, F.concat(whole, F.lit(".0"))).when(line == 3, "a")
         .otherwise((F.col("l_partkey") % 3).cast("string")))
    x = (F.when(line == 1, "ON ").when(line == 2, whole).when(line == 3, None)
         .otherwise(F.concat((F.col("l_suppkey") % 3).cast("string"), F.lit(".00"))))
    return t.lineitem.select("l_linenumber", n.values_equal(a, x).alias("equal")).groupBy("l_linenumber", "equal").agg(
        F.count(F.lit(1)).alias("rows"))


@query("config_text", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'ON' ELSE 'OFF' END WHEN 2 THEN CAST(l_partkey AS VARCHAR) || '.0' WHEN 3 THEN ''
  WHEN 4 THEN CAST(-l_suppkey AS VARCHAR) WHEN 5 THEN CAST(l_partkey AS VARCHAR) || '.25' WHEN 6 THEN CAST(l_suppkey * 1000 AS VARCHAR) ELSE CAST(l_suppkey AS VARCHAR) END AS text FROM lineitem""")
def config_text(t: Tables):
    """Values of JSON documents of every type; those of line 2 are texts, so their digits stay."""
    line, part, supplier = F.col("l_linenumber"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    member = (F.when(line == 1, F.when(F.col("l_partkey") % 2 == 0, "true").otherwise("false")).when(line == 2, F.concat(F.lit('" '), part, F.lit('.0 "')))
              .when(line == 3, "null").when(line == 4, F.concat(F.lit("-"), supplier)).when(line == 5, F.concat(part, F.lit(".250")))
              .when(line == 6, F.concat(supplier, F.lit("e3"))).otherwise(F.concat(supplier, F.lit(".00"))))
    document = F.from_json(F.concat(F.lit('{"value": '), member, F.lit("}")), "map<string,variant>")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", n.config_text(document["value"]).alias("text"))


@query("setting_value", """SELECT event_id, trim(coalesce(json_extract_string(CASE WHEN event_id % 2 = 0 THEN
  '{"setting": " ' || CAST(user_id AS VARCHAR) || ' "}' ELSE props END, '$.setting'), CAST(event_id AS VARCHAR) || ' ')) AS setting,
  CASE WHEN event_type = 'error' THEN 'reset' ELSE CAST(user_id AS VARCHAR) END AS effective FROM events""")
def setting_value(t: Tables):
    """N15 and N16 over one settings table."""
    document = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"setting": " '), F.col("user_id").cast("string"), F.lit(' "}'))).otherwise(F.col("props"))
    source = F.when(F.col("event_type") == "error", "session").otherwise("default")
    return t.events.select(
        "event_id", n.setting_value(F.get_json_object(document, "$.setting"), F.concat(F.col("event_id").cast("string"), F.lit(" "))).alias("setting"),
        n.session_reset(source, F.col("user_id").cast("string"), F.lit("reset")).alias("effective"))


ENGINES = ("aurora", "Aurora-MySQL", "aurora-postgresql", "mysql", "MariaDB", "postgres", "oracle-ee", "sqlserver-ex")


@query("database_type", f"""WITH e AS (SELECT o_orderkey AS server_id, ({list(ENGINES)})[CAST(o_orderkey % 8 AS INTEGER) + 1] AS engine FROM orders)
SELECT server_id, engine, CASE WHEN lower(engine) LIKE '%postgres%' THEN 'postgresql'
  WHEN lower(engine) = 'aurora' OR lower(engine) LIKE '%mariadb%' OR lower(engine) LIKE '%mysql%' THEN 'mysql' ELSE '' END AS database_type,
  lower(engine) = 'aurora' OR lower(engine) LIKE 'aurora-%' AS aurora FROM e""")
def database_type(t: Tables):
    engine = F.array(*[F.lit(x) for x in ENGINES])[(F.col("o_orderkey") % 8).cast("int")]
    return t.orders.select(F.col("o_orderkey").alias("server_id"), engine.alias("engine"), n.database_type(engine).alias("database_type"),
                           n.is_aurora(engine).alias("aurora"))


@query("fk_codes", """WITH k AS (SELECT o_orderkey, substr('fpsx', CAST(o_orderkey % 4 AS INTEGER) + 1, 1) AS m,
  substr('arcndx', CAST(o_orderkey % 6 AS INTEGER) + 1, 1) AS u, substr('arcnd', CAST(o_custkey % 5 AS INTEGER) + 1, 1) AS d FROM orders)
SELECT o_orderkey, CASE m WHEN 'f' THEN 'FULL' WHEN 'p' THEN 'PARTIAL' ELSE 'NONE' END AS match_option,
  CASE u WHEN 'a' THEN 'NO ACTION' WHEN 'r' THEN 'RESTRICT' WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' END AS update_rule,
  CASE d WHEN 'a' THEN 'NO ACTION' WHEN 'r' THEN 'RESTRICT' WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' END AS delete_rule
FROM k""")
def fk_codes(t: Tables):
    def letter(letters, column):
        return F.array(*[F.lit(x) for x in letters])[(F.col(column) % len(letters)).cast("int")]
    return t.orders.select(
        "o_orderkey", n.code_word(letter("fpsx", "o_orderkey"), n.MATCH_WORDS, "NONE").alias("match_option"),
        n.code_word(letter("arcndx", "o_orderkey"), n.ACTION_WORDS).alias("update_rule"),
        n.code_word(letter("arcnd", "o_custkey"), n.ACTION_WORDS).alias("delete_rule"))


COLUMN_NAMES = ("dbid", "queryid", "query", "calls", "total_exec_time", "total_time", "rows", "toplevel")


@query("statement_capabilities", f"""WITH c AS (SELECT o_custkey AS server_id, ({list(COLUMN_NAMES)})[CAST(o_orderkey % 8 AS INTEGER) + 1] AS name FROM orders),
has AS (SELECT server_id, bool_or(name = 'dbid') AS d, bool_or(name = 'queryid') AS i, bool_or(name = 'query') AS q, bool_or(name = 'calls') AS c,
  bool_or(name = 'total_exec_time') AS e, bool_or(name = 'total_time') AS t, bool_or(name = 'rows') AS r, bool_or(name = 'toplevel') AS l
  FROM c GROUP BY server_id)
SELECT server_id, CASE WHEN e THEN 'total_exec_time' WHEN t THEN 'total_time' END AS timing_column, r AS has_rows, l AS has_toplevel,
  CASE WHEN NOT d THEN 'missing column dbid' WHEN NOT i THEN 'missing column queryid' WHEN NOT q THEN 'missing column query'
    WHEN NOT c THEN 'missing column calls' WHEN NOT e AND NOT t THEN 'no timing column' END AS error FROM has""")
def statement_capabilities(t: Tables):
    name = F.array(*[F.lit(x) for x in COLUMN_NAMES])[(F.col("o_orderkey") % 8).cast("int")]
    return catalog.statement_capabilities(t.orders.select(F.col("o_custkey").alias("server_id"), F.upper(name).alias("column_name")))


MESSAGES = ("SELECT command denied to user 'x'", "Access denied for user 'x'", "UPDATE command denied to user 'x'", "permission denied for table t",
            "operator does not exist: text = int", "Could not determine data type of parameter $1", "relation does not exist", "Try ALGORITHM=COPY/INPLACE",
            "LOCK=NONE is not supported", "notAuthorized", "AuthorizationFailed", "ThrottlingException")
CODES = ("42501", "42P01", "42703", "42P18", "AccessDeniedException", "Throttling", "bad code!", None)


@query("classify_plan_error", f"""WITH m AS (SELECT o_orderkey, ({b.sql_list(MESSAGES)})[CAST(o_orderkey % 12 AS INTEGER) + 1] AS message,
  ({b.sql_list(CODES)})[CAST(o_custkey % 8 AS INTEGER) + 1] AS code, o_orderstatus = 'F' AS modifying FROM orders), l AS (SELECT *, lower(message) AS t FROM m)
SELECT o_orderkey, CASE WHEN contains(message, 'SELECT command denied to user') OR contains(message, 'Access denied for user') THEN 'need_grant_permission'
    ELSE message END AS mysql_error,
  CASE WHEN contains(message, 'SELECT command denied to user') OR contains(message, 'Access denied for user') THEN 'need_grant_permission'
    WHEN contains(message, 'command denied to user') THEN 'denied' ELSE 'error' END AS mysql_class,
  CASE WHEN (coalesce(code, '') = '42501' OR contains(t, 'select command denied to user') OR contains(t, 'access denied for user') OR contains(t, 'permission denied'))
      AND NOT modifying THEN 'need_grant_permission'
    WHEN coalesce(code, '') IN ('42P18', '42883', '42704') OR contains(t, 'could not determine data type of parameter') OR contains(t, 'indeterminate_datatype')
      OR contains(t, 'cannot determine data type of') OR contains(t, 'operator does not exist') THEN 'retryable'
    WHEN coalesce(code, '') IN ('42P01', '42703') THEN 'invalidating' ELSE 'error' END AS postgres_class FROM l""")
def classify_plan_error(t: Tables):
    rows = _errors(t)
    return rows.select("o_orderkey", c.mysql_plan_error(F.col("message")).alias("mysql_error"), c.mysql_error_class(F.col("message")).alias("mysql_class"),
                       c.postgres_error_class(F.col("code"), F.col("message"), F.col("o_orderstatus") == "F").alias("postgres_class"))


def _errors(t: Tables):
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.array(*[F.lit(x) for x in MESSAGES])[(F.col("o_orderkey") % 12).cast("int")].alias("message"),
        F.array(*[F.lit(x) for x in CODES])[(F.col("o_custkey") % 8).cast("int")].alias("code"))


@query("plan_error_counts", f"""WITH m AS (SELECT o_custkey % 50 AS server_id, ({b.sql_list(MESSAGES)})[CAST(o_orderkey % 12 AS INTEGER) + 1] AS message FROM orders)
SELECT server_id, CASE WHEN contains(message, 'SELECT command denied to user') OR contains(message, 'Access denied for user') THEN 'need_grant_permission'
  WHEN contains(message, 'command denied to user') THEN 'denied' ELSE 'error' END AS outcome, count(*) AS attempts FROM m GROUP BY ALL""")
def plan_error_counts(t: Tables):
    from ..operators.rollups import plan_error_counts as counts

    return counts(_errors(t).select((F.col("o_custkey") % 50).alias("server_id"), c.mysql_error_class(F.col("message")).alias("outcome")))


@query("classify_ddl_error", f"""WITH m AS (SELECT o_orderkey, lower(({b.sql_list(MESSAGES)})[CAST(o_orderkey % 12 AS INTEGER) + 1]) AS t, 1840 + o_custkey % 30 AS number FROM orders)
SELECT o_orderkey, number IN {c.ONLINE_UNSUPPORTED_NUMBERS} OR contains(t, 'try algorithm=copy') OR
  ((contains(t, 'algorithm=inplace') OR contains(t, 'algorithm=nocopy') OR contains(t, 'algorithm=instant') OR contains(t, 'lock=none'))
   AND (contains(t, 'not supported') OR contains(t, 'unsupported'))) AS unsupported FROM m""")
def classify_ddl_error(t: Tables):
    return _errors(t).select("o_orderkey", c.online_ddl_unsupported(1840 + F.col("o_custkey") % 30, F.col("message")).alias("unsupported"))


@query("provider_error_exit", f"""WITH m AS (SELECT o_orderkey, ({b.sql_list(MESSAGES)})[CAST(o_orderkey % 12 AS INTEGER) + 1] AS message, o_orderkey % 9 = 0 AS timed_out,
  ({b.sql_list(CODES)})[CAST(o_custkey % 8 AS INTEGER) + 1] AS code FROM orders),
l AS (SELECT *, lower(message) AS t, contains(lower(coalesce(code, '')), 'accessdenied') OR contains(lower(message), 'accessdenied') AS denied FROM m)
SELECT o_orderkey, CASE WHEN contains(t, 'authorizationfailed') OR contains(t, 'forbidden') OR contains(t, 'unauthorized') OR contains(t, 'denied') THEN 9 ELSE 8 END AS azure,
  CASE WHEN contains(message, 'notAuthorized') THEN 9 ELSE 8 END AS gcp,
  CASE WHEN timed_out THEN 6 WHEN denied THEN 9 ELSE 8 END AS rds,
  CASE WHEN timed_out THEN 'timeout' WHEN denied THEN 'access-denied' WHEN regexp_full_match(code, '[A-Za-z0-9._-]{{1,128}}') THEN 'aws-api:' || code
    ELSE 'aws-api-error' END AS rds_error FROM l""")
def provider_error_exit(t: Tables):
    timed_out = F.col("o_orderkey") % 9 == 0
    message, code = F.col("message"), F.col("code")
    return _errors(t).select("o_orderkey", c.azure_exit_code(message).alias("azure"), c.gcp_exit_code(message).alias("gcp"),
                             c.rds_exit_code(timed_out, code, message).alias("rds"), c.rds_safe_error(timed_out, code, message).alias("rds_error"))


VERSIONED_SQL = """SELECT p_partkey AS column_id, v AS version,
  v >= 100000 AND p_size % 2 = 0 AS is_identity, v >= 120000 AND p_size % 3 = 0 AS is_generated,
  CASE WHEN v >= 120000 AND p_size % 3 = 0 THEN p_name END AS generation_expression,
  CASE WHEN v >= 110000 THEN p_size % 5 ELSE p_size % 5 + 2 END AS key_count,
  v >= 150000 AND p_size % 4 = 0 AS nulls_not_distinct, CASE WHEN v >= 160000 THEN p_brand END AS last_scan
FROM (SELECT *, (9 + p_partkey % 9) * 10000 AS v FROM part)"""


@query("versioned_columns", VERSIONED_SQL)
def versioned_columns(t: Tables):
    size = F.col("p_size")
    rows = t.part.select(
        F.col("p_partkey").alias("column_id"), ((9 + F.col("p_partkey") % 9) * 10000).alias("version"),
        F.when(size % 2 == 0, "YES").otherwise("NO").alias("is_identity"), F.when(size % 3 == 0, "ALWAYS").otherwise("NEVER").alias("is_generated"),
        F.when(size % 3 == 0, F.col("p_name")).otherwise("").alias("generation_expression"), (size % 5).alias("indnkeyatts"), (size % 5 + 2).alias("indnatts"),
        (size % 4 == 0).alias("indnullsnotdistinct"), F.col("p_brand").alias("last_idx_scan"))
    return catalog.versioned_columns(rows)


@query("session_reset", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'r' || CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS setting FROM orders""")
def session_reset(t: Tables):
    source = F.when(F.col("o_orderstatus") == "F", "session").otherwise("configuration file")
    return t.orders.select("o_orderkey", n.session_reset(source, F.col("o_orderpriority"), F.concat(F.lit("r"), F.col("o_custkey").cast("string"))).alias("setting"))
