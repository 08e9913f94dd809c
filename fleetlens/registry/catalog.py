"""Queries of the schema catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, rollups
from ..operators.skew import meet
from . import bindings as b
from .base import Tables, query


def servers():
    """The ten servers, one row each."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint")))


def pick(letters, column, divisor=1):
    values = F.array(*[F.lit(x) for x in letters])
    return values[(F.floor(F.col(column) / divisor) % len(letters)).cast("int")]


def namespaces(t: Tables):
    key = F.col("n_nationkey")
    name = F.when(key % 9 == 4, "pg_catalog").when(key % 9 == 5, F.concat(F.lit("pg_toast_"), key.cast("string"))).otherwise(F.lower("n_name"))
    return t.nation.select(servers().alias("server_id"), key.cast("bigint").alias("oid"), name.alias("nspname"))


def classes(t: Tables):
    key = F.col("c_custkey")
    return t.customer.select(
        (key % 10).alias("server_id"), key.alias("oid"), F.concat(F.lit("rel_"), key.cast("string")).alias("relname"),
        F.col("c_nationkey").cast("bigint").alias("relnamespace"), pick(("r", "p", "v", "m", "f", "t", "i", "S"), "c_custkey", 10).alias("relkind"),
        F.floor("c_acctbal").alias("seq_scan"))


def attributes(t: Tables):
    """Columns 1 to 9 of every table; a few are missing."""
    number = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(9).cast("bigint")))
    columns = t.customer.select((F.col("c_custkey") % 10).alias("server_id"), F.col("c_custkey").alias("attrelid"), number.alias("attnum"))
    return columns.filter((F.col("attrelid") + F.col("attnum")) % 31 != 0).withColumn(
        "attname", F.concat(F.lit("c"), F.col("attnum").cast("string"), F.lit("_"), (F.col("attrelid") % 7).cast("string"))).withColumn(
        "attcollation", (F.col("attrelid") + F.col("attnum")) % 25)


CATALOG = """
servers AS (SELECT unnest(range(10)) AS server_id),
namespaces AS (SELECT server_id, CAST(n_nationkey AS BIGINT) AS oid, CASE n_nationkey % 9 WHEN 4 THEN 'pg_catalog'
  WHEN 5 THEN 'pg_toast_' || CAST(n_nationkey AS VARCHAR) ELSE lower(n_name) END AS nspname FROM nation, servers),
classes AS (SELECT c_custkey % 10 AS server_id, c_custkey AS oid, 'rel_' || CAST(c_custkey AS VARCHAR) AS relname, CAST(c_nationkey AS BIGINT) AS relnamespace,
  (['r', 'p', 'v', 'm', 'f', 't', 'i', 'S'])[CAST((c_custkey // 10) % 8 AS INTEGER) + 1] AS relkind, CAST(floor(c_acctbal) AS BIGINT) AS seq_scan FROM customer),
attributes AS (SELECT c_custkey % 10 AS server_id, c_custkey AS attrelid, n AS attnum, 'c' || CAST(n AS VARCHAR) || '_' || CAST(c_custkey % 7 AS VARCHAR) AS attname,
  (c_custkey + n) % 25 AS attcollation FROM customer, (SELECT unnest(range(1, 10)) AS n) WHERE (c_custkey + n) % 31 <> 0)"""


def indexes(t: Tables):
    """One index per order on the table of its customer, with one to four columns."""
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    width = (1 + order % 4).cast("int")

    def cut(*values):
        return F.slice(F.array(*values), F.lit(1), width)
    return t.orders.select(
        (cust % 10).alias("server_id"), order.alias("indexrelid"), cust.alias("indrelid"), F.least(F.lit(1) + order % 3, 1 + order % 4).alias("key_count"),
        cut(cust % 5 + 1, order % 4, order % 9 + 1, order % 7 + 2).alias("indkey"), cut(cust % 25, order % 30, F.lit(0).cast("bigint"), (cust + order) % 25).alias("indcollation"),
        cut(order % 28, cust % 25, order % 3, order % 5).alias("indclass"), cut(order % 4, cust % 4, F.lit(1).cast("bigint"), order % 2).alias("indoption"),
        F.transform(cut(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), lambda x: F.concat(F.lit("def"), x.cast("string"), F.lit("_"), (order % 100).cast("string"))).alias("definitions"))


def sorting(t: Tables):
    number = F.col("n_nationkey")
    base = t.nation.select(servers().alias("server_id"), number.cast("bigint").alias("oid"), number, "n_name")
    collations = base.select("server_id", "oid", F.concat(F.lit("coll_"), F.lower("n_name")).alias("collname"), ((number + 3) % 27).cast("bigint").alias("collnamespace"))
    opclasses = base.select("server_id", "oid", F.concat(F.lit("op_"), F.lower("n_name")).alias("opcname"), ((number + 5) % 25).cast("bigint").alias("opcnamespace"),
                            (number % 3 == 0).alias("opcdefault"))
    return collations, opclasses


@query("index_keys", f"""WITH {CATALOG}, indexes AS (SELECT o_custkey % 10 AS server_id, o_orderkey AS indexrelid, o_custkey AS indrelid,
  least(1 + o_orderkey % 3, 1 + o_orderkey % 4) AS key_count, 1 + o_orderkey % 4 AS width, o_orderkey % 100 AS tag,
  [o_custkey % 5 + 1, o_orderkey % 4, o_orderkey % 9 + 1, o_orderkey % 7 + 2] AS indkey, [o_custkey % 25, o_orderkey % 30, 0, (o_custkey + o_orderkey) % 25] AS indcollation,
  [o_orderkey % 28, o_custkey % 25, o_orderkey % 3, o_orderkey % 5] AS indclass, [o_orderkey % 4, o_custkey % 4, 1, o_orderkey % 2] AS indoption FROM orders),
parts AS (SELECT i.*, p AS position, indkey[p] AS attnum, indcollation[p] AS coll, indclass[p] AS opc, indoption[p] AS option,
  'def' || CAST(p AS VARCHAR) || '_' || CAST(tag AS VARCHAR) AS definition FROM indexes i, (SELECT unnest([1, 2, 3, 4]) AS p) WHERE p <= width),
joined AS (SELECT p.server_id, p.indexrelid, p.position, p.key_count, p.attnum, p.coll, p.option, p.definition, a.attname, a.attcollation,
  CASE WHEN k.n_name IS NOT NULL THEN 'coll_' || lower(k.n_name) END AS collname, kn.nspname AS collschema,
  CASE WHEN o.n_name IS NOT NULL THEN 'op_' || lower(o.n_name) END AS opcname, onn.nspname AS opcschema, coalesce(o.n_nationkey % 3 = 0, false) AS opcdefault
  FROM parts p LEFT JOIN attributes a ON a.server_id = p.server_id AND a.attrelid = p.indrelid AND a.attnum = p.attnum
  LEFT JOIN nation k ON k.n_nationkey = p.coll LEFT JOIN namespaces kn ON kn.server_id = p.server_id AND kn.oid = (k.n_nationkey + 3) % 27
  LEFT JOIN nation o ON o.n_nationkey = p.opc LEFT JOIN namespaces onn ON onn.server_id = p.server_id AND onn.oid = (o.n_nationkey + 5) % 25)
SELECT server_id, indexrelid, string_agg(concat_ws('|', position, coalesce(CASE WHEN attnum <> 0 THEN attname END, '-'), coalesce(CASE WHEN attnum = 0 THEN definition END, '-'),
    coalesce(collname, '-'), coalesce(opcname, '-'), coalesce(collschema, '-'), coalesce(opcschema, '-'),
    CASE WHEN coll = 0 THEN 'true' WHEN attnum <> 0 THEN coalesce(CAST(coll = attcollation AS VARCHAR), '-') ELSE 'false' END, opcdefault, (option & 1) = 1, (option & 2) = 2, definition), ';'
    ORDER BY position) FILTER (WHERE position <= key_count) AS keys,
  coalesce(string_agg(attname, ',' ORDER BY position) FILTER (WHERE position > key_count AND attname IS NOT NULL), '') AS include_columns
FROM joined GROUP BY server_id, indexrelid""")
def index_keys(t: Tables):
    result = catalog.index_keys(indexes(t), attributes(t), *sorting(t), namespaces(t))
    fields = ("position", "column_name", "expression", "collation", "opclass", "collation_schema", "opclass_schema", "collation_is_default",
              "opclass_is_default", "descending", "nulls_first", "definition")
    text = F.transform("keys", lambda k: F.concat_ws("|", *[F.coalesce(k[f].cast("string"), F.lit("-")) for f in fields]))
    return result.select("server_id", "indexrelid", F.array_join(text, ";").alias("keys"), F.array_join("include_columns", ",").alias("include_columns"))


@query("index_usage_attach", """WITH usage AS (SELECT o_custkey % 10 AS server_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey ELSE -1 - o_orderkey END AS indexrelid, CAST(floor(o_totalprice) AS BIGINT) AS idx_scan,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS last_idx_scan FROM orders)
SELECT o_custkey % 10 AS server_id, o_orderkey AS indexrelid, coalesce(u.idx_scan, 0) AS idx_scan, u.last_idx_scan,
  CASE WHEN o_custkey % 10 <> 7 THEN 'r' || CAST(o_custkey % 10 AS VARCHAR) END AS stats_reset, o_orderstatus = 'P' AS is_attached_partition
FROM orders LEFT JOIN usage u ON u.server_id = o_custkey % 10 AND u.indexrelid = o_orderkey""")
def index_usage_attach(t: Tables):
    server = (F.col("o_custkey") % 10).alias("server_id")
    index = F.col("o_orderkey").alias("indexrelid")
    order = F.col("o_orderkey")
    usage = t.orders.select(server, F.when(order % 3 != 0, order).otherwise(-1 - order).alias("indexrelid"), F.floor("o_totalprice").alias("idx_scan"),
                                                                F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("string")).alias("last_idx_scan"))
    resets = t.orders.select(server).distinct().withColumn("stats_reset", F.when(F.col("server_id") != 7, F.concat(F.lit("r"), F.col("server_id").cast("string"))))
    inherits = t.orders.select(server, F.when(F.col("o_orderstatus") == "P", order).otherwise(-1 - order).alias("inhrelid"))
    return catalog.index_usage_attach(t.orders.select(server, index), usage, resets, inherits)


# Indexes and tables of a server are told apart by their ids.
INDEX_IDS = 1 << 40
FLAGS = ("unique", "primary", "valid", "ready", "exclusion", "clustered", "replident")


@query("index_rows", f"""WITH {CATALOG}, versions AS (SELECT server_id, 90000 + server_id * 10000 AS version FROM servers),
raw AS (SELECT o_custkey % 10 AS server_id, o_orderkey AS indexrelid, o_custkey AS indrelid, 1 + o_orderkey % 4 AS indnatts, least(1 + o_orderkey % 3, 1 + o_orderkey % 4) AS indnkeyatts,
  o_orderkey % 100 AS tag, [o_custkey % 5 + 1, o_orderkey % 4, o_orderkey % 9 + 1, o_orderkey % 7 + 2] AS indkey, [o_custkey % 25, o_orderkey % 30, 0, (o_custkey + o_orderkey) % 25] AS indcollation,
  [o_orderkey % 28, o_custkey % 25, o_orderkey % 3, o_orderkey % 5] AS indclass, [o_orderkey % 4, o_custkey % 4, 1, o_orderkey % 2] AS indoption, o_orderstatus, o_totalprice FROM orders),
indexes AS (SELECT raw.*, version, CASE WHEN version >= 110000 THEN indnkeyatts ELSE indnatts END AS key_count FROM raw JOIN versions USING (server_id)),
parts AS (SELECT i.*, p AS position, indkey[p] AS attnum, indcollation[p] AS coll, indclass[p] AS opc, indoption[p] AS option,
  'def' || CAST(p AS VARCHAR) || '_' || CAST(tag AS VARCHAR) AS definition FROM indexes i, (SELECT unnest([1, 2, 3, 4]) AS p) WHERE p <= indnatts),
joined AS (SELECT p.server_id, p.indexrelid, p.position, p.key_count, p.attnum, p.coll, p.option, p.definition, a.attname, a.attcollation,
  CASE WHEN k.n_name IS NOT NULL THEN 'coll_' || lower(k.n_name) END AS collname, CASE WHEN o.n_name IS NOT NULL THEN 'op_' || lower(o.n_name) END AS opcname, coalesce(o.n_nationkey % 3 = 0, false) AS opcdefault
  FROM parts p LEFT JOIN attributes a ON a.server_id = p.server_id AND a.attrelid = p.indrelid AND a.attnum = p.attnum
  LEFT JOIN nation k ON k.n_nationkey = p.coll LEFT JOIN nation o ON o.n_nationkey = p.opc),
keyed AS (SELECT server_id, indexrelid, coalesce(string_agg(concat_ws('|', position, coalesce(CASE WHEN attnum <> 0 THEN attname END, '-'), coalesce(CASE WHEN attnum = 0 THEN definition END, '-'),
    coalesce(collname, '-'), coalesce(opcname, '-'), CASE WHEN coll = 0 THEN 'true' WHEN attnum <> 0 THEN coalesce(CAST(coll = attcollation AS VARCHAR), '-') ELSE 'false' END, opcdefault,
    (option & 1) = 1, (option & 2) = 2), ';' ORDER BY position) FILTER (WHERE position <= key_count), '') AS keys,
  coalesce(string_agg(attname, ',' ORDER BY position) FILTER (WHERE position > key_count AND attname IS NOT NULL), '') AS include_columns FROM joined GROUP BY server_id, indexrelid)
SELECT i.server_id, 'db' || CAST(i.indrelid % 4 AS VARCHAR) AS database, n.nspname AS schema, c.relname AS "table", 'idx_' || CAST(i.indexrelid AS VARCHAR) AS name,
  (['btree', 'hash', 'gin'])[CAST(i.indexrelid % 3 AS INTEGER) + 1] AS access_method, keys, include_columns, CASE WHEN i.indexrelid % 5 = 0 THEN 'c > ' || CAST(tag AS VARCHAR) ELSE '' END AS predicate,
  'CREATE INDEX idx_' || CAST(i.indexrelid AS VARCHAR) AS definition, {", ".join(f"(i.indexrelid + {n}) % {n + 2} = 0 AS is_{flag}" for n, flag in enumerate(FLAGS))},
  version >= 150000 AND i.indexrelid % 6 = 0 AS nulls_not_distinct, i.indexrelid % 8 = 0 AS is_partitioned, o_orderstatus = 'P' AS is_attached_partition,
  CASE WHEN i.indexrelid % 8 = 0 THEN 'I' ELSE 'i' END AS relation_kind, CASE WHEN i.indexrelid % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END AS idx_scan,
  CASE WHEN version >= 160000 AND i.indexrelid % 3 <> 0 AND i.indexrelid % 4 <> 0 THEN 'scan ' || CAST(i.indexrelid AS VARCHAR) END AS last_idx_scan,
  CASE WHEN i.server_id <> 7 THEN 'r' || CAST(i.server_id AS VARCHAR) END AS stats_reset
FROM indexes i JOIN classes c ON c.server_id = i.server_id AND c.oid = i.indrelid JOIN namespaces n ON n.server_id = c.server_id AND n.oid = c.relnamespace
JOIN keyed k ON k.server_id = i.server_id AND k.indexrelid = i.indexrelid
WHERE n.nspname NOT IN ('information_schema', 'pg_catalog') AND n.nspname NOT LIKE 'pg_toast%' AND n.nspname NOT LIKE 'pg_temp_%'""")
def index_rows(t: Tables):
    """One row per index; usage that no index has, and servers of every version from 9 to 18, are among the input."""
    order, server = F.col("o_orderkey"), (F.col("o_custkey") % 10).alias("server_id")
    text = lambda prefix, column: F.concat(F.lit(prefix), column.cast("string"))
    flags = [((order + n) % (n + 2) == 0).alias(f"indis{flag}") for n, flag in enumerate(FLAGS)]
    own = t.orders.select(
        server, order.alias("indexrelid"), (90000 + F.col("server_id") * 10000).alias("version"), (1 + order % 4).alias("indnatts"), F.least(1 + order % 3, 1 + order % 4).alias("indnkeyatts"),
        (order % 6 == 0).alias("indnullsnotdistinct"), text("db", F.col("o_custkey") % 4).alias("database"), F.when(order % 5 == 0, text("c > ", order % 100)).alias("indpred"),
        text("CREATE INDEX idx_", order).alias("indexdef"), *flags)
    rows = meet(indexes(t).drop("key_count"), own, ["server_id", "indexrelid"])
    relations = classes(t).select("server_id", "oid", "relname", "relnamespace", "relkind", F.lit(None).cast("bigint").alias("relam")).unionByName(t.orders.select(
        server, order.alias("oid"), text("idx_", order).alias("relname"), F.lit(None).cast("bigint").alias("relnamespace"), F.when(order % 8 == 0, "I").otherwise("i").alias("relkind"),
        (order % 3).alias("relam")).withColumn("oid", F.col("oid") + INDEX_IDS))
    methods = t.region.select(servers().alias("server_id"), F.col("r_regionkey").cast("bigint").alias("oid"), pick(("btree", "hash", "gin"), "r_regionkey").alias("amname")).filter("oid < 3")
    usage = t.orders.select(server, F.when(order % 3 != 0, order + INDEX_IDS).otherwise(-1 - order).alias("indexrelid"), F.floor("o_totalprice").alias("idx_scan"),
                            F.when(order % 4 != 0, text("scan ", order)).alias("last_idx_scan"))
    resets = t.nation.select(servers().alias("server_id")).distinct().withColumn("stats_reset", F.when(F.col("server_id") != 7, text("r", F.col("server_id"))).otherwise(""))
    inherits = t.orders.select(server, F.when(F.col("o_orderstatus") == "P", order + INDEX_IDS).otherwise(-1 - order).alias("inhrelid"))
    found = catalog.index_rows(rows.withColumn("indexrelid", F.col("indexrelid") + INDEX_IDS), relations, methods, attributes(t), *sorting(t), namespaces(t), usage, resets, inherits)
    fields = ("position", "column_name", "expression", "collation", "opclass", "collation_is_default", "opclass_is_default", "descending", "nulls_first")
    keys = F.transform("keys", lambda k: F.concat_ws("|", *[F.coalesce(k[f].cast("string"), F.lit("-")) for f in fields]))
    return found.withColumns({"keys": F.array_join(keys, ";"), "include_columns": F.array_join("include_columns", ",")}).withColumnRenamed("is_replica_identity", "is_replident")


def constraints(t: Tables):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    foreign = F.col("o_orderstatus") != "P"
    return t.orders.select(
        (cust % 10).alias("server_id"), order.alias("oid"), F.concat(F.lit("con_"), order.cast("string")).alias("conname"),
        F.when(foreign, "f").when(order % 2 == 0, "p").otherwise("u").alias("contype"), cust.alias("conrelid"), F.when(foreign, cust + 10).alias("confrelid"),
        F.when(foreign, cust + 10 + (order % 3) * 10).otherwise(cust + (order % 2) * 10).alias("conindid"),
        F.array(cust % 5 + 1, cust % 3 + 6).alias("conkey"), F.when(foreign, F.array(order % 4 + 1, cust % 2 + 6)).alias("confkey"),
        pick("fpsx", "o_orderkey").alias("confmatchtype"), pick("arcndx", "o_orderkey").alias("confupdtype"), pick("arcnd", "o_custkey").alias("confdeltype"))


CONSTRAINTS = CATALOG + """,
constraints AS (SELECT o_custkey % 10 AS server_id, o_orderkey AS oid, 'con_' || CAST(o_orderkey AS VARCHAR) AS conname,
  CASE WHEN o_orderstatus <> 'P' THEN 'f' WHEN o_orderkey % 2 = 0 THEN 'p' ELSE 'u' END AS contype, o_custkey AS conrelid,
  CASE WHEN o_orderstatus <> 'P' THEN o_custkey + 10 END AS confrelid,
  CASE WHEN o_orderstatus <> 'P' THEN o_custkey + 10 + (o_orderkey % 3) * 10 ELSE o_custkey + (o_orderkey % 2) * 10 END AS conindid,
  [o_custkey % 5 + 1, o_custkey % 3 + 6] AS conkey, CASE WHEN o_orderstatus <> 'P' THEN [o_orderkey % 4 + 1, o_custkey % 2 + 6] END AS confkey,
  substr('fpsx', CAST(o_orderkey % 4 AS INTEGER) + 1, 1) AS m, substr('arcndx', CAST(o_orderkey % 6 AS INTEGER) + 1, 1) AS u, substr('arcnd', CAST(o_custkey % 5 AS INTEGER) + 1, 1) AS d
  FROM orders),
uniques AS (SELECT server_id, conindid, conrelid, arg_min(conname, oid) AS conname, arg_min(conkey, oid) AS conkey FROM constraints WHERE contype IN ('p', 'u') GROUP BY ALL),
foreigns AS (SELECT c.*, a.relname AS child, an.nspname AS child_schema, r.relname AS parent, rn.nspname AS parent_schema, q.conname AS unique_name, q.conkey AS unique_key, x.relname AS index_name
  FROM constraints c JOIN classes a ON a.server_id = c.server_id AND a.oid = c.conrelid JOIN namespaces an ON an.server_id = a.server_id AND an.oid = a.relnamespace
  JOIN classes r ON r.server_id = c.server_id AND r.oid = c.confrelid JOIN namespaces rn ON rn.server_id = r.server_id AND rn.oid = r.relnamespace
  LEFT JOIN classes x ON x.server_id = c.server_id AND x.oid = c.conindid
  LEFT JOIN uniques q ON q.server_id = c.server_id AND q.conindid = c.conindid AND q.conrelid = c.confrelid
  WHERE c.contype = 'f' AND an.nspname NOT IN ('information_schema', 'pg_catalog') AND an.nspname NOT LIKE 'pg_toast%' AND an.nspname NOT LIKE 'pg_temp_%')"""

RULE = "CASE {0} WHEN 'a' THEN 'NO ACTION' WHEN 'r' THEN 'RESTRICT' WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' END"


@query("referential_constraints", f"""WITH {CONSTRAINTS} SELECT server_id, child_schema AS constraint_schema, conname AS constraint_name, parent_schema AS unique_constraint_schema,
  coalesce(unique_name, index_name, 'NULL') AS unique_constraint_name, CASE m WHEN 'f' THEN 'FULL' WHEN 'p' THEN 'PARTIAL' ELSE 'NONE' END AS match_option,
  {RULE.format('u')} AS update_rule, {RULE.format('d')} AS delete_rule, child AS table_name, parent AS referenced_table_name FROM foreigns""")
def referential_constraints(t: Tables):
    return catalog.referential_constraints(constraints(t), classes(t), namespaces(t))


@query("key_column_usage", f"""WITH {CONSTRAINTS}, parts AS (SELECT f.*, p FROM foreigns f, (SELECT unnest([1, 2]) AS p))
SELECT p.server_id, p.child_schema AS constraint_schema, p.conname AS constraint_name, p.child AS table_name, a.attname AS column_name, CAST(p.p AS VARCHAR) AS ordinal_position,
  CAST(coalesce(nullif(list_position(p.unique_key, p.confkey[p.p]), 0), p.p) AS VARCHAR) AS position_in_unique_constraint,
  p.parent_schema AS referenced_table_schema, p.parent AS referenced_table_name, r.attname AS referenced_column_name
FROM parts p JOIN attributes a ON a.server_id = p.server_id AND a.attrelid = p.conrelid AND a.attnum = p.conkey[p.p]
JOIN attributes r ON r.server_id = p.server_id AND r.attrelid = p.confrelid AND r.attnum = p.confkey[p.p]""")
def key_column_usage(t: Tables):
    return catalog.key_column_usage(constraints(t), classes(t), namespaces(t), attributes(t))


@query("sequence_ownership", f"""WITH {CATALOG},
seqs AS (SELECT p_partkey % 10 AS server_id, CASE p_partkey % 25 % 9 WHEN 4 THEN 'pg_catalog' WHEN 5 THEN 'pg_toast_' || CAST(p_partkey % 25 AS VARCHAR) ELSE 'nation_' || CAST(p_partkey % 26 AS VARCHAR) END AS schemaname,
  'seq_' || CAST(p_partkey AS VARCHAR) AS sequencename, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'NULL' ELSE CAST(p_size AS VARCHAR) END AS cache_size,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS last_value, CASE p_partkey % 3 WHEN 0 THEN 'smallint' WHEN 1 THEN 'bigint' ELSE 'NULL' END AS data_type,
  CAST(p_size AS VARCHAR) AS start_value, CASE WHEN p_partkey % 7 <> 0 THEN '-' || CAST(p_partkey AS VARCHAR) END AS min_value, CAST(p_partkey * 1000 AS VARCHAR) AS max_value,
  CASE WHEN p_partkey % 8 = 0 THEN 'NULL' ELSE '2' END AS increment_by, CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS cycle FROM part),
own AS (SELECT p_partkey % 10 AS server_id, 1000000 + p_partkey AS oid, CASE WHEN p_partkey % 6 <> 0 THEN 'seq_' ELSE 'lost_' END || CAST(p_partkey AS VARCHAR) AS relname, CAST(p_partkey % 26 AS BIGINT) AS relnamespace FROM part),
deps AS (SELECT p_partkey % 10 AS server_id, CASE WHEN p_partkey % 5 <> 0 THEN 1000000 + p_partkey ELSE -p_partkey END AS objid, p_partkey % 100 AS refobjid, p_partkey % 10 AS refobjsubid FROM part
  WHERE (['a', 'i', 'n'])[CAST((p_partkey // 10) % 3 AS INTEGER) + 1] IN ('a', 'i'))
SELECT s.server_id, s.schemaname, s.sequencename, nullif(nullif(s.cache_size, 'NULL'), '') AS cache_size, nullif(nullif(s.last_value, 'NULL'), '') AS last_value,
  tn.nspname AS owned_table_schema, c.relname AS owned_table_name, a.attname AS owned_column_name,
  CASE WHEN a.attnum % 2 = 0 THEN 'bigint' WHEN a.attnum IS NOT NULL THEN 'integer' END AS owned_column_data_type, nullif(s.data_type, 'NULL') AS data_type, s.start_value, s.min_value, s.max_value,
  nullif(s.increment_by, 'NULL') AS increment_by, coalesce(s.cycle, 'false') AS cycle
FROM seqs s LEFT JOIN (SELECT server_id, nspname, min(oid) AS oid FROM namespaces GROUP BY ALL) n ON n.server_id = s.server_id AND n.nspname = s.schemaname
LEFT JOIN own o ON o.server_id = s.server_id AND o.relnamespace = n.oid AND o.relname = s.sequencename
LEFT JOIN deps d ON d.server_id = s.server_id AND d.objid = o.oid LEFT JOIN classes c ON c.server_id = s.server_id AND c.oid = d.refobjid
LEFT JOIN namespaces tn ON tn.server_id = c.server_id AND tn.oid = c.relnamespace
LEFT JOIN attributes a ON a.server_id = s.server_id AND a.attrelid = c.oid AND a.attnum = d.refobjsubid
WHERE s.schemaname NOT IN ('information_schema', 'pg_catalog') AND s.schemaname NOT LIKE 'pg_toast%' AND s.schemaname NOT LIKE 'pg_temp_%'""")
def sequence_ownership(t: Tables):
    key = F.col("p_partkey")
    name = F.concat(F.lit("seq_"), key.cast("string"))
    schema = (F.when(key % 25 % 9 == 4, "pg_catalog").when(key % 25 % 9 == 5, F.concat(F.lit("pg_toast_"), (key % 25).cast("string")))
              .otherwise(F.concat(F.lit("nation_"), (key % 26).cast("string"))))
    sequences = t.part.select((key % 10).alias("server_id"), schema.alias("schemaname"), name.alias("sequencename"),
                              F.when(key % 3 == 0, "NULL").otherwise(F.col("p_size").cast("string")).alias("cache_size"),
                              F.when(key % 4 == 0, "").otherwise(key.cast("string")).alias("last_value"),
                              F.when(key % 3 == 0, "smallint").when(key % 3 == 1, "bigint").otherwise("NULL").alias("data_type"),
                              F.col("p_size").cast("string").alias("start_value"), F.when(key % 7 != 0, F.concat(F.lit("-"), key.cast("string"))).alias("min_value"),
                              (key * 1000).cast("string").alias("max_value"), F.when(key % 8 == 0, "NULL").otherwise("2").alias("increment_by"),
                              F.when(key % 5 == 0, "true").when(key % 5 == 1, "false").alias("cycle"))
    own = t.part.select((key % 10).alias("server_id"), (key + 1000000).alias("oid"), F.when(key % 6 != 0, name).otherwise(F.concat(F.lit("lost_"), key.cast("string"))).alias("relname"),
                        (key % 26).alias("relnamespace"), F.lit("S").alias("relkind"), F.lit(0).cast("bigint").alias("seq_scan"))
    dependencies = t.part.select(
        (key % 10).alias("server_id"), F.when(key % 5 != 0, key + 1000000).otherwise(-key).alias("objid"), F.lit(0).alias("objsubid"), pick("ain", "p_partkey", 10).alias("deptype"),
        (key % 100).alias("refobjid"), (key % 10).alias("refobjsubid"))
    everything = classes(t).unionByName(own)
    columns = attributes(t).withColumn("data_type", F.when(F.col("attnum") % 2 == 0, "bigint").otherwise("integer"))
    return catalog.sequence_ownership(sequences, namespaces(t), everything, dependencies, columns)


@query("tables_section", f"""WITH {CATALOG}, tables AS (SELECT c.server_id, n.nspname AS table_schema, c.relname AS table_name, CASE c.relkind WHEN 'v' THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
  c.relkind, c.seq_scan, c.oid FROM classes c JOIN namespaces n ON n.server_id = c.server_id AND n.oid = c.relnamespace)
SELECT server_id, table_schema, table_name, table_type, relkind, CASE WHEN oid % 7 = 0 THEN 0 ELSE greatest(seq_scan, 0) END AS estimated_rows, CASE WHEN oid % 5 = 0 THEN 0 ELSE oid * 100 END AS table_size,
  oid * 10 AS index_size, oid * 110 AS total_size, CASE WHEN relkind IN ('r', 'm', 'p') THEN oid % 13 ELSE 0 END AS mod_since_analyze,
  CASE WHEN relkind IN ('r', 'm', 'p') THEN 'at ' || CAST(oid AS VARCHAR) END AS last_analyze
FROM tables WHERE relkind IN ('r', 'p', 'v', 'm', 'f') AND table_schema NOT IN ('information_schema', 'pg_catalog') AND table_schema NOT LIKE 'pg_toast%' AND table_schema NOT LIKE 'pg_temp_%'""")
def tables_section(t: Tables):
    names = namespaces(t).filter("nspname <> 'pg_catalog'")
    relations = classes(t)
    tables = relations.join(namespaces(t).select("server_id", F.col("oid").alias("relnamespace"), F.col("nspname").alias("table_schema")), ["server_id", "relnamespace"]).select(
        "server_id", "table_schema", F.col("relname").alias("table_name"), F.when(F.col("relkind") == "v", "VIEW").otherwise("BASE TABLE").alias("table_type"))
    oid = F.col("oid")
    sized = relations.select("server_id", "oid", "relname", "relnamespace", "relkind", F.when(oid % 7 != 0, F.col("seq_scan").cast("double")).alias("reltuples"),
                             F.when(oid % 5 != 0, oid * 100).alias("table_size"), (oid * 10).alias("index_size"), (oid * 110).alias("total_size"),
                             (oid % 13).alias("mod_since_analyze"), F.concat(F.lit("at "), oid.cast("string")).alias("last_analyze"))
    return catalog.tables_section(tables, names, sized)


@query("columns_section", """WITH c AS (SELECT p_partkey % 10 AS server_id, CASE p_partkey % 4 WHEN 0 THEN 'pg_catalog' WHEN 1 THEN 'public' WHEN 2 THEN 'pg_temp_9' ELSE 'app' END AS table_schema,
  p_brand AS table_name, p_name AS column_name, p_partkey AS ordinal_position, CASE WHEN p_size % 5 <> 0 THEN p_type END AS d, p_size, p_type, (9 + p_partkey % 10) * 10000 AS v FROM part)
SELECT server_id, table_schema, table_name, column_name, ordinal_position, coalesce(d, '') AS column_default, p_size % 2 = 0 AS is_nullable, p_type AS data_type,
  v >= 100000 AND p_size % 3 = 0 AS is_identity, v >= 120000 AND p_size % 4 = 0 AS is_generated, CASE WHEN v >= 120000 AND p_size % 4 = 0 THEN column_name END AS generation_expression
FROM c WHERE table_schema IN ('public', 'app')""")
def columns_section(t: Tables):
    key, size = F.col("p_partkey"), F.col("p_size")
    columns = t.part.select(
        (key % 10).alias("server_id"), pick(("pg_catalog", "public", "pg_temp_9", "app"), "p_partkey").alias("table_schema"), F.col("p_brand").alias("table_name"),
        F.col("p_name").alias("column_name"), key.alias("ordinal_position"), F.when(size % 5 != 0, F.col("p_type")).alias("column_default"),
        F.when(size % 2 == 0, "YES").otherwise("NO").alias("is_nullable"), F.col("p_type").alias("data_type"), ((9 + key % 10) * 10000).alias("version"),
        F.when(size % 3 == 0, "YES").otherwise("NO").alias("is_identity"), F.when(size % 4 == 0, "ALWAYS").otherwise("NEVER").alias("is_generated"),
        F.when(size % 4 == 0, F.col("p_name")).alias("generation_expression"))
    return catalog.columns_section(columns)


@query("table_statistics", f"""WITH {CATALOG}, scans AS (SELECT o_custkey % 10 AS server_id, CASE WHEN o_orderpriority <> '5-LOW' AND o_custkey % 3 <> 0 THEN o_custkey ELSE 1000000000 + o_orderkey END AS oid,
  CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS idx_scan FROM orders GROUP BY ALL)
SELECT c.server_id, c.oid AS relid, n.nspname AS schemaname, c.relname, c.seq_scan, s.idx_scan FROM classes c JOIN namespaces n ON n.server_id = c.server_id AND n.oid = c.relnamespace
LEFT JOIN scans s ON s.server_id = c.server_id AND s.oid = c.oid WHERE c.relkind IN ('r', 't', 'm', 'p') AND n.nspname NOT IN ('pg_catalog', 'information_schema') AND n.nspname NOT LIKE 'pg_toast%'""")
def table_statistics(t: Tables):
    known = (F.col("o_orderpriority") != "5-LOW") & (F.col("o_custkey") % 3 != 0)
    scans = t.orders.select(
        (F.col("o_custkey") % 10).alias("server_id"), F.when(known, F.col("o_custkey")).otherwise(F.col("o_orderkey") + 1000000000).alias("indrelid"), F.floor("o_totalprice").alias("numscans"))
    return catalog.table_statistics(classes(t), namespaces(t), scans)


ENGINE_MERGE = f"""{b.TABLE_CATALOG}, renamed AS (SELECT server_id, CASE engine WHEN 'SMALL' THEN 'MyISAM' ELSE engine END AS engine, data_length, index_length FROM catalog),
sizes AS (SELECT server_id, engine, count(*) AS tables, CAST(coalesce(sum(data_length + index_length), 0) AS BIGINT) AS total_size, CAST(coalesce(sum(data_length), 0) AS BIGINT) AS data_size,
  CAST(coalesce(sum(index_length), 0) AS BIGINT) AS index_size FROM renamed WHERE engine IS NOT NULL GROUP BY ALL),
support AS (SELECT DISTINCT p_partkey % 10 AS server_id, CASE WHEN p_type = 'PROMO' OR (p_type = 'SMALL' AND p_partkey % 10 >= 6) THEN 'ARCHIVE' WHEN p_size % 3 = 0 THEN 'MEMORY' WHEN p_type = 'SMALL' THEN 'MyISAM' ELSE p_type END AS engine,
  CASE WHEN p_partkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS enabled FROM part),
merged AS (SELECT u.server_id, u.engine, u.enabled, coalesce(s.tables, 0) AS tables, coalesce(s.total_size, 0) AS total_size, coalesce(s.data_size, 0) AS data_size,
  coalesce(s.index_size, 0) AS index_size FROM support u LEFT JOIN sizes s ON s.server_id = u.server_id AND s.engine = u.engine)"""


def merged_engines(t: Tables):
    renamed = b.table_catalog(t).withColumn("engine", F.when(F.col("engine") == "SMALL", "MyISAM").otherwise(F.col("engine")))
    unused = (F.col("p_type") == "PROMO") | ((F.col("p_type") == "SMALL") & (F.col("p_partkey") % 10 >= 6))
    support = t.part.select(
        (F.col("p_partkey") % 10).alias("server_id"),
        F.when(unused, "ARCHIVE").when(F.col("p_size") % 3 == 0, "MEMORY").when(F.col("p_type") == "SMALL", "MyISAM").otherwise(F.col("p_type")).alias("engine"),
        F.when(F.col("p_partkey") % 2 == 0, "YES").otherwise("NO").alias("enabled")).distinct()
    return catalog.engine_merge(support, rollups.engine_sizes(renamed))


@query("engine_merge", f"WITH {ENGINE_MERGE} SELECT * FROM merged")
def engine_merge(t: Tables):
    return merged_engines(t).withColumns({c: F.col(c).cast("bigint") for c in ("total_size", "data_size", "index_size")})


@query("myisam_index_size", f"""WITH {ENGINE_MERGE} SELECT server_id, coalesce(max(index_size) FILTER (WHERE engine = 'MyISAM'), 0) AS myisam_index_size FROM merged GROUP BY server_id""")
def myisam_index_size(t: Tables):
    return catalog.myisam_index_size(merged_engines(t)).withColumn("myisam_index_size", F.col("myisam_index_size").cast("bigint"))


@query("role_membership", """WITH grants AS (SELECT o_custkey AS member, o_custkey % 10 AS server_id,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey * 3 + o_orderkey) % 100 // 10 * 10 + o_custkey % 10 ELSE -1 - o_orderkey END AS roleid FROM orders),
listed AS (SELECT g.member, string_agg(r.c_name, ',' ORDER BY r.c_name) AS member_of FROM grants g JOIN customer r ON r.c_custkey = g.roleid AND r.c_custkey % 10 = g.server_id GROUP BY g.member)
SELECT c_custkey % 10 AS server_id, c_custkey AS oid, c_name AS rolname, c_acctbal < 0 AS rolsuper, c_custkey % 2 = 0 AS rolcanlogin, coalesce(l.member_of, '') AS member_of
FROM customer LEFT JOIN listed l ON l.member = c_custkey""")
def role_membership(t: Tables):
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    roles = t.customer.select((F.col("c_custkey") % 10).alias("server_id"), F.col("c_custkey").alias("oid"), F.col("c_name").alias("rolname"), (F.col("c_acctbal") < 0).alias("rolsuper"),
                              (F.col("c_custkey") % 2 == 0).alias("rolcanlogin"))
    role = F.floor((cust * 3 + order) % 100 / 10) * 10 + cust % 10
    grants = t.orders.select((cust % 10).alias("server_id"), cust.alias("member"), F.when(order % 3 == 0, role).otherwise(-1 - order).alias("roleid"))
    return catalog.role_membership(roles, grants)


@query("open_sections", f"""WITH rows AS (SELECT o_custkey % 50 AS server_id, 'db' || CAST(o_orderkey % 4 AS VARCHAR) AS database,
  ({b.sql_list(catalog.POSTGRES_SECTIONS)})[CAST(o_custkey % 5 AS INTEGER) + 1] AS section FROM orders),
failures AS (SELECT DISTINCT c_custkey % 50 AS server_id, 'db' || CAST(c_nationkey % 4 AS VARCHAR) AS database, CASE WHEN c_acctbal < 2000 THEN ({b.sql_list(catalog.POSTGRES_SECTIONS)})[CAST(c_custkey % 6 AS INTEGER) + 1] ELSE 'another' END AS section
  FROM customer),
expected AS (SELECT DISTINCT server_id, database, section FROM (SELECT server_id, database FROM rows) r, (SELECT unnest({b.sql_list(catalog.POSTGRES_SECTIONS)}) AS section))
SELECT e.server_id, e.database, e.section, count(r.section) AS rows FROM expected e LEFT JOIN rows r USING (server_id, database, section)
WHERE NOT EXISTS (SELECT 1 FROM failures f WHERE f.server_id = e.server_id AND f.database = e.database AND f.section = e.section) GROUP BY ALL""")
def open_sections(t: Tables):
    sections = F.array(*[F.lit(s) for s in catalog.POSTGRES_SECTIONS])
    rows = t.orders.select((F.col("o_custkey") % 50).alias("server_id"), F.concat(F.lit("db"), (F.col("o_orderkey") % 4).cast("string")).alias("database"),
                           sections[(F.col("o_custkey") % 5).cast("int")].alias("section"))
    failures = t.customer.select(
        (F.col("c_custkey") % 50).alias("server_id"), F.concat(F.lit("db"), (F.col("c_nationkey") % 4).cast("string")).alias("database"),
        F.when(F.col("c_acctbal") < 2000, sections[(F.col("c_custkey") % 6).cast("int")]).otherwise("another").alias("section"))
    return catalog.open_sections(rows, failures, rows, catalog.POSTGRES_SECTIONS)


@query("published_rows", f"""WITH rows AS (SELECT o_custkey % 50 AS server_id, 'db' || CAST(o_orderkey % 4 AS VARCHAR) AS database,
  ({b.sql_list(catalog.POSTGRES_SECTIONS)})[CAST(o_custkey % 5 AS INTEGER) + 1] AS section, o_orderkey AS line FROM orders),
failures AS (SELECT c_custkey % 50 AS server_id, 'db' || CAST(c_nationkey % 4 AS VARCHAR) AS database, ({b.sql_list(catalog.POSTGRES_SECTIONS)})[CAST(c_custkey % 6 AS INTEGER) + 1] AS section FROM customer)
SELECT server_id, database, section, line FROM rows WHERE (server_id, database, section) NOT IN (SELECT (server_id, database, section) FROM failures)""")
def published_rows(t: Tables):
    sections = F.array(*[F.lit(s) for s in catalog.POSTGRES_SECTIONS])
    rows = t.orders.select((F.col("o_custkey") % 50).alias("server_id"), F.concat(F.lit("db"), (F.col("o_orderkey") % 4).cast("string")).alias("database"),
                           sections[(F.col("o_custkey") % 5).cast("int")].alias("section"), F.col("o_orderkey").alias("line"))
    failures = t.customer.select(
        (F.col("c_custkey") % 50).alias("server_id"), F.concat(F.lit("db"), (F.col("c_nationkey") % 4).cast("string")).alias("database"),
        sections[(F.col("c_custkey") % 6).cast("int")].alias("section"))
    return catalog.published_rows(rows, failures)


@query("ordered_catalogues", f"WITH {b.TABLE_CATALOG} SELECT server_id, table_schema, table_name, table_type FROM catalog ORDER BY ALL")
def ordered_catalogues(t: Tables):
    return catalog.ordered_catalogue(b.table_catalog(t).select("server_id", "table_schema", "table_name", "table_type"),
                                     ["server_id", "table_schema", "table_name"])


@query("sorted_names", """WITH names AS (SELECT DISTINCT l_suppkey AS server_id, CASE WHEN l_partkey % 3 = 0 THEN 'P_' ELSE 'p_' END || CAST(l_partkey % 50 AS VARCHAR) AS name FROM lineitem)
SELECT server_id, string_agg(name, ',' ORDER BY name) AS names FROM names GROUP BY server_id""")
def sorted_names(t: Tables):
    name = F.concat(F.when(F.col("l_partkey") % 3 == 0, "P_").otherwise("p_"), (F.col("l_partkey") % 50).cast("string"))
    return catalog.sorted_names(t.lineitem.select(F.col("l_suppkey").alias("server_id"), name.alias("name"))).withColumn("names", F.array_join("names", ","))


@query("index_include_columns", f"""WITH {CATALOG}, parts AS (SELECT o_custkey % 10 AS server_id, o_orderkey AS indexrelid, o_custkey AS indrelid, p,
  ([o_custkey % 5 + 1, o_orderkey % 4, o_orderkey % 9 + 1, o_orderkey % 7 + 2])[p] AS attnum FROM orders, (SELECT unnest([1, 2, 3, 4]) AS p)
  WHERE p <= 1 + o_orderkey % 4 AND p > least(1 + o_orderkey % 3, 1 + o_orderkey % 4))
SELECT p.server_id, p.indexrelid, string_agg(a.attname, ',' ORDER BY p.p) AS include_columns FROM parts p
JOIN attributes a ON a.server_id = p.server_id AND a.attrelid = p.indrelid AND a.attnum = p.attnum GROUP BY ALL""")
def index_include_columns(t: Tables):
    result = catalog.index_keys(indexes(t), attributes(t), *sorting(t), namespaces(t))
    return result.filter(F.size("include_columns") > 0).select("server_id", "indexrelid", F.array_join("include_columns", ",").alias("include_columns"))
