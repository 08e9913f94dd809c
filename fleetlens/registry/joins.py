"""Queries of the statement and topology joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, rollups
from . import bindings as b
from .base import Tables, query

LATEST = f"""{b.STATEMENT_EVENTS}, latest AS (SELECT server_id, schema_name, digest, arg_max(sql_text, (timer_start, event_id)) AS sql_text
  FROM statement_events WHERE schema_name IS NOT NULL AND digest IS NOT NULL AND sql_text IS NOT NULL GROUP BY ALL)"""


@query("latest_statement_text", f"WITH {LATEST} SELECT * FROM latest")
def latest_statement_text(t: Tables):
    return joins.latest_statement_text(b.statement_events(t))


@query("attach_sample_text", f"""WITH {LATEST}, statements AS (SELECT user_id % 10 AS server_id, 'db' || CAST(user_id % 25 AS VARCHAR) AS schema_name,
  event_type AS query_id, event_id FROM events)
SELECT s.*, coalesce(l.sql_text, '') AS query_text FROM statements s
LEFT JOIN latest l ON l.server_id = s.server_id AND l.schema_name = s.schema_name AND l.digest = s.query_id""")
def attach_sample_text(t: Tables):
    statements = t.events.select((F.col("user_id") % 10).alias("server_id"), F.concat(F.lit("db"), (F.col("user_id") % 25).cast("string")).alias("schema_name"),
                                 F.col("event_type").alias("query_id"), "event_id")
    return joins.attach_sample_text(statements, joins.latest_statement_text(b.statement_events(t)))


@query("digest_summary_fallback", f"""WITH {b.DIGEST_SUMMARY}, texts AS (SELECT server_id, schema_name, digest, arg_max(query_sample_text, (snapshot_id, line)) AS t
  FROM (SELECT server_id, schema_name, digest, snapshot_id, line, max(query_sample_text) AS query_sample_text FROM digests
    WHERE schema_name IS NOT NULL AND digest IS NOT NULL AND query_sample_text IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT d.server_id, d.snapshot_id, d.line, coalesce(d.schema_name, 'NULL') AS schema_name, coalesce(d.digest, 'NULL') AS query_id, d.count_star AS calls,
  CASE WHEN d.server_id % 2 = 0 THEN coalesce(d.query_sample_text, 'NULL') ELSE coalesce(t.t, '') END AS query_text
FROM digests d LEFT JOIN texts t ON t.server_id = d.server_id AND t.schema_name = d.schema_name AND t.digest = d.digest""")
def digest_summary_fallback(t: Tables):
    """A4: servers with the sample-text column beside servers whose texts come from the sampled events."""
    digests = b.digest_summary(t)
    texts = digests.filter("schema_name IS NOT NULL AND digest IS NOT NULL AND query_sample_text IS NOT NULL").groupBy(
        "server_id", "schema_name", "digest", "snapshot_id", "line").agg(F.max("query_sample_text").alias("sql_text")).select(
        "server_id", "schema_name", "digest", "sql_text", F.col("snapshot_id").alias("timer_start"), F.col("line").alias("event_id"))
    modern = rollups.digest_summary_full(digests.filter("server_id % 2 = 0"), b.COUNTERS, b.seconds)
    legacy = rollups.digest_summary_full(digests.filter("server_id % 2 = 1").drop("query_sample_text"), b.COUNTERS, b.seconds).drop("query_text")
    both = modern.unionByName(joins.attach_sample_text(legacy, joins.latest_statement_text(texts)))
    return both.select("server_id", "snapshot_id", "line", "schema_name", "query_id", "calls", "query_text")


TOPOLOGY = """
requested AS (SELECT c_custkey AS instance_id FROM customer),
instances AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey ELSE -1 - o_orderkey END AS instance_id, o_orderkey AS instance_order,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'cl' || CAST(o_custkey % 40 AS VARCHAR) END AS cluster_id,
  CASE o_custkey % 3 WHEN 0 THEN 'aurora-mysql' WHEN 1 THEN 'Aurora' ELSE 'postgres' END AS engine,
  CASE WHEN o_orderkey % 4 = 0 THEN 'db.serverless' ELSE 'db.r5' END AS instance_class,
  'ig' || CAST(o_custkey % 5 AS VARCHAR) AS instance_group, CASE WHEN o_orderkey % 5 = 0 THEN 'applying' ELSE 'in-sync' END AS instance_group_status,
  CASE WHEN o_orderkey % 6 = 0 THEN 'modifying' ELSE 'available' END AS instance_status FROM orders),
clusters AS (SELECT 'cl' || CAST(n_nationkey % 22 AS VARCHAR) AS cluster_id, n_nationkey AS cluster_order,
  CASE WHEN n_nationkey % 2 = 0 THEN 'provisioned' ELSE 'serverless' END AS engine_mode, 'cg' || CAST(n_nationkey % 3 AS VARCHAR) AS cluster_group FROM nation),
members AS (SELECT 'cl' || CAST(o_custkey % 40 AS VARCHAR) AS cluster_id, CASE WHEN o_orderpriority = '2-HIGH' THEN o_custkey ELSE -1 - o_orderkey END AS instance_id, o_orderkey AS member_order, o_orderkey % 2 = 0 AS is_writer,
  CASE WHEN o_orderkey % 3 = 0 THEN 'pending-reboot' ELSE 'in-sync' END AS cluster_group_status FROM orders),
i AS (SELECT instance_id, count(*) AS instance_count, arg_min(struct_pack(cluster_id := cluster_id, engine := engine, instance_class := instance_class,
  instance_group := instance_group, instance_group_status := instance_group_status, instance_status := instance_status), instance_order) AS r FROM instances GROUP BY 1),
c AS (SELECT cluster_id, count(*) AS cluster_count, arg_min(struct_pack(engine_mode := engine_mode, cluster_group := cluster_group), cluster_order) AS r FROM clusters GROUP BY 1),
m AS (SELECT cluster_id, instance_id, count(*) AS member_count, arg_min(struct_pack(is_writer := is_writer, cluster_group_status := cluster_group_status), member_order) AS r
  FROM members GROUP BY 1, 2),
j AS (SELECT q.instance_id, i.r AS ir, c.r AS cr, m.r AS mr, lower(i.r.engine) LIKE 'aurora%' AS aurora, instance_count, cluster_count, member_count
  FROM requested q LEFT JOIN i ON i.instance_id = q.instance_id LEFT JOIN c ON c.cluster_id = i.r.cluster_id
  LEFT JOIN m ON m.cluster_id = i.r.cluster_id AND m.instance_id = q.instance_id),
e AS (SELECT *, CASE WHEN instance_count IS NULL THEN 'instance-not-found' WHEN instance_count > 1 THEN 'several-instances'
  WHEN aurora AND ir.cluster_id IS NULL THEN 'no-cluster-identifier' WHEN aurora AND cluster_count IS NULL THEN 'cluster-not-found'
  WHEN aurora AND cluster_count > 1 THEN 'several-clusters' WHEN aurora AND member_count IS NULL THEN 'not-a-member'
  WHEN aurora AND member_count > 1 THEN 'several-memberships' END AS error FROM j),
topology AS (SELECT instance_id, error, CASE WHEN error IS NULL THEN ir.engine END AS engine, CASE WHEN error IS NULL THEN ir.cluster_id END AS cluster_id,
  CASE WHEN error IS NULL THEN ir.instance_class = 'db.serverless' END AS is_serverless,
  CASE WHEN error IS NULL THEN coalesce(CASE WHEN aurora THEN mr.is_writer END, false) END AS is_cluster_writer,
  CASE WHEN error IS NULL AND aurora THEN cr.engine_mode END AS engine_mode, CASE WHEN error IS NULL AND aurora THEN cr.cluster_group END AS cluster_group,
  CASE WHEN error IS NULL AND aurora THEN mr.cluster_group_status END AS cluster_group_status, CASE WHEN error IS NULL THEN ir.instance_group END AS instance_group,
  CASE WHEN error IS NULL THEN ir.instance_group_status END AS instance_group_status, CASE WHEN error IS NULL THEN ir.instance_status END AS instance_status FROM e)"""


def topology(t: Tables):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    cluster = F.concat(F.lit("cl"), (cust % 40).cast("string"))
    # Most instances and memberships are of no customer, so that those asked for are found once, twice or not at all.
    own = lambda priority: F.when(F.col("o_orderpriority") == priority, cust).otherwise(-1 - order).alias("instance_id")
    instances = t.orders.select(
        own("1-URGENT"), order.alias("instance_order"), F.when(order % 7 != 0, cluster).alias("cluster_id"),
        F.when(cust % 3 == 0, "aurora-mysql").when(cust % 3 == 1, "Aurora").otherwise("postgres").alias("engine"),
        F.when(order % 4 == 0, "db.serverless").otherwise("db.r5").alias("instance_class"), F.concat(F.lit("ig"), (cust % 5).cast("string")).alias("instance_group"),
        F.when(order % 5 == 0, "applying").otherwise("in-sync").alias("instance_group_status"),
        F.when(order % 6 == 0, "modifying").otherwise("available").alias("instance_status"))
    nation = F.col("n_nationkey")
    clusters = t.nation.select(F.concat(F.lit("cl"), (nation % 22).cast("string")).alias("cluster_id"), nation.alias("cluster_order"),
                               F.when(nation % 2 == 0, "provisioned").otherwise("serverless").alias("engine_mode"),
                               F.concat(F.lit("cg"), (nation % 3).cast("string")).alias("cluster_group"))
    members = t.orders.select(
        cluster.alias("cluster_id"), own("2-HIGH"), order.alias("member_order"), (order % 2 == 0).alias("is_writer"),
        F.when(order % 3 == 0, "pending-reboot").otherwise("in-sync").alias("cluster_group_status"))
    return joins.cluster_topology(t.customer.select(F.col("c_custkey").alias("instance_id")), instances, clusters, members)


@query("cluster_topology", f"WITH {TOPOLOGY} SELECT * FROM topology")
def cluster_topology(t: Tables):
    return topology(t)
