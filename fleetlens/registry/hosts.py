"""Queries of the host metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hosts
from ..sources import read
from . import bindings as b
from .base import Tables, query
from .sources import host_documents

DAY = 86400


def monitor_points(t: Tables, names: list[str]):
    """Points of the day before their collection at midnight; some values are zero, missing or not finite."""
    event, value = F.col("event_id"), F.col("value")
    metric = F.array(*[F.lit(n) for n in names])[(event % len(names)).cast("int")]
    at = b.seconds("ts")
    return t.events.select(
        F.col("user_id").alias("server_id"), event.alias("point_id"), metric.alias("metric_name"), at.alias("at"), ((F.floor(at / DAY) + 1) * DAY).alias("collected_at"),
        F.when(event % 5 == 0, F.lit(0.0)).when(event % 29 == 0, F.lit(float("nan"))).when(event % 3 != 0, value).alias("double_value"),
        F.when(event % 10 != 0, event % 4).alias("int_value"),
        F.when(event % 4 == 0, value).alias("average"), F.when(event % 4 == 1, value + 1).alias("total"), F.when(event % 3 == 0, value + 2).alias("maximum"), F.when(event % 7 == 0, value + 3).alias("minimum"))


GCP_NAMES = [*hosts.GCP_METRICS.values(), "unknown/metric"]
AZURE_NAMES = [*hosts.AZURE_METRICS.values(), "unknown_metric"]


def points_sql(names, table):
    keys = b.sql_list([*table.keys(), None])
    return f"""
points AS (SELECT user_id AS server_id, event_id AS point_id, ({keys})[CAST(event_id % {len(names)} AS INTEGER) + 1] AS key, CAST(floor(epoch(ts)) AS BIGINT) AS seen,
  (CAST(floor(epoch(ts)) AS BIGINT) // {DAY} + 1) * {DAY} AS collected_at,
  CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE WHEN event_id % 29 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 3 <> 0 THEN value END AS double_value, CASE WHEN event_id % 10 <> 0 THEN event_id % 4 END AS int_value,
  coalesce(CASE WHEN event_id % 4 = 0 THEN value END, CASE WHEN event_id % 4 = 1 THEN value + 1 END, CASE WHEN event_id % 3 = 0 THEN value + 2 END, CASE WHEN event_id % 7 = 0 THEN value + 3 END) AS point
  FROM events),
known AS (SELECT * FROM points WHERE key IS NOT NULL AND seen <= collected_at - 60 AND seen >= collected_at - 60 - 43200)"""


GCP = points_sql(GCP_NAMES, hosts.GCP_METRICS) + """,
newest AS (SELECT server_id, collected_at, key, arg_max(struct_pack(d := double_value, i := int_value), (seen, point_id)) AS p FROM known GROUP BY ALL),
latest AS (SELECT server_id, collected_at, key, CASE WHEN coalesce(p.d, 0) <> 0 THEN p.d WHEN coalesce(p.i, 0) <> 0 THEN CAST(p.i AS DOUBLE) END AS value FROM newest
  WHERE coalesce(p.d, 0) <> 0 OR coalesce(p.i, 0) <> 0)"""
AZURE = points_sql(AZURE_NAMES, hosts.AZURE_METRICS) + """,
latest AS (SELECT server_id, collected_at, key, arg_max(point, (seen, point_id)) AS value FROM known WHERE point IS NOT NULL GROUP BY ALL)"""


def latest_gcp(t: Tables):
    points = hosts.read_monitor_points(monitor_points(t, GCP_NAMES), hosts.GCP_METRICS)
    return hosts.latest_point_gcp(points, ["server_id"], window=43200, delay=60)


def latest_azure(t: Tables):
    points = hosts.read_monitor_points(monitor_points(t, AZURE_NAMES), hosts.AZURE_METRICS)
    return hosts.latest_point_azure(points, ["server_id"], window=43200, delay=60)


@query("read_monitor_points", f"WITH {points_sql(GCP_NAMES, hosts.GCP_METRICS)} SELECT server_id, key, count(*) AS points FROM points WHERE key IS NOT NULL GROUP BY ALL")
def read_monitor_points(t: Tables):
    points = hosts.read_monitor_points(monitor_points(t, GCP_NAMES), hosts.GCP_METRICS)
    return points.groupBy("server_id", "key").agg(F.count(F.lit(1)).alias("points"))


@query("latest_point_gcp", f"WITH {GCP} SELECT server_id, collected_at, key, CAST(value AS VARCHAR) = 'nan' AS is_nan, CASE WHEN NOT isnan(value) THEN value END AS value FROM latest")
def latest_point_gcp(t: Tables):
    return latest_gcp(t).withColumn("is_nan", F.isnan("value")).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query("latest_point_azure", f"WITH {AZURE} SELECT * FROM latest")
def latest_point_azure(t: Tables):
    return latest_azure(t)


def metric(name, default="0.0"):
    value = f"max(value) FILTER (WHERE key = '{name}')"
    return f"coalesce(CASE WHEN NOT isnan({value}) AND NOT isinf({value}) THEN {value} END, {default}::DOUBLE)"


def whole(name, default="0.0"):
    return f"CAST(trunc({metric(name, default)}) AS BIGINT)"


GCP_HOST = f"""{GCP}, gcp AS (SELECT server_id, collected_at, {metric('database.uptime')} AS uptime, {metric('cpu.utilization')} AS cpu_utilization, {metric('cpu.usage_time')} AS cpu_usage,
  {metric('cpu.reserved_cores')} AS cpu_total, {metric('disk.read_ops')} AS iop_read, {metric('disk.write_ops')} AS iop_write, {whole('disk.bytes_used')} AS disk_used, {whole('disk.quota')} AS disk_total,
  {metric('disk.utilization')} AS disk_percent, {whole('memory.quota', '1073741824')} AS memory_total, {whole('memory.usage')} AS memory_used, {metric('memory.utilization')} AS memory_utilization,
  {metric('network.received_bytes')} AS network_rx, {metric('network.sent_bytes')} AS network_tx, {metric('memory.quota', '1073741824')} AS swap_total, {metric('swap.usage')} AS swap_used
  FROM latest GROUP BY server_id, collected_at)"""


def gcp_hosts(t: Tables):
    instances = t.customer.select(F.col("c_custkey").alias("server_id"), F.when(F.col("c_nationkey") % 2 == 0, "POSTGRES_15").when(F.col("c_nationkey") % 5 != 0, "MYSQL_8_0").alias("database_version"))
    return hosts.host_shape_gcp(latest_gcp(t), instances, ["server_id"])


@query("host_shape_gcp", f"""WITH {GCP_HOST} SELECT g.*, CASE WHEN c_nationkey % 2 = 0 THEN 'POSTGRES_15' WHEN c_nationkey % 5 <> 0 THEN 'MYSQL_8_0' END AS database_version,
  CASE WHEN c_nationkey % 2 = 0 THEN 'PostgreSQL' ELSE 'MySQL' END AS engine FROM gcp g LEFT JOIN customer ON c_custkey = server_id""")
def host_shape_gcp(t: Tables):
    return gcp_hosts(t)


AZURE_HOST = f"""{AZURE}, wide AS (SELECT server_id, collected_at, {metric('database.uptime')} AS uptime, {metric('cpu.utilization')} AS cpu_utilization, {metric('disk.io_count')} AS iop_read, 0.0::DOUBLE AS iop_write,
  {whole('disk.bytes_used')} AS disk_used, {whole('disk.quota')} AS quota, {metric('disk.utilization')} AS disk_percent, {metric('memory.utilization')} AS memory_utilization,
  {metric('network.received_bytes')} AS network_rx, {metric('network.sent_bytes')} AS network_tx FROM latest GROUP BY server_id, collected_at),
azure AS (SELECT * EXCLUDE (quota), CASE WHEN c_nationkey % 3 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS storage_size_gb,
  CASE WHEN quota = 0 AND c_nationkey % 3 <> 0 AND c_nationkey > 0 THEN CAST(c_nationkey AS BIGINT) * 1073741824 ELSE quota END AS disk_total, 'MySQL' AS engine
  FROM wide LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer) ON c_custkey = server_id)"""


def azure_hosts(t: Tables):
    instances = t.customer.select(F.col("c_custkey").alias("server_id"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey").cast("bigint")).alias("storage_size_gb"))
    return hosts.host_shape_azure(latest_azure(t), instances, ["server_id"])


@query("host_shape_azure", f"WITH {AZURE_HOST} SELECT * EXCLUDE (c_custkey, c_nationkey) FROM azure")
def host_shape_azure(t: Tables):
    return azure_hosts(t)


UNIFIED = ["server_id", "collected_at", "cpu_total", "iop_read", "iop_write", "memory_total", "swap_total", "disk_total"]


@query("unify_hosts", f"""WITH {GCP_HOST}, {AZURE_HOST.replace('points AS', 'azure_points AS').replace('FROM points', 'FROM azure_points').replace('known AS', 'azure_known AS').replace('FROM known', 'FROM azure_known').replace('latest AS', 'azure_latest AS').replace('FROM latest', 'FROM azure_latest')},
rds AS (SELECT user_id AS server_id, CAST(floor(epoch(ts)) AS BIGINT) AS collected_at, CAST(user_id % 8 + 1 AS DOUBLE) AS cpu_total, 0.0::DOUBLE + CAST(event_id % 50 AS DOUBLE) + value AS iop_read, 3.5::DOUBLE AS iop_write,
  event_id * 1024 AS memory_total, CAST(event_id * 10 AS DOUBLE) AS swap_total FROM events WHERE event_id % 10 <> 3),
loc AS (SELECT c_custkey AS server_id, 0 AS collected_at, CAST(c_nationkey + 1 AS DOUBLE) AS cpu_total, CAST(c_custkey AS DOUBLE) AS iop_read, CAST(c_custkey * 2 AS DOUBLE) AS iop_write,
  CAST(c_nationkey AS BIGINT) * 1073741824 AS memory_total, 0.0::DOUBLE AS swap_total, CAST(NULL AS BIGINT) AS disk_total FROM customer)
SELECT server_id, collected_at, cpu_total, iop_read, iop_write, memory_total, swap_total, disk_total, 'local' AS provider FROM loc
UNION ALL SELECT server_id, collected_at, cpu_total, iop_read, iop_write, memory_total, swap_total, NULL, 'aws/rds' FROM rds
UNION ALL SELECT server_id, collected_at, cpu_total, iop_read, iop_write, memory_total, swap_total, disk_total, 'gcp/cloudsql' FROM gcp
UNION ALL SELECT server_id, collected_at, NULL, iop_read, iop_write, NULL, NULL, disk_total, 'azure/mysql' FROM azure""")
def unify_hosts(t: Tables):
    key = F.col("c_custkey")
    local = t.customer.select(key.alias("server_id"), F.lit(0).cast("bigint").alias("collected_at"), (F.col("c_nationkey") + 1).cast("double").alias("cpu_total"),
                              key.cast("double").alias("iop_read"), (key * 2).cast("double").alias("iop_write"),
                              (F.col("c_nationkey").cast("bigint") * 1073741824).alias("memory_total"), F.lit(0.0).alias("swap_total"))
    rds = hosts.host_shape_rds(read.parse_host_json(host_documents(t)).filter("error IS NULL"), ["server_id"])
    return hosts.unify_hosts({"local": local, "aws/rds": rds, "gcp/cloudsql": gcp_hosts(t), "azure/mysql": azure_hosts(t)}, UNIFIED)


@query("host_shape_rds", """SELECT user_id AS server_id, event_id, CAST(user_id % 8 + 1 AS DOUBLE) AS cpu_total, 0.0::DOUBLE + CAST(event_id % 50 AS DOUBLE) + value AS iop_read, 3.5::DOUBLE AS iop_write,
  event_id * 1024 AS memory_total, CAST(event_id * 10 AS DOUBLE) AS swap_total, '1 day' AS uptime_text FROM events WHERE event_id % 10 <> 3""")
def host_shape_rds(t: Tables):
    documents = host_documents(t).withColumn("collected_at", F.col("event_id"))
    return hosts.host_shape_rds(read.parse_host_json(documents).filter("error IS NULL"), ["server_id"]).withColumnRenamed("collected_at", "event_id")


@query("size_class", """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0::HUGEINT WHEN o_orderkey % 13 = 0 THEN 18446744073709551615::HUGEINT ELSE CAST(o_custkey + 1 AS HUGEINT) * 1000000 END AS ram,
  o_orderkey * 7 % 30000 AS tables, CAST(floor(o_totalprice) AS HUGEINT) * 20000 AS size FROM orders),
c AS (SELECT *, ram > 0 AND tables > 10000 AND ram * 4 <= 18446744073709551615 AND size > ram * 4 AS large FROM s)
SELECT o_orderkey, large, CASE WHEN large THEN 604800 ELSE 42900 END AS ttl_seconds FROM c""")
def size_class(t: Tables):
    order = F.col("o_orderkey")
    ram = (F.when(order % 11 == 0, F.lit(0).cast("decimal(20,0)")).when(order % 13 == 0, F.lit("18446744073709551615").cast("decimal(20,0)"))
           .otherwise(((F.col("o_custkey") + 1) * 1000000).cast("decimal(20,0)")))
    size = (F.floor("o_totalprice") * 20000).cast("decimal(20,0)")
    return t.orders.select("o_orderkey", hosts.size_class(ram, order * 7 % 30000, size).alias("c")).select("o_orderkey", "c.*")
