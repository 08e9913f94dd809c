"""Host metrics of the providers in one shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.normalize import MAX_UNSIGNED, WIDE

# Short metric keys and the providers' names for them.
GCP_METRICS = {
    "cpu.reserved_cores": "cloudsql.googleapis.com/database/cpu/reserved_cores",
    "cpu.utilization": "cloudsql.googleapis.com/database/cpu/utilization",
    "memory.quota": "cloudsql.googleapis.com/database/memory/quota",
    "memory.total_usage": "cloudsql.googleapis.com/database/memory/total_usage",
    "memory.usage": "cloudsql.googleapis.com/database/memory/usage",
    "memory.utilization": "cloudsql.googleapis.com/database/memory/utilization",
    "swap.usage": "cloudsql.googleapis.com/database/swap/bytes_used",
    "disk.read_ops": "cloudsql.googleapis.com/database/disk/read_ops_count",
    "disk.write_ops": "cloudsql.googleapis.com/database/disk/write_ops_count",
    "disk.read_bytes": "cloudsql.googleapis.com/database/disk/read_bytes_count",
    "disk.write_bytes": "cloudsql.googleapis.com/database/disk/write_bytes_count",
    "disk.bytes_used": "cloudsql.googleapis.com/database/disk/bytes_used",
    "disk.quota": "cloudsql.googleapis.com/database/disk/quota",
    "disk.utilization": "cloudsql.googleapis.com/database/disk/utilization",
    "network.received_bytes": "cloudsql.googleapis.com/database/network/received_bytes_count",
    "network.sent_bytes": "cloudsql.googleapis.com/database/network/sent_bytes_count",
    "database.uptime": "cloudsql.googleapis.com/database/uptime",
}
AZURE_METRICS = {
    "cpu.utilization": "cpu_percent",
    "memory.utilization": "memory_percent",
    "disk.bytes_used": "storage_used",
    "disk.quota": "storage_limit",
    "disk.utilization": "storage_percent",
    "disk.io_count": "storage_io_count",
    "disk.io_utilization": "io_consumption_percent",
    "network.received_bytes": "network_bytes_ingress",
    "network.sent_bytes": "network_bytes_egress",
    "database.uptime": "Uptime",
}
DEFAULT_MEMORY = 1073741824
GCP_WINDOW, GCP_DELAY, AZURE_WINDOW, AZURE_DELAY = 300, 1, 600, 60
# Lifetimes of a table-size snapshot and limits of a large server.
ORDINARY_TTL, LARGE_TTL, LARGE_TABLES, LARGE_RAM_FACTOR = 42900, 604800, 10000, 4


def read_monitor_points(points: DataFrame, names: dict[str, str]) -> DataFrame:
    """SRC6: provider points under the short metric key; unknown names are left out. The key table is a constant."""
    table = F.create_map(*[F.lit(x) for key, name in names.items() for x in (name, key)])
    return points.withColumn("key", table[F.col("metric_name")]).filter(F.col("key").isNotNull()).drop("metric_name")


def latest_point_gcp(points: DataFrame, keys: Sequence[str], window: int = GCP_WINDOW, delay: int = GCP_DELAY) -> DataFrame:
    """T4: the newest point of each metric in the window before collection; a zero counts as missing."""
    end = F.col("collected_at") - delay
    recent = points.filter((F.col("at") <= end) & (F.col("at") >= end - window))
    value = F.struct("double_value", "int_value")
    newest = recent.groupBy(*keys, "collected_at", "key").agg(F.max_by(value, F.struct("at", "point_id")).alias("_p"))
    number = (F.when(F.coalesce("_p.double_value", F.lit(0.0)) != 0, F.col("_p.double_value"))
              .when(F.coalesce("_p.int_value", F.lit(0)) != 0, F.col("_p.int_value").cast("double")))
    return newest.withColumn("value", number).filter(F.col("value").isNotNull()).drop("_p")


def latest_point_azure(points: DataFrame, keys: Sequence[str], window: int = AZURE_WINDOW, delay: int = AZURE_DELAY) -> DataFrame:
    """T4: the newest point with any value; average, total, maximum and minimum are tried in this order."""
    end = F.col("collected_at") - delay
    value = F.coalesce("average", "total", "maximum", "minimum")
    recent = points.filter((F.col("at") <= end) & (F.col("at") >= end - window) & value.isNotNull())
    return recent.groupBy(*keys, "collected_at", "key").agg(F.max_by(value, F.struct("at", "point_id")).alias("value"))


def _metric(name: str, default: float = 0.0) -> Column:
    value = F.max(F.when(F.col("key") == name, F.col("value")))
    usable = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.coalesce(F.when(usable, value), F.lit(float(default)))


def _whole(name: str, default: float = 0.0) -> Column:
    value = _metric(name, default)
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))


def host_shape_gcp(latest: DataFrame, instances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One wide host row per server and collection; missing metrics have their defaults."""
    wide = latest.groupBy(*keys, "collected_at").agg(
        _metric("database.uptime").alias("uptime"), _metric("cpu.utilization").alias("cpu_utilization"),
        _metric("cpu.usage_time").alias("cpu_usage"), _metric("cpu.reserved_cores").alias("cpu_total"),
        _metric("disk.read_ops").alias("iop_read"), _metric("disk.write_ops").alias("iop_write"),
        _whole("disk.bytes_used").alias("disk_used"), _whole("disk.quota").alias("disk_total"), _metric("disk.utilization").alias("disk_percent"),
        _whole("memory.quota", DEFAULT_MEMORY).alias("memory_total"), _whole("memory.usage").alias("memory_used"),
        _metric("memory.utilization").alias("memory_utilization"), _metric("network.received_bytes").alias("network_rx"),
        _metric("network.sent_bytes").alias("network_tx"), _metric("memory.quota", DEFAULT_MEMORY).alias("swap_total"), _metric("swap.usage").alias("swap_used"))
    engine = F.when(F.lower(F.coalesce("database_version", F.lit(""))).contains("postgres"), "PostgreSQL").otherwise("MySQL")
    return wide.join(instances, list(keys), "left").withColumn("engine", engine)


def host_shape_azure(latest: DataFrame, instances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As above; the disk total falls back to the provisioned size, and only one disk counter exists."""
    wide = latest.groupBy(*keys, "collected_at").agg(
        _metric("database.uptime").alias("uptime"), _metric("cpu.utilization").alias("cpu_utilization"), _metric("disk.io_count").alias("iop_read"),
        F.lit(0.0).alias("iop_write"), _whole("disk.bytes_used").alias("disk_used"), _whole("disk.quota").alias("_quota"), _metric("disk.utilization").alias("disk_percent"),
        _metric("memory.utilization").alias("memory_utilization"), _metric("network.received_bytes").alias("network_rx"), _metric("network.sent_bytes").alias("network_tx"))
    provisioned = F.coalesce("storage_size_gb", F.lit(0)).cast("bigint") * F.lit(1073741824)
    return (wide.join(instances, list(keys), "left")
            .withColumn("disk_total", F.when((F.col("_quota") == 0) & (provisioned > 0), provisioned).otherwise(F.col("_quota")))
            .withColumn("engine", F.lit("MySQL")).drop("_quota"))


def host_shape_rds(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parsed host document as a host row; sizes stay in KiB as the provider sends them."""
    host = F.col("host")

    def total(field: str) -> Column:
        return F.aggregate(F.coalesce(host["diskIO"], F.array()), F.lit(0.0), lambda acc, d: acc + F.coalesce(d[field], F.lit(0.0)))
    return documents.select(
        *keys, "collected_at", host["uptime"].alias("uptime_text"), host["numVCPUs"].cast("double").alias("cpu_total"),
        total("readIOsPS").alias("iop_read"), total("writeIOsPS").alias("iop_write"),
        host["memory"]["total"].alias("memory_total"), host["swap"]["total"].alias("swap_total"))


def unify_hosts(hosts: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Host rows of all providers in one shape; what a provider does not send is missing."""
    result = None
    for provider, rows in hosts.items():
        shaped = rows.select(*[c for c in columns if c in rows.columns]).withColumn("provider", F.lit(provider))
        result = shaped if result is None else result.unionByName(shaped, allowMissingColumns=True)
    return result


def is_large(ram: Column, tables: Column, size: Column, threshold: int = LARGE_TABLES, factor: int = LARGE_RAM_FACTOR) -> Column:
    """ST4: many tables and much more data than memory; a limit beyond 64 bits is never passed."""
    limit = ram.cast(DecimalType(20, 0)) * F.lit(factor).cast(DecimalType(17, 0))
    fits = limit <= F.lit(MAX_UNSIGNED).cast(WIDE)
    return F.coalesce((ram > 0) & F.lit(threshold >= 0 and factor >= 0) & (tables > threshold) & fits & (size.cast(WIDE) > limit), F.lit(False))


def size_class(ram: Column, tables: Column, size: Column, threshold: int = LARGE_TABLES, factor: int = LARGE_RAM_FACTOR,
               ttl: int = LARGE_TTL) -> Column:
    """ST4: the class and lifetime of a table-size snapshot."""
    large = is_large(ram, tables, size, threshold, factor)
    return F.struct(large.alias("large"), F.when(large, ttl).otherwise(ORDINARY_TTL).alias("ttl_seconds"))
