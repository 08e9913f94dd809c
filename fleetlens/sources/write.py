"""Routing, redaction and result documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Routes of the report kinds, columns that may leave, and the text put in place of a secret.
CONFIG_ROUTES = {"Set": "db/config/set", "Get": "db/config/get", "GetJson": "db/config/get", "GetInitial": "db/config/initial"}
TASK_ROUTES = {"Get": "tasks/get", "Status": "tasks/status"}
TOPOLOGY_COLUMNS = ["db_instance_identifier", "db_instance_class", "engine", "engine_mode", "db_parameter_group", "db_parameter_group_status",
                    "db_cluster_identifier", "db_cluster_parameter_group", "db_cluster_parameter_group_status", "is_cluster_writer",
                    "is_serverless_v2", "instance_status"]
REDACTED = "***"


# Fixed value: the error of a failed batch of which nothing safe is known.
UNKNOWN_ERROR = "aws-api-error"


def route(mode: Column, kind: Column) -> Column:
    """SNK1: the destination of a report by mode and type; null when there is none."""
    def words(table: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[kind]
    return (F.when(mode == "Configurations", F.coalesce(words(CONFIG_ROUTES), F.lit(CONFIG_ROUTES["Set"])))
            .when(mode == "Metrics", F.when(kind == "Queries", "db/metrics/queries").otherwise("db/metrics"))
            .when(mode == "Event", F.concat(F.lit("events/"), kind))
            .when(mode == "Task", words(TASK_ROUTES))
            .when(mode == "TaskByName", F.concat(F.lit("tasks/by-name/"), kind)))


def route_reports(reports: DataFrame) -> DataFrame:
    """SNK1: reports with route and day, the partitions of the sink."""
    return reports.withColumn("route", F.replace(route(F.col("mode"), F.col("report_type")), F.lit("/"), F.lit("_"))).withColumn(
        "day", F.to_date("collected_at"))


def write_routed(reports: DataFrame, path: str, mode: str = "append") -> None:
    """SNK1: write every report below its route and day.

    Rebalancing puts small routes into one file each and splits a route or day that holds most reports by its size.
    """
    routed = route_reports(reports).hint("rebalance", F.col("route"), F.col("day"))
    routed.write.mode(mode).partitionBy("route", "day").parquet(path)


def write_routed_stream(reports: DataFrame, path: str, checkpoint: str):
    """SNK1 as a stream: one file sink partitioned by route and day.

    The sink's log names the files of finished batches, and readers of ``path`` see no others, so a batch that is killed and
    repeated counts once.
    """
    return (route_reports(reports).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("route", "day").outputMode("append"))


def redact(text: Column, secret: Column) -> Column:
    """SNK2: the text with every occurrence of the secret replaced, taken literally."""
    return F.when(F.coalesce(secret, F.lit("")) == "", text).otherwise(F.replace(text, secret, F.lit(REDACTED)))


def log_reason(text: Column, secret: Column) -> Column:
    """SNK2: a log reason on one line without the secret."""
    return redact(F.regexp_replace(F.btrim(text, F.lit(" \t\n\r\f\u000b")), r"\s+", " "), secret)


def without_secrets(document: Column, secrets: Sequence[str] = ("MysqlPassword", "PgPassword")) -> Column:
    """SNK2: a JSON object without its secret members."""
    fields = F.from_json(document, "map<string,variant>")
    return F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(*secrets)))


def topology_fields(topology: DataFrame) -> DataFrame:
    """SNK2: only the topology columns that may be logged."""
    return topology.select(*[c for c in topology.columns if c in ("server_id", *TOPOLOGY_COLUMNS)])


def write_apply_result(outcomes: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """SNK3: one JSON result per server with explicit empty lists and without any parameter value.

    A list has at most one entry per parameter that the provider knows, or per batch of them. Where the outcomes have an
    ``error``, the failed batch carries it, made safe before; where they have a ``group_name``, each side names its group.
    """
    def of(scope: str, column: str) -> Column:
        return F.max(F.when(F.col("scope") == scope, F.col(column)))

    def names(scope: str, outcome: str) -> Column:
        return F.array_sort(F.collect_list(F.when((F.col("scope") == scope) & (F.col("outcome") == outcome), F.col("name"))))

    def skipped(scope: str) -> Column:
        entry = F.struct("name", "reason")
        return F.array_sort(F.collect_list(F.when((F.col("scope") == scope) & (F.col("outcome") == "skipped"), entry)))

    def side(scope: str) -> Column:
        failed = names(scope, "failed")
        error = F.coalesce(of(scope, "error"), F.lit(UNKNOWN_ERROR)) if "error" in outcomes.columns else F.lit(UNKNOWN_ERROR)
        batch = F.when(F.size(failed) > 0, F.array(F.struct(failed.alias("parameters"), error.alias("error"))))
        empty = F.array().cast("array<struct<parameters:array<string>,error:string>>")
        group = [of(scope, "group_name").alias("group")] if "group_name" in outcomes.columns else []
        return F.struct(*group, names(scope, "applied").alias("applied"), skipped(scope).alias("skipped"), F.coalesce(batch, empty).alias("failed"))
    return outcomes.groupBy(*keys).agg(F.to_json(F.struct(side("instance").alias("instance"), side("cluster").alias("cluster"))).alias("result"))
