"""Joins of statements with their texts and of servers with their cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import is_aurora
from .skew import lookup

SERVERLESS_CLASS = "db.serverless"


def latest_statement_text(events: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """The newest text of each (schema, digest); of equal start times the larger event id decides."""
    known = events.filter(F.col("schema_name").isNotNull() & F.col("digest").isNotNull() & F.col("sql_text").isNotNull())
    return known.groupBy(*keys, "schema_name", "digest").agg(
        F.max_by("sql_text", F.struct("timer_start", "event_id")).alias("sql_text"))


def attach_sample_text(statements: DataFrame, texts: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Statements with their newest text, '' when there is none."""
    samples = texts.select(*keys, "schema_name", F.col("digest").alias("query_id"), F.col("sql_text").alias("query_text"))
    return lookup(statements, samples, [*keys, "schema_name", "query_id"]).withColumn("query_text", F.coalesce("query_text", F.lit("")))


def cluster_topology(requested: DataFrame, instances: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Topology of each requested server, or why it cannot be told.

    Exactly one instance must match; for the clustered engines also one cluster and one membership.
    """
    def single(df: DataFrame, keys: list[str], count: str, order: str) -> DataFrame:
        values = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), F.min_by(F.struct(*values), order).alias(f"{count}_row")).select(
            *keys, count, f"{count}_row.*")
    one = single(instances, ["instance_id"], "instance_count", "instance_order")
    cluster = single(clusters, ["cluster_id"], "cluster_count", "cluster_order")
    member = single(members, ["cluster_id", "instance_id"], "member_count", "member_order")
    joined = lookup(requested.join(one, "instance_id", "left"), cluster, ["cluster_id"]).join(member, ["cluster_id", "instance_id"], "left")
    aurora = is_aurora(F.col("engine"))
    error = (F.when(F.col("instance_count").isNull(), "instance-not-found")
             .when(F.col("instance_count") > 1, "several-instances")
             .when(aurora & (F.coalesce("cluster_id", F.lit("")) == ""), "no-cluster-identifier")
             .when(aurora & F.col("cluster_count").isNull(), "cluster-not-found")
             .when(aurora & (F.col("cluster_count") > 1), "several-clusters")
             .when(aurora & F.col("member_count").isNull(), "not-a-member")
             .when(aurora & (F.col("member_count") > 1), "several-memberships"))

    def clustered(name: str):
        return F.when(aurora & error.isNull(), F.col(name)).alias(name)
    fine = error.isNull()
    return joined.select(
        "instance_id", error.alias("error"), F.when(fine, F.col("engine")).alias("engine"),
        F.when(fine, F.col("cluster_id")).alias("cluster_id"),
        F.when(fine, F.col("instance_class") == SERVERLESS_CLASS).alias("is_serverless"),
        F.when(fine, F.coalesce(F.when(aurora, F.col("is_writer")), F.lit(False))).alias("is_cluster_writer"),
        clustered("engine_mode"), clustered("cluster_group"), clustered("cluster_group_status"),
        F.when(fine, F.col("instance_group")).alias("instance_group"), F.when(fine, F.col("instance_group_status")).alias("instance_group_status"),
        F.when(fine, F.col("instance_status")).alias("instance_status"))
