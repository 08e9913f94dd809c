"""Configuration plans over the fleet: what would change on each server, how, and why not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import database_type, is_aurora, native_units, parameter_value, trimmed, values_equal
from ..operators.skew import lookup

# Reasons, methods and exit codes of a plan.
IMMEDIATE, PENDING_REBOOT = "immediate", "pending-reboot"
READY, UNAVAILABLE, NOT_IN_SYNC, MISMATCH, CLUSTER_NOT_IN_SYNC, CLUSTER_MISMATCH = 0, 1, 2, 3, 4, 5
FAILURE, DENIED, RESTART = 8, 9, 10
IN_SYNC, AVAILABLE = "in-sync", "available"
READ_ONLY_TEXTS = ("is a read only variable", "innodb_log_file_size must be at least")
DENIED_TEXTS = ("Access denied", "permission denied")


def apply_plan_rds(recommendations: DataFrame, parameters: DataFrame, current: DataFrame, metadata: DataFrame,
                   dynamic_only: bool = False, pending_reboot_only: bool = False) -> DataFrame:
    """CP1 and CP2: scope and outcome of each recommendation, decided by the first rule that applies."""
    keys = ["server_id", "name"]

    def entry(scope: str) -> Column:
        fields = F.struct("apply_type", "is_modifiable", "engine_modes", "value")
        return F.max(F.when(F.col("scope") == scope, fields)).alias(f"_{scope}")
    joined = recommendations.join(parameters.groupBy(*keys).agg(entry("instance"), entry("cluster")), keys, "left")
    joined = joined.join(current.select(*keys, F.col("value").alias("_live"), F.lit(True).alias("_has_live")), keys, "left")
    joined = lookup(joined, metadata.select("server_id", "engine", "engine_mode", "is_cluster_writer"), ["server_id"])
    scope = F.when(F.col("_instance").isNotNull(), "instance").when(F.col("_cluster").isNotNull(), "cluster").otherwise("instance")
    joined = joined.withColumn("scope", scope).withColumn("_p", F.coalesce("_instance", "_cluster"))
    canonical = parameter_value(F.col("name"), F.col("value"))
    joined = joined.withColumn("planned", native_units(database_type(F.col("engine")), F.col("name"), canonical))
    p, name = F.col("_p"), F.col("name")
    modes = F.transform(p["engine_modes"], lambda m: F.lower(m))
    supported = (F.coalesce(F.size(p["engine_modes"]), F.lit(0)) <= 0) | F.array_contains(modes, F.lower(F.coalesce("engine_mode", F.lit(""))))
    stored = parameter_value(name, p["value"])
    live = parameter_value(name, F.col("_live"))
    unchanged = F.when(p["value"].isNotNull(), stored == F.col("planned")).otherwise(
        F.coalesce("_has_live", F.lit(False)) & (live == F.col("planned")))
    kind = F.lower(F.coalesce(p["apply_type"], F.lit("")))
    cluster = F.col("scope") == "cluster"
    reason = (F.when(p.isNull(), "absent")
              .when(cluster & ~F.coalesce(is_aurora(F.col("engine")), F.lit(False)), "cluster-not-supported")
              .when(cluster & ~F.coalesce("is_cluster_writer", F.lit(False)), "not-cluster-writer")
              .when(~F.coalesce(p["is_modifiable"], F.lit(False)), "unmodifiable")
              .when(~supported, "unsupported-engine-mode")
              .when(F.col("planned").isNull(), "invalid-value")
              .when(F.coalesce(unchanged, F.lit(False)), "unchanged")
              .when((kind == "static") & F.lit(dynamic_only), "not-dynamic")
              .when(~kind.isin("dynamic", "static"), "unsupported-apply-type"))
    method = F.when((kind == "dynamic") & ~F.lit(pending_reboot_only), IMMEDIATE).otherwise(PENDING_REBOOT)
    return joined.withColumn("reason", reason).select(
        "server_id", "name", "scope", "reason", F.when(F.col("reason").isNull(), method).alias("method"),
        F.when(F.col("reason").isNull(), F.col("planned")).alias("planned"))


def cluster_lookup_needed(recommendations: DataFrame, parameters: DataFrame, metadata: DataFrame) -> DataFrame:
    """CP3: whether a clustered server has a recommendation that its instance list lacks."""
    listed = parameters.filter(F.col("scope") == "instance").select("server_id", "name").distinct()
    missing = recommendations.select("server_id", "name").join(listed, ["server_id", "name"], "left_anti")
    servers = missing.select("server_id").distinct().withColumn("_missing", F.lit(True))
    return metadata.join(servers, "server_id", "left").select(
        "server_id", (is_aurora(F.col("engine")) & F.coalesce("_missing", F.lit(False))).alias("cluster_lookup"))


def group_mismatch(configured: Column, attached: Column) -> Column:
    """CP4: whether the configured group cannot be changed: empty, provider-owned, or not the attached one."""
    name = F.coalesce(configured, F.lit(""))
    return (name == "") | F.startswith(F.lower(name), F.lit("default.")) | (name != F.coalesce(attached, F.lit("")))


def group_readiness(metadata: DataFrame, lookups: DataFrame) -> DataFrame:
    """CP4: the first reason why the groups of a server cannot be changed, as an exit code."""
    joined = metadata.join(lookups, "server_id", "left")
    aurora = is_aurora(F.col("engine"))
    code = (F.when(F.coalesce("instance_status", F.lit("")) != AVAILABLE, UNAVAILABLE)
            .when(group_mismatch(F.col("configured_group"), F.col("instance_group")), MISMATCH)
            .when(F.coalesce("instance_group_status", F.lit("")) != IN_SYNC, NOT_IN_SYNC)
            .when(aurora & (F.coalesce("cluster_group_status", F.lit("")) != IN_SYNC), CLUSTER_NOT_IN_SYNC)
            .when(F.coalesce("cluster_lookup", F.lit(False)) & group_mismatch(F.col("configured_cluster_group"), F.col("cluster_group")), CLUSTER_MISMATCH)
            .otherwise(READY))
    return joined.select("server_id", code.alias("exit_code"))


def observed_after_apply(planned: DataFrame, listed: DataFrame, states: DataFrame) -> DataFrame:
    """CP5: whether every planned value of a scope is listed exactly and its server and group are ready."""
    keys = ["server_id", "scope"]
    values = listed.select(*keys, "name", F.col("value").alias("_listed"))
    seen = planned.join(values, [*keys, "name"], "left").groupBy(*keys).agg(
        F.bool_and(F.coalesce(F.col("_listed") == F.col("planned"), F.lit(False))).alias("observed"))
    ready = (F.col("status") == AVAILABLE) & F.col("group_status").isin(IN_SYNC, PENDING_REBOOT)
    return seen.join(states, keys, "left").select(
        *keys, "observed", (F.col("observed") & F.coalesce(ready, F.lit(False))).alias("done"),
        (F.col("observed") & (F.col("status") == AVAILABLE) & (F.col("group_status") == "failed")).alias("group_failed"),
        F.coalesce(F.col("group_status") == PENDING_REBOOT, F.lit(False)).alias("needs_reboot"))


def scope_outcomes(modified: DataFrame) -> DataFrame:
    """CP6: success, unresolved or failed for each modified scope after the wait."""
    outcome = (F.when(~F.col("wait_failed"), "success")
               .when(F.col("failed_scope").isNull(), "failed")
               .when(F.col("failed_scope") == F.col("scope"), "failed")
               .when(F.col("unresolved"), "unresolved").otherwise("success"))
    return modified.filter("modified").select("server_id", "scope", outcome.alias("outcome"))


def unknown_names(recommendations: DataFrame, metadata: DataFrame) -> DataFrame:
    """Recommended names that the provider does not know, sorted, per server.

    The list has at most one entry per distinct recommended name.
    """
    known = metadata.select("server_id", "name").distinct()
    unknown = recommendations.select("server_id", "name").distinct().join(known, ["server_id", "name"], "left_anti")
    return unknown.groupBy("server_id").agg(F.array_sort(F.collect_list("name")).alias("unknown"))


def merged_flags(recommendations: DataFrame, flags: DataFrame, live: DataFrame, metadata: DataFrame, dynamic_only: bool = False) -> DataFrame:
    """CP7: the flags to send: changed recommendations win, all other flags are kept.

    In dynamic mode names that need a restart are dropped, and a server with an unknown name is left out.
    """
    keys = ["server_id", "name"]
    wanted = recommendations
    current = flags.select(*keys, F.col("value").alias("_flag"))
    if dynamic_only:
        known = metadata.groupBy(*keys).agg(F.bool_or("requires_restart").alias("_restart"))
        checked = wanted.join(known, keys, "left")
        aborted = checked.filter(F.col("_restart").isNull()).select("server_id").distinct()
        wanted = lookup(checked.filter(~F.col("_restart")).drop("_restart"), aborted, ["server_id"], "left_anti")
        current = lookup(current, aborted, ["server_id"], "left_anti")
    values = live.select(*keys, F.col("value").alias("_live"))
    changed = wanted.join(values, keys, "left").filter(~F.col("value").eqNullSafe(F.col("_live"))).select(*keys, F.col("value").alias("_new"))
    return changed.join(current, keys, "full").select(
        *keys, F.coalesce("_new", "_flag").alias("value"), F.col("_new").isNotNull().alias("changed"))


def apply_plan_azure(recommendations: DataFrame, live: DataFrame, metadata: DataFrame, dynamic_only: bool = False) -> DataFrame:
    """CP8: what happens to each recommendation, by the first rule that applies.

    ``provider_name`` is the provider's spelling, ``stored`` its value, and ``sent`` the value of an update, trimmed.
    """
    values = live.select("server_id", "name", F.col("value").alias("_live"))
    known = metadata.select("server_id", F.lower("name").alias("_key"), F.col("name").alias("_name"), F.col("value").alias("_stored"),
                            "read_only", "dynamic", "pending_restart")
    joined = (recommendations.join(values, ["server_id", "name"], "left").withColumn("_key", F.lower("name"))
              .join(known, ["server_id", "_key"], "left"))
    same = values_equal(F.col("_stored"), F.col("value"))
    action = (F.when(values_equal(F.col("_live"), F.col("value")), "equal")
              .when(F.col("_name").isNull(), "unknown")
              .when(F.col("read_only"), "read-only")
              .when(~F.col("dynamic") & F.lit(dynamic_only), "needs-restart")
              .when(same & F.col("pending_restart"), "pending-restart")
              .when(same, "stored")
              .otherwise("update"))
    restart = (F.col("action") == "pending-restart") | ((F.col("action") == "update") & ~F.col("dynamic"))
    return joined.withColumn("action", action).select(
        "server_id", "name", "action", F.coalesce(restart, F.lit(False)).alias("restart"), F.col("_name").alias("provider_name"),
        F.col("_stored").alias("stored"), F.when(F.col("action") == "update", trimmed(F.col("value"))).alias("sent"))


def azure_exit(plan: DataFrame, restarting: bool) -> DataFrame:
    """CP8: exit code and task status per server, and how many names were passed over; a needed restart that is not made is a failure."""
    needed = F.bool_or("restart")
    action = F.col("action")
    return plan.groupBy("server_id").agg(
        F.count_if(action == "update").alias("updates"), F.count_if(action == "unknown").alias("unknown"),
        F.count_if(action == "read-only").alias("read_only"), needed.alias("restart_required"),
        F.when(needed & ~F.lit(restarting), RESTART).otherwise(0).alias("exit_code"),
        F.when(needed & ~F.lit(restarting), 4).otherwise(1).alias("task_status"))


def apply_plan_local(recommendations: DataFrame, current: DataFrame, servers: DataFrame) -> DataFrame:
    """CP9: the statements that bring a server to its recommendations, with the names each one covers."""
    live = current.select("server_id", "name", F.col("value").alias("_live"))
    text = trimmed(F.col("value"))
    changed = recommendations.join(live, ["server_id", "name"], "left").filter(
        text != F.coalesce(trimmed(F.col("_live")), F.lit("<nil>"))).withColumn("_text", text)
    typed = lookup(changed, servers, ["server_id"])
    mysql = typed.filter(F.col("database_type") != "postgresql").select(
        "server_id", F.concat(F.lit("set global "), F.col("name"), F.lit("="), F.col("_text")).alias("statement"), F.array("name").alias("names"))
    postgres = typed.filter(F.col("database_type") == "postgresql").groupBy("server_id").agg(
        F.lit("SELECT pg_reload_conf()").alias("statement"), F.array_sort(F.collect_list("name")).alias("names"))
    return mysql.unionByName(postgres)


def local_outcome(attempts: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """CP10: exit code and status of a local change by the worst kind of error."""
    message = F.col("error")

    def any_of(parts: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for part in parts:
            found = found | message.contains(part)
        return found
    restart = any_of(READ_ONLY_TEXTS)
    denied = ~restart & any_of(DENIED_TEXTS)
    other = message.isNotNull() & ~restart & ~denied
    code = (F.when(F.bool_or(F.coalesce(other, F.lit(False))), FAILURE).when(F.bool_or(F.coalesce(denied, F.lit(False))), DENIED)
            .when(F.bool_or(F.coalesce(restart, F.lit(False))), RESTART).otherwise(0))
    return attempts.groupBy(*keys).agg(code.alias("exit_code")).withColumn(
        "task_status", F.when(F.col("exit_code").isin(FAILURE, DENIED), 4).otherwise(1))
