"""Readiness of schema changes, of plan requests and of tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import trimmed
from ..operators.ranking import first_failure_stops
from ..operators.skew import lookup

# Exit codes, ratios and defaults.
BAD_INPUT, EMPTY, SYNTAX, NOT_POSSIBLE, NO_RECOVERY, FAILED, DISABLED = 2, 3, 4, 5, 6, 7, 10
MINIMUM_FREE, MAXIMUM_USED = 0.10, 0.90
DEFAULT_BUFFER = 20.0
ROLLBACK_TASK = 8


def _blank(value: Column) -> Column:
    return trimmed(F.coalesce(value, F.lit(""))) == ""


def change_gate(statements: DataFrame, tasks: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """CR1 and W8: exit code and backup kind of each statement, and whether it is reached at all.

    Bad input of one statement spoils its whole task; after the first refused statement none is run.
    """
    keys = list(keys)
    s = statements
    bad = (_blank(F.col("schema_name")) | _blank(F.col("ddl_statement"))
           | (F.col("syntax_valid") & (_blank(F.col("target_schema")) | _blank(F.col("target_table")))))
    wanted = F.col("backup_wanted")
    own = (F.when(~F.col("syntax_valid"), SYNTAX).when(_blank(F.col("engine")), NOT_POSSIBLE)
           .when(~F.col("ok_online") & ~F.col("ok_copy_tool"), NOT_POSSIBLE)
           .when(wanted & ~F.col("ok_recovery"), NO_RECOVERY).otherwise(0))
    # One pass per task: what spoils all of it, and where its own statements stop it.
    facts = s.groupBy(*keys).agg(F.bool_or(bad).alias("_spoiled"), F.min("statement_index").alias("_first"),
                                 F.min(F.when(own != 0, F.col("statement_index"))).alias("_own_stop"))
    whole = F.when(~F.col("enabled"), DISABLED).when(F.col("_spoiled"), BAD_INPUT)
    per_task = facts.join(tasks.select(*keys, "enabled"), keys, "left").select(
        *keys, whole.alias("_whole"), F.when(whole.isNotNull(), F.col("_first")).otherwise(F.col("_own_stop")).alias("_stop"))
    backup = F.when(wanted, F.when(F.col("ok_physical"), "physical").otherwise("logical")).otherwise("none")
    return (lookup(s, per_task, keys).withColumn("exit_code", F.coalesce("_whole", own))
            .withColumn("backup", F.when(F.col("exit_code") == 0, backup))
            .withColumn("run", F.col("_stop").isNull() | (F.col("statement_index") <= F.col("_stop"))).drop("_whole", "_stop"))


def task_gate(statements: DataFrame, gated: DataFrame, tasks: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """CR1: exit code of each task: that of its first refused statement; a task without statements is empty."""
    keys = list(keys)
    first = gated.filter(F.col("exit_code") != 0).groupBy(*keys).agg(F.min_by("exit_code", "statement_index").alias("_code"))
    filled = statements.select(*keys).distinct().withColumn("_filled", F.lit(True))
    code = (F.when(~F.col("enabled"), DISABLED).when(F.col("_filled").isNull(), EMPTY).otherwise(F.coalesce("_code", F.lit(0))))
    return tasks.join(filled, keys, "left").join(first, keys, "left").select(*keys, code.alias("exit_code"))


def datadir_headroom(targets: DataFrame, sizes: DataFrame, filesystems: DataFrame) -> DataFrame:
    """CR2: whether the data file system has room for a second copy of the table; one without a size row is refused."""
    keys = ["server_id", "table_schema", "table_name"]
    size = F.coalesce("data_length", F.lit(0)) + F.coalesce("index_length", F.lit(0))
    joined = lookup(targets.join(sizes.withColumn("_sized", F.lit(True)), keys, "left"), filesystems, ["server_id"])
    free = F.col("free_bytes") / F.col("total_bytes")
    used = (F.col("total_bytes") - F.col("free_bytes") + size) / F.col("total_bytes")
    reason = (F.when(F.col("_sized").isNull(), "unknown-table").when(F.coalesce("total_bytes", F.lit(0)) <= 0, "invalid-filesystem").when(free <= MINIMUM_FREE, "low-free-space")
              .when(used > MAXIMUM_USED, "no-room-for-copy"))
    return joined.select(*keys, reason.alias("reason"))


def backup_headroom(required: DataFrame, filesystems: DataFrame, kind: str, buffer_percent: float = DEFAULT_BUFFER) -> DataFrame:
    """CR3: whether the backup with its buffer fits the free space."""
    size = F.col(f"{kind}_bytes")
    needed = size + F.floor(size.cast("double") * buffer_percent / 100.0)
    return lookup(required, filesystems, ["server_id"]).withColumn("required_bytes", needed).withColumn(
        "fits", F.col("free_bytes") >= F.col("required_bytes"))


def explain_request_check(requests: DataFrame, databases: DataFrame, failed_schemas: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """CR4: exit code of each requested plan; the first code below 6 ends its task, 6 and 7 do not."""
    keys = list(keys)
    known = databases.select("server_id", "schema_name", F.lit(True).alias("_known")).distinct()
    broken = failed_schemas.select("server_id", "schema_name", F.lit(True).alias("_broken")).distinct()
    joined = lookup(lookup(requests, known, ["server_id", "schema_name"]), broken, ["server_id", "schema_name"])
    error = F.col("explain_error")
    code = (F.when(_blank(F.col("schema_name")) | _blank(F.col("query_text")), 3).when(F.col("_known").isNull(), 4)
            .when(F.col("_broken"), 5).when(error.contains("need_grant_permission"), 6).when(error.isNotNull(), 7).otherwise(0))
    coded = joined.withColumn("exit_code", code).drop("_known", "_broken")
    return first_failure_stops(coded, "request_index", F.col("exit_code").between(1, 5), keys)


def explain_task_codes(tasks: DataFrame, checked: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """CR4: exit code of each task: 2 where its document has no readable request, else that of its last failed request reached."""
    keys = list(keys)
    failed = F.col("run") & (F.col("exit_code") != 0)
    codes = checked.groupBy(*keys).agg(F.max_by("exit_code", F.when(failed, F.col("request_index"))).alias("_last"), F.lit(True).alias("_read"))
    code = F.when(F.col("_read").isNull(), BAD_INPUT).otherwise(F.coalesce("_last", F.lit(0)))
    return tasks.select(*keys).distinct().join(codes, keys, "left").select(*keys, code.alias("exit_code"))


def collected_schemas(checked: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """CR4: the schemas collected for a task, each once."""
    reached = checked.filter(F.col("run") & ((F.col("exit_code") == 0) | (F.col("exit_code") > 5)))
    return reached.select(*keys, "schema_name").distinct()


def task_selection(tasks: DataFrame) -> DataFrame:
    """CR5: whether a task can be taken up, and the configuration it selects."""
    details = F.from_json("task_details", "STRUCT<configuration_status_id: INT, _corrupt: STRING>",
                          {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    chosen = F.coalesce(F.col("_d.configuration_status_id"), F.lit(0))
    empty = F.coalesce("task_details", F.lit("")) == ""
    rollback = F.col("task_type_id") == ROLLBACK_TASK
    error = (F.when(F.coalesce("task_id", F.lit(0)) <= 0, "no-task").when(F.coalesce("task_type_id", F.lit(-1)) < 0, "no-task")
             .when(~F.col("apply_mode").isin("dynamic", "full"), "invalid-mode")
             .when(empty & rollback, "selection-required")
             .when(~empty & (F.col("_d").isNull() | F.col("_d._corrupt").isNotNull()), "invalid-details")
             .when(~empty & (chosen < 0), "invalid-selection")
             .when(rollback & (chosen == 0), "selection-required"))
    return tasks.withColumn("_d", details).withColumn("error", error).withColumn(
        "configuration_id", F.when(F.col("error").isNull(), F.when(~empty, chosen).otherwise(0))).drop("_d")
