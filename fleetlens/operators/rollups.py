"""Aggregations over collected telemetry. All aggregates are mergeable, so hot keys shrink before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from ..functions.normalize import (UNSIGNED, null_marker, saturated, statement_identity,
                                   timer_to_us)
from .skew import lookup, running_total

# Byte limits tried one after the other, and the total that one process list may take.
TEXT_LIMITS = [65536, 32768, 16384, 8192, 4096, 2048, 1024, 512, 256, 128, 64]
TEXT_BUDGET = 32 * 1024 * 1024
CONNECTION_SECTION = "__database_connection__"
# Seconds between two text samples by the number of enabled consumers.
SAMPLE_PERIODS = {"two_or_more": 10, "one": 1, "none": 600}
# Size factors of the two backup kinds and the size in MiB assumed for an empty table.
LOGICAL_FACTOR, PHYSICAL_FACTOR, EMPTY_MIB = 2.0, 1.2, 0.1
MIB = 1024 * 1024
EXACT_TIME = DecimalType(28, 6)


def snapshot_keys(rows: DataFrame, keys: Sequence[str] | None) -> list[str]:
    """The given keys, or the server and, where the rows carry it, the time of their snapshot, so that snapshots do not add up."""
    return list(keys) if keys is not None else [c for c in ("server_id", "collected_at") if c in rows.columns]


def statement_rollup(stats: DataFrame, databases: DataFrame, timing: str = "total_exec_time",
                     has_toplevel: bool = True, keys: Sequence[str] | None = None) -> DataFrame:
    """A1: calls, total and mean time per statement identity, roles merged, times in microseconds."""
    return _rollup(stats, databases, timing, has_toplevel, keys, [])


def statement_rollup_full(stats: DataFrame, databases: DataFrame, timing: str = "total_exec_time",
                          has_toplevel: bool = True, has_rows: bool = True,
                          keys: Sequence[str] | None = None, with_text: bool = True) -> DataFrame:
    """A2: the rollup with the statement text and the number of rows; 0 rows where the server has no such counter.

    ``with_text=False`` leaves the texts out of the aggregation, for jobs that need those of a few statements: ``with_texts``.
    """
    rows = F.sum("rows") if has_rows else F.lit(0).cast("bigint")
    text = [F.min("query").alias("query")] if with_text else []
    return _rollup(stats, databases, timing, has_toplevel, keys, [*text, rows.alias("rows")])


def with_texts(statements: DataFrame, stats: DataFrame, has_toplevel: bool = True, keys: Sequence[str] | None = None) -> DataFrame:
    """A2: the texts of some statements, read again for these only.

    Where roles have different texts the smallest is taken; of equal ones one crosses the shuffle per task.
    """
    keys = snapshot_keys(stats, keys)
    wanted = statements.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "dbid", "pg_queryid", "toplevel")])
    level = F.col("toplevel") if has_toplevel else F.lit(None).cast("boolean")
    rows = stats.select(*keys, "dbid", "queryid", level.alias("toplevel"), "query")
    same = F.col("queryid") == F.col("_pg_queryid")
    for c in (*keys, "dbid", "toplevel"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = rows.join(wanted, same, "left_semi").groupBy(*keys, "dbid", "queryid", "toplevel").agg(F.array_min(F.collect_set("query")).alias("query"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "dbid", "toplevel")], F.col("queryid").alias("_pg_queryid"), "query")
    back = F.col("pg_queryid") == F.col("_pg_queryid")
    for c in (*keys, "dbid", "toplevel"):
        back = back & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return statements.join(found, back, "left").drop("_pg_queryid", *[f"_{c}" for c in (*keys, "dbid", "toplevel")])


def _rollup(stats: DataFrame, databases: DataFrame, timing: str, has_toplevel: bool, keys: Sequence[str] | None,
            extra: list[Column]) -> DataFrame:
    keys = snapshot_keys(stats, keys)
    level = F.col("toplevel") if has_toplevel else F.lit(None).cast("boolean")
    time = F.col(timing)
    if isinstance(stats.schema[timing].dataType, (DoubleType, FloatType)):
        time = time.cast(EXACT_TIME)  # a sum of doubles would depend on the order of the rows
    total, calls = F.col("_time").cast("double"), F.col("calls").cast("double")
    sums = (stats.filter(F.col("queryid").isNotNull())
            .withColumn("toplevel", level)
            .groupBy(*keys, "dbid", "queryid", "toplevel")
            .agg(F.sum("calls").alias("calls"), F.sum(time).alias("_time"), *extra))
    named = database_names(sums, databases, [k for k in keys if k in databases.columns])
    return (named.withColumn("total_exec_time_us", total * 1000.0)
            .withColumn("mean_exec_time_us", F.coalesce(total / F.when(calls != 0, calls), F.lit(0.0)) * 1000.0)
            .withColumn("pg_queryid", F.col("queryid"))
            .withColumn("queryid", statement_identity(F.col("dbid"), F.col("pg_queryid"), F.col("toplevel")))
            .drop("_time"))


def database_names(statements: DataFrame, databases: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The database name of each statement, the marker when it is unknown."""
    keys = snapshot_keys(databases, keys)
    names = databases.groupBy(*keys, F.col("oid").alias("dbid")).agg(F.min("datname").alias("datname"))
    return (lookup(statements, names, [*keys, "dbid"])
            .withColumn("datname", F.coalesce("datname", F.lit("NULL"))))


def digest_summary_light(digests: DataFrame) -> DataFrame:
    """A3: the short statement list of one snapshot."""
    return digests.select(
        "server_id", "snapshot_id", "line",
        null_marker(F.col("schema_name")).alias("schema_name"),
        null_marker(F.col("digest")).alias("query_id"),
        F.col("count_star").alias("calls"),
        timer_to_us(F.col("avg_timer_wait")).alias("avg_time_us"),
        timer_to_us(F.col("sum_timer_wait")).alias("sum_time_us"),
    )


def digest_summary_full(digests: DataFrame, counters: Sequence[str], seconds) -> DataFrame:
    """A4: the long statement list: text, times, counters, first and last time seen in seconds."""
    text = F.col("query_sample_text") if "query_sample_text" in digests.columns else F.lit(None).cast("string")
    return digests.select(
        "server_id", "snapshot_id", "line",
        null_marker(F.col("schema_name")).alias("schema_name"),
        null_marker(F.col("digest")).alias("query_id"),
        null_marker(F.col("digest_text")).alias("query"),
        null_marker(text).alias("query_text"),
        F.col("count_star").alias("calls"),
        timer_to_us(F.col("avg_timer_wait")).alias("avg_time_us"),
        timer_to_us(F.col("sum_timer_wait")).alias("sum_time_us"),
        *[F.col(c) for c in counters],
        seconds("first_seen").cast("double").alias("FIRST_SEEN"),
        seconds("last_seen").cast("double").alias("LAST_SEEN"),
    )


def engine_sizes(catalog: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A5: number and size of tables per engine; a table without one of its sizes counts for the other only."""
    keys = snapshot_keys(catalog, keys)
    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column.cast(UNSIGNED)), F.lit(0).cast(UNSIGNED)).cast(UNSIGNED)
    return catalog.filter(F.col("engine").isNotNull()).groupBy(*keys, "engine").agg(
        F.count("engine").alias("tables"),
        total(F.col("data_length") + F.col("index_length")).alias("total_size"),
        total(F.col("data_length")).alias("data_size"),
        total(F.col("index_length")).alias("index_size"),
    )


def table_type_sizes(catalog: DataFrame, size: Column, keys: Sequence[str] | None = None) -> DataFrame:
    """Number and size of tables per table type, without the system schemas."""
    keys = snapshot_keys(catalog, keys)
    users = catalog.filter(~F.col("table_schema").isin("information_schema", "pg_catalog"))
    return users.groupBy(*keys, "table_type").agg(
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum(size.cast(UNSIGNED)), F.lit(0).cast(UNSIGNED)).cast(UNSIGNED).alias("total_size"),
    )


def size_totals(sizes: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Table count and total size of a server; the size saturates."""
    keys = snapshot_keys(sizes, keys)
    return sizes.groupBy(*keys).agg(
        F.sum("tables").alias("tables"),
        saturated(F.sum(F.col("total_size").cast(UNSIGNED))).alias("total_size"),
    )


def schema_list(catalog: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The schemas of a server."""
    keys = snapshot_keys(catalog, keys)
    return catalog.select(*keys, "table_schema").distinct()


def row_count(rows: DataFrame, name: str, keys: Sequence[str] | None = None) -> DataFrame:
    """The number of rows (tables, statements) of a server."""
    keys = snapshot_keys(rows, keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def iops_total(devices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reads and writes over all devices; a local device mounted several times counts once, every cloud row counts."""
    local = F.coalesce(F.col("provider") == "local", F.lit(False))
    # One group per local device and one per server for the rest, so the least is of copies of one local device only.
    once = devices.groupBy(*keys, local.alias("_local"), F.when(local, F.col("device")).alias("_device")).agg(
        *[F.when(F.col("_local"), F.min(c)).otherwise(F.sum(c)).alias(c) for c in ("reads", "writes")])
    return once.groupBy(*keys).agg(F.sum("reads").alias("iop_read"), F.sum("writes").alias("iop_write"))


def text_budget(processes: DataFrame, keys: Sequence[str], info: str = "info", budget: int = TEXT_BUDGET,
                limits: Sequence[int] = tuple(TEXT_LIMITS)) -> DataFrame:
    """A10: process texts as bytes, cut to the first limit at which the snapshot fits the budget, else the last one."""
    text = F.encode(F.coalesce(F.col(info), F.lit("NULL")), "UTF-8")
    size = F.octet_length(text)
    marked = processes.withColumn("_size", size.cast("bigint"))
    totals = marked.groupBy(*keys).agg(
        F.sum("_size").alias("_whole"),
        *[F.sum(F.least("_size", F.lit(n).cast("bigint"))).alias(f"_at_{n}") for n in limits])
    choice = F.when(F.col("_whole") <= budget, F.lit(None).cast("int"))
    for n in limits:
        choice = choice.when(F.col(f"_at_{n}") <= budget, F.lit(n))
    chosen = totals.select(*keys, choice.otherwise(F.lit(limits[-1])).alias("byte_limit"))
    cut = F.when(F.col("byte_limit").isNull(), text).otherwise(F.substring(text, F.lit(1), F.col("byte_limit")))
    return lookup(marked.drop("_size"), chosen, keys).withColumn("info_bytes", cut).drop(info)


def section_failures(failures: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The distinct failed sections of a server with their place by first failure.

    A failed connection is named after its database.
    """
    keys = snapshot_keys(failures, keys)
    section = F.when(F.col("section") == CONNECTION_SECTION, F.concat(F.col("database"), F.lit(":"), F.col("section")))
    first = (failures.withColumn("section", F.coalesce(section, F.col("section")))
             .groupBy(*keys, "section").agg(F.min("ordinal").alias("first_ordinal")))
    ordered = F.array_sort(F.collect_list(F.struct("first_ordinal", "section")))
    return first.groupBy(*keys).agg(F.transform(ordered, lambda x: x["section"]).alias("failed_sections"))


def consumer_strategy(consumers: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Enabled statement consumers and the sample period that follows."""
    keys = snapshot_keys(consumers, keys)
    counted = (F.col("enabled") == "YES") & F.col("name").like("events_statements_%") & (F.col("name") != "events_statements_cpu")
    count = F.col("enabled_consumers")
    return consumers.groupBy(*keys).agg(F.count_if(counted).alias("enabled_consumers")).withColumn(
        "period_seconds",
        F.when(count >= 2, SAMPLE_PERIODS["two_or_more"]).when(count > 0, SAMPLE_PERIODS["one"]).otherwise(SAMPLE_PERIODS["none"]))


def plan_error_counts(attempts: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Plan attempts per outcome class."""
    keys = snapshot_keys(attempts, keys)
    return attempts.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("attempts"))


def stage_durations(stages: DataFrame) -> DataFrame:
    """Number, total and longest duration per stage and status."""
    return stages.groupBy("stage", "status").agg(
        F.count(F.lit(1)).alias("stages"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def last_stage(stages: DataFrame) -> DataFrame:
    """The stage that each statement of a task reached last."""
    return stages.groupBy("task_id", "statement_index").agg(
        F.max_by(F.struct("stage", "status"), F.struct("logged_at", "stage", "status")).alias("_last")).select(
        "task_id", "statement_index", F.col("_last.stage").alias("stage"), F.col("_last.status").alias("status"))


def rls_enabled(classes: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Whether any user table has row security."""
    keys = snapshot_keys(classes, keys)
    user = F.col("relkind").isin("r", "p") & ~F.col("nspname").isin("pg_catalog", "information_schema")
    return classes.groupBy(*keys).agg(F.coalesce(F.bool_or(user & F.col("relrowsecurity")), F.lit(False)).alias("rls_enabled"))


def public_privileges(usage: Column, create: Column) -> Column:
    """The privileges granted on the public schema."""
    return F.concat_ws(",", F.when(usage, "USAGE"), F.when(create, "CREATE"))


def bytes_required(catalog: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Estimated bytes of a logical backup of each table and a physical backup of its schema."""
    keys = snapshot_keys(catalog, keys)
    def estimate(total: Column, factor: float) -> Column:
        mib = F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(EMPTY_MIB)).otherwise(total.cast("double") * factor / MIB)
        return F.floor(mib * MIB)
    table = F.coalesce(F.col("data_length"), F.lit(0)) + F.coalesce(F.col("index_length"), F.lit(0))
    schemas = catalog.groupBy(*keys, "table_schema").agg(
        F.sum(F.col("data_length") + F.col("index_length")).alias("_schema"))
    return (lookup(catalog, schemas, [*keys, "table_schema"])
            .withColumn("table_bytes", table)
            .withColumn("logical_bytes", estimate(F.col("table_bytes"), LOGICAL_FACTOR))
            .withColumn("physical_bytes", estimate(F.col("_schema"), PHYSICAL_FACTOR))
            .drop("_schema"))


def latency_share(statements: DataFrame, value: str, share: float = 0.95, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Scanning distinct times downwards, the last time whose share of statements at or below it exceeds ``share``.

    Times are counted first, so only distinct ones are summed up, and those of a large server in several partitions.
    """
    keys = list(keys)
    counted = statements.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = statements.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    below = running_total(counted, keys, [F.col(value).asc()], F.col("_n"), "_below")
    return below.join(totals, keys).filter(F.col("_below") / F.col("_all") > share).groupBy(*keys).agg(F.min(value).alias("latency"))
