"""Predicates and eligibility reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.classify import managed_database
from ..functions.normalize import null_marker
from .skew import lookup

# Kinds of relations, process columns, limits.
TABLE_KINDS = ("r", "p", "v", "m", "f")
STATISTICS_KINDS = ("r", "t", "m", "p")
PROCESS_FIELDS = ("ID", "USER", "HOST", "DB", "COMMAND", "TIME", "STATE", "INFO")
INDEX_USAGE_TABLES = 1_000_000
SEEN_SECONDS = 7 * 24 * 60 * 60


def schema_allowed(schema: Column, allowed: Column) -> Column:
    """whether the schema is in the comma list; an empty list allows all."""
    return (allowed == "") | F.array_contains(F.split(allowed, ","), schema)


def user_schema(schema: Column) -> Column:
    """F2: not a system, toast or temporary schema; the underscore before the star is a wildcard."""
    return (~schema.isin("information_schema", "pg_catalog") & ~schema.like("pg_toast%") & ~schema.like("pg_temp_%"))


def relkind_filter(relkind: Column, statistics: bool = False) -> Column:
    """kinds of relations in the tables section or in the table statistics."""
    return relkind.isin(*(STATISTICS_KINDS if statistics else TABLE_KINDS))


def not_managed_database(instance_type: Column, database: Column) -> Column:
    """not the database that the provider keeps for itself."""
    return ~F.coalesce(managed_database(instance_type) == F.lower(F.btrim(database)), F.lit(False))


def active_sessions(sessions: DataFrame, now: Column, micros) -> DataFrame:
    """sessions with a state, their address, program, kind, wait event and ages in whole seconds."""
    def age(start: str) -> Column:
        return F.round((micros(now) - micros(start)) / 1000000.0, 0).cast("bigint")
    address = F.concat(F.coalesce("client_addr", F.lit("local")),
                       F.coalesce(F.concat(F.lit(":"), F.col("client_port").cast("string")), F.lit("")))
    return sessions.filter(F.col("state").isNotNull()).select(
        "server_id", "pid", "datname", "usename", address.alias("client_address"), "application_name", "backend_type", "state",
        F.concat_ws(" ", "wait_event_type", "wait_event").alias("wait_event"),
        age("query_start").alias("query_time"), age("xact_start").alias("tx_time"), age("state_change").alias("state_time"), "query")


def mysql_candidate_reason(digests: DataFrame, allowed: Column, now_seconds: Column) -> Column:
    """the first reason why no plan is asked for; null for a candidate."""
    text, schema = F.col("query_text"), F.col("schema_name")
    selects = text.contains("SELECT") | text.contains("select")
    wheres = text.contains("WHERE") | text.contains("where")
    resolved = F.col("explain").isNotNull() | F.col("explain_error").isNotNull()
    return (F.when(text == "", "no-text")
            .when(~schema_allowed(schema, allowed), "schema-not-allowed")
            .when(selects & text.contains("SQL_NO_CACHE") & ~wheres, "dump")
            .when(text.contains("EXPLAIN FORMAT=JSON"), "own-plan")
            .when(schema.isin(*tx.MYSQL_SYSTEM_SCHEMAS), "system-schema")
            .when(~tx.is_explainable(tx.mysql_leading_word(text)), "not-explainable")
            .when(resolved, "resolved")
            .when(text.endswith("..."), "need_full_query")
            .when(F.col("last_seen") < now_seconds - SEEN_SECONDS, "not-seen-lately"))


def postgres_candidate_reason(database: Column, text: Column, allowed: Column, failed: Column) -> Column:
    """the first reason why no plan is asked for; null for a candidate."""
    return (F.when(database.isin(*tx.POSTGRES_SKIPPED_DATABASES), "system-database")
            .when(tx.leading_unread(text), "not-read")
            .when(~tx.is_explainable(tx.postgres_leading_word(text)), "not-explainable")
            .when(~schema_allowed(database, allowed), "schema-not-allowed")
            .when(failed, "database-failed"))


def null_query_id(stats: DataFrame) -> DataFrame:
    """F8: statements with an id."""
    return stats.filter(F.col("queryid").isNotNull())


def process_fields(processes: DataFrame) -> DataFrame:
    """the known columns under upper-case names, missing values as the marker."""
    present = {c.upper(): c for c in processes.columns}
    return processes.select("server_id", *[null_marker(F.col(present[f])).alias(f) for f in PROCESS_FIELDS if f in present])


def index_usage_cutoff(usage: DataFrame, table_counts: DataFrame, limit: int = INDEX_USAGE_TABLES) -> DataFrame:
    """index usage only of servers with at most ``limit`` tables."""
    small = table_counts.filter(F.col("tables") <= limit).select("server_id")
    return lookup(usage, small, ["server_id"], "inner")
