"""Report documents made from the given tables, and folders to land them in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .base import Tables


def fresh_dir(t: Tables, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def iso(column: str):
    """A timestamp without zone as the text of an instant."""
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def report_documents(t: Tables) -> DataFrame:
    """One report per order: status, variables, sections, grants, extensions and access rules."""
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = order.cast("string")
    status = F.create_map(F.lit("Uptime"), cust.cast("string"), F.lit("Threads"), (order % 7).cast("string"))
    variables = F.create_map(F.lit("version"), F.concat(F.lit("8."), (cust % 9).cast("string")), F.lit("port"), F.lit("3306"))
    table = F.create_map(F.lit("TABLE_SCHEMA"), F.col("o_orderpriority"), F.lit("TABLE_NAME"), F.concat(F.lit("t"), text))
    column = F.create_map(F.lit("TABLE_SCHEMA"), F.lit("app"), F.lit("COLUMN_NAME"), F.concat(F.lit("c"), text), F.lit("EXTRA"), F.lit(""))
    generated = F.map_concat(column, F.create_map(F.lit("GENERATION_EXPRESSION"), F.lit("a+b")))
    none = F.array().cast("array<map<string,string>>")
    sections = F.create_map(
        F.lit("information_schema_tables"), F.array(table, table),
        F.lit("information_schema_columns"), F.when(order % 2 == 0, F.array(column)).when(order % 3 == 0, F.array(generated, column)).otherwise(none))
    info = F.struct(
        F.array(F.concat(F.lit("GRANT "), F.col("o_orderstatus")), F.lit("GRANT SELECT")).alias("Grants"),
        F.array(F.struct(F.lit("plpgsql").alias("name"), F.when(order % 2 == 0, "1.0").alias("version"), F.lit("pg_catalog").alias("schema"))).alias("Extensions"),
        F.array(F.struct(F.lit("host").alias("type"), F.lit("all").alias("database"), F.when(order % 5 != 0, F.concat(F.lit("u"), cust.cast("string"))).alias("user_name"),
                         F.lit("10.0.0.0/8").alias("address"))).alias("PgHba"))
    db = F.struct(F.struct(status.alias("Status")).alias("Metrics"), F.struct(variables.alias("Variables")).alias("Conf"), info.alias("Info"), sections.alias("DatabaseSchema"))
    return t.orders.select(
        cust.alias("server_id"), "o_orderkey", iso("o_orderdate").alias("collected_at"),
        F.when(F.col("o_orderstatus") == "F", "Metrics").when(F.col("o_orderstatus") == "O", "Queries").otherwise("Configurations").alias("report_type"),
        F.struct(db.alias("DB")).alias("document"))


def landed(t: Tables, reports: DataFrame) -> str:
    """Write reports as compressed JSON lines into a new folder and name it; field names come in every line, so they shrink to a small part."""
    path = fresh_dir(t, "landed")
    fast = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    reports.select("server_id", "collected_at", "report_type", "document").write.options(**fast).json(path)
    return path


def bronze(t: Tables) -> DataFrame:
    """The report documents as bronze rows, without the way over files."""
    return report_documents(t).withColumn("collected_at", F.to_timestamp("collected_at")).withColumn("document", F.to_json("document"))
