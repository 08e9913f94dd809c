"""Catalogue sections of servers with differing layouts."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.registry import sections
from fleetlens.registry.base import Tables
from fleetlens.sources import read


def rows_of(spark, section, reports):
    """Reports as (server, rows); the section's rows."""
    documents = [(s, "2024-05-01 00:00:00", json.dumps({"DB": {"DatabaseSchema": {section: rows}}})) for s, rows in reports]
    bronze = spark.createDataFrame(documents, "server_id bigint, at string, document string").withColumn("collected_at", F.to_timestamp("at"))
    return read.mysql_section(read.explode_sections(bronze), section)


INDEXES = [
    (1, [{"INDEX_NAME": "a", "EXPRESSION": "(x+1)", "IS_VISIBLE": "NO"}, {"INDEX_NAME": "b", "EXPRESSION": None, "IS_VISIBLE": None}, {"INDEX_NAME": "c"}]),
    (2, [{"INDEX_NAME": "d", "IGNORED": "yes"}, {"INDEX_NAME": "e", "IGNORED": "NO"}, {"INDEX_NAME": "f", "IGNORED": None}]),
    (3, [{"INDEX_NAME": "g", "IS_VISIBLE": "NO"}, {"INDEX_NAME": "h", "IS_VISIBLE": None}]),
    (4, [{"INDEX_NAME": "i"}]), (None, [{"INDEX_NAME": "j", "IGNORED": "YES"}])]


def test_index_layouts(spark):
    got = {r.INDEX_NAME: (r.EXPRESSION, r.IS_VISIBLE) for r in rows_of(spark, "information_schema_indexes", INDEXES).collect()}
    assert got == {"a": ("(x+1)", "NO"), "b": ("NULL", "YES"), "c": ("NULL", "YES"), "d": ("NULL", "NO"), "e": ("NULL", "YES"), "f": ("NULL", "YES"),
                   "g": ("NULL", "NO"), "h": ("NULL", "YES"), "i": ("NULL", "YES"), "j": ("NULL", "NO")}


def test_column_layouts(spark):
    reports = [(1, [{"COLUMN_NAME": "a", "GENERATION_EXPRESSION": "b+1"}, {"COLUMN_NAME": "b", "GENERATION_EXPRESSION": ""}]), (2, [{"COLUMN_NAME": "c", "EXTRA": None}])]
    got = {r.COLUMN_NAME: (r.GENERATION_EXPRESSION, r.EXTRA) for r in rows_of(spark, "information_schema_columns", reports).collect()}
    assert got == {"a": ("b+1", "NULL"), "b": ("", "NULL"), "c": ("NULL", "NULL")}


@pytest.mark.parametrize("section", sorted(schemas.SECTION_COLUMNS))
def test_sections_have_their_columns(spark, section):
    columns = schemas.SECTION_COLUMNS[section]
    found = rows_of(spark, section, [(1, [{columns[0]: "v"}, {}])])
    assert found.columns == ["server_id", "collected_at", *columns] and len(set(columns)) == len(columns)
    assert sorted(r[2] for r in found.collect()) == ["NULL", "v"]


def document_by_hand(section, order, customer):
    layout, rows = customer % 4, []
    absent = {"information_schema_indexes": {"EXPRESSION": layout != 0, "IS_VISIBLE": layout in (1, 3), "IGNORED": layout != 1},
              "information_schema_columns": {"GENERATION_EXPRESSION": layout in (1, 3)}}.get(section, {})
    for j in range(sections.ROWS):
        fields = {c: f"{c.lower()}_{(order + j + i) % (7 + i)}" if (order + j + i) % 5 else None for i, c in enumerate(schemas.SECTION_COLUMNS[section])}
        if section == "information_schema_indexes":
            fields |= {c: ("YES", "no", None)[(order + j + place) % 3] for c, place in (("IS_VISIBLE", 1), ("IGNORED", 2))}
        rows.append({c: v for c, v in fields.items() if not absent.get(c, v is None and order % 2 == 0)})
    return json.dumps({"DB": {"DatabaseSchema": {section: rows}}}, separators=(",", ":"))


@pytest.mark.parametrize("section", sorted(schemas.SECTION_COLUMNS))
def test_reports_of_sections_are_compiled(spark, tmp_path, section):
    """Functions of array elements are interpreted, many times slower than the texts of the rows one beside the other."""
    spark.range(1, 41).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.lit("2024-01-01").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    reports = sections.section_reports(Tables(spark, str(tmp_path)), section)
    assert sorted(r.document for r in reports.collect()) == sorted(document_by_hand(section, k, k % 9) for k in range(1, 41))
    assert "lambda" not in reports._jdf.queryExecution().optimizedPlan().toString()
