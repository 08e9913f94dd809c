"""The catalogue sections of the first engine, one query each, from reports of servers with differing layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..sources import read
from . import landing
from .base import Tables, query

LAYOUTS = ("full", "ignoring", "visibility", "legacy")
ROWS = 2


def column_value(name: str, place: int, j: int):
    """Whether a column has a value in row ``j`` of an order's section, as it has not in every fifth row, and the value: the column's name and a number."""
    seed = F.col("o_orderkey") + (j + place)
    return seed % 5 != 0, F.concat(F.lit(f"{name.lower()}_"), (seed % (7 + place)).cast("string"))


def column_sql(name: str, place: int) -> str:
    seed = f"(o_orderkey + j + {place})"
    return f"CASE WHEN {seed} % 5 <> 0 THEN '{name.lower()}_' || CAST({seed} % {7 + place} AS VARCHAR) ELSE 'NULL' END"


def flag(place: int, j: int):
    """YES, NO, or missing."""
    seed = (F.col("o_orderkey") + (j + place)) % 3
    return seed.isin(0, 1), F.when(seed == 0, "YES").otherwise("no")


def section_reports(t: Tables, section: str):
    """A report per order with two rows of the section, in the layout of its server; a missing value is null or not there at all."""
    layout, columns = F.col("o_custkey") % 4, schemas.SECTION_COLUMNS[section]
    absent: dict = {}
    if section == "information_schema_indexes":
        absent = {"EXPRESSION": layout != 0, "IS_VISIBLE": layout.isin(1, 3), "IGNORED": layout != 1}
    if section == "information_schema_columns":
        absent = {"GENERATION_EXPRESSION": layout.isin(1, 3)}

    def entry(c: str, present, value):
        """The text of a field. Nulls of a column that the layout has: kept in some rows, left out of others."""
        written = F.concat(F.lit(f'"{c}":"'), value, F.lit('"'))
        if c in absent:
            return F.when(~absent[c] & present, written).when(~absent[c], f'"{c}":null')
        return F.when(present, written).when(F.col("o_orderkey") % 2 != 0, f'"{c}":null')

    def row(j: int):
        """The row's text: names and values need no escapes. Rows are written out, as a function of an array's elements is not compiled."""
        fields = {c: column_value(c, i, j) for i, c in enumerate(columns)}
        if section == "information_schema_indexes":
            fields |= {"IS_VISIBLE": flag(1, j), "IGNORED": flag(2, j)}
        return F.concat(F.lit("{"), F.concat_ws(",", *[entry(c, *v) for c, v in fields.items()]), F.lit("}"))

    document = F.concat(F.lit(f'{{"DB":{{"DatabaseSchema":{{"{section}":['), F.concat_ws(",", *[row(j) for j in range(ROWS)]), F.lit("]}}}"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").repartition("o_orderkey")
    return orders.select(F.col("o_custkey").alias("server_id"), F.to_timestamp(landing.iso("o_orderdate")).alias("collected_at"), document.alias("document"))


def section_sql(section: str) -> str:
    columns = schemas.SECTION_COLUMNS[section]
    values = {c: column_sql(c, i) for i, c in enumerate(columns)}
    layout = "o_custkey % 4"
    if section == "information_schema_indexes":
        values["EXPRESSION"] = f"CASE WHEN {layout} = 0 THEN {values['EXPRESSION']} ELSE 'NULL' END"
        visible = "CASE (o_orderkey + j + 1) % 3 WHEN 1 THEN 'no' ELSE 'YES' END"
        values["IS_VISIBLE"] = f"CASE WHEN {layout} = 1 THEN CASE WHEN (o_orderkey + j + 2) % 3 = 0 THEN 'NO' ELSE 'YES' END WHEN {layout} = 3 THEN 'YES' ELSE {visible} END"
    if section == "information_schema_columns":
        values["GENERATION_EXPRESSION"] = f"CASE WHEN {layout} IN (0, 2) THEN {values['GENERATION_EXPRESSION']} ELSE 'NULL' END"
    fields = ", ".join(f'{v} AS "{c}"' for c, v in values.items())
    return f"SELECT o_custkey AS server_id, CAST(epoch(o_orderdate) AS BIGINT) AS collected_at, {fields} FROM orders, (SELECT unnest(range({ROWS})) AS j)"


def register(section: str) -> None:
    name = section.removeprefix("information_schema_").removeprefix("performance_schema_")

    @query(f"mysql_{name}", section_sql(section))
    def rows(t: Tables):
        found = read.mysql_section(read.explode_sections(section_reports(t, section)), section)
        return found.withColumn("collected_at", F.unix_timestamp("collected_at"))


for _section in schemas.SECTION_COLUMNS:
    register(_section)
