"""Readers of landed reports and the tables taken out of their documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.normalize import NULL_MARKER

CORRUPT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
# The form of a stage log line.
STAGE_LINE = "Schema change check: task_id="


def _bronze(reports: DataFrame) -> DataFrame:
    return reports.withColumnRenamed("_corrupt", "error")


def read_snapshots(spark: SparkSession, path: str | list[str], file_format: str = "json") -> DataFrame:
    """SRC1: landed reports as bronze rows; an unreadable line keeps its text in ``error``."""
    reader = spark.read.schema(schemas.REPORT)
    if file_format == "json":
        return _bronze(reader.options(**CORRUPT).json(path))
    return _bronze(reader.format(file_format).load(path))


def read_snapshot_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """SRC2: the same, continuously."""
    reader = spark.readStream.schema(schemas.REPORT).options(**CORRUPT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _bronze(reader.json(path))


def _document(reports: DataFrame, schema: str) -> DataFrame:
    return reports.withColumn("_d", F.from_json("document", schema))


def explode_status(reports: DataFrame) -> DataFrame:
    """SRC3: status and variables as (server, time, scope, name, value) rows."""
    both = F.array(F.struct(F.lit("status").alias("scope"), F.col("_d.DB.Metrics.Status").alias("values")),
                   F.struct(F.lit("variables").alias("scope"), F.col("_d.DB.Conf.Variables").alias("values")))
    return (_document(reports, schemas.STATUS).select("server_id", "collected_at", F.explode(both).alias("_s"))
            .select("server_id", "collected_at", "_s.scope", F.explode("_s.values").alias("name", "value")))


def explode_sections(reports: DataFrame) -> DataFrame:
    """SRC4: catalogue rows with the name of their section; the row stays a map."""
    sections = F.explode("_d.DB.DatabaseSchema").alias("section", "_rows")
    return (_document(reports, schemas.SECTIONS).select("server_id", "collected_at", sections)
            .select("server_id", "collected_at", "section", F.explode("_rows").alias("row")))


def failed_sections(reports: DataFrame) -> DataFrame:
    """SRC4: failed sections of a report in the order it lists them."""
    return _document(reports, schemas.FAILED_SECTIONS).select(
        "server_id", "collected_at", F.posexplode("_d.DB.FailedDatabaseSchema").alias("ordinal", "section"))


def section_layouts(sections: DataFrame) -> DataFrame:
    """SRC4a: the layout of each report's rows of a section, by the columns that any of them has.

    Of indexes: ``full`` has expressions and visibility, ``ignoring`` says which ones are ignored, ``visibility`` lacks
    expressions, ``legacy`` lacks both. Of columns: ``full`` has generation expressions, ``legacy`` has none.
    """
    has = lambda c: F.bool_or(F.map_contains_key("row", c))
    found = sections.groupBy("server_id", "collected_at", "section").agg(
        has("EXPRESSION").alias("_expression"), has("IS_VISIBLE").alias("_visible"), has("IGNORED").alias("_ignored"), has("GENERATION_EXPRESSION").alias("_generation"))
    index = (F.when(F.col("_expression") & F.col("_visible"), "full").when(F.col("_ignored"), "ignoring")
             .when(F.col("_visible"), "visibility").otherwise("legacy"))
    layout = (F.when(F.col("section") == "information_schema_indexes", index)
              .when((F.col("section") == "information_schema_columns") & ~F.col("_generation"), "legacy").otherwise("full"))
    return found.select("server_id", "collected_at", "section", layout.alias("layout"))


def mysql_section(sections: DataFrame, section: str) -> DataFrame:
    """SRC4a: one section as a table, whatever the layouts of its servers.

    A missing value is the marker text. An index counts as visible unless its layout says otherwise, and has an expression
    only in the full layout; a column has a generation expression only in its full layout.
    """
    rows, row, layout = sections.filter(F.col("section") == section), F.col("row"), F.col("layout")
    columns, raw = schemas.SECTION_COLUMNS[section], []
    rules = {}
    value = lambda c: F.coalesce(F.col(c), F.lit(NULL_MARKER))
    if section == "information_schema_indexes":
        raw, ignored = ["IGNORED"], F.upper(F.coalesce("IGNORED", F.lit("NO"))) == "YES"
        rules = {"EXPRESSION": F.when(layout == "full", value("EXPRESSION")).otherwise(NULL_MARKER),
                 "IS_VISIBLE": F.when(layout == "ignoring", F.when(ignored, "NO").otherwise("YES"))
                 .when(layout == "legacy", "YES").otherwise(F.coalesce("IS_VISIBLE", F.lit("YES")))}
    if section == "information_schema_columns":
        rules = {"GENERATION_EXPRESSION": F.when(layout == "full", value("GENERATION_EXPRESSION")).otherwise(NULL_MARKER)}
    # Values meet their layout, not maps: the names of the columns need not cross the shuffle.
    found = rows.select("server_id", "collected_at", *[row[c].alias(c) for c in (*columns, *raw)])
    if rules:
        layouts = section_layouts(rows).select(F.col("server_id").alias("_server"), F.col("collected_at").alias("_at"), "layout")
        found = found.join(layouts, F.col("server_id").eqNullSafe(F.col("_server")) & F.col("collected_at").eqNullSafe(F.col("_at")))
    return found.select("server_id", "collected_at", *[rules.get(c, value(c)).alias(c) for c in columns])


def postgres_sections(sections: DataFrame, order: Sequence[str]) -> DataFrame:
    """SRC4b: rows per known section of a server, with the fixed place of the section."""
    place = F.create_map(*[F.lit(x) for i, name in enumerate(order, 1) for x in (name, i)])
    return section_counts(sections).withColumn("position", place[F.col("section")]).filter(F.col("position").isNotNull())


def section_counts(sections: DataFrame) -> DataFrame:
    """SRC4: rows per section of a server."""
    return sections.groupBy("server_id", "section").agg(F.count(F.lit(1)).alias("rows"))


def parse_host_json(documents: DataFrame, column: str = "message") -> DataFrame:
    """SRC5: host documents with an explicit schema; unknown fields are ignored, a bad document is an error row."""
    parsed = documents.withColumn("host", F.from_json(column, schemas.HOST, CORRUPT))
    bad = F.col("host").isNull() | F.col("host._corrupt").isNotNull()
    return parsed.withColumn("error", F.when(bad, F.col(column))).withColumn("host", F.when(~bad, F.col("host")))


def _numbers_as_text(document: Column) -> Column:
    """A JSON text whose member numbers are quoted, so that parsing keeps their digits. Strings are passed over whole."""
    string = r'"(?:[^"\\]++|\\.)*+"'
    marked = F.regexp_replace(document, rf"({string}\s*+:\s*+)(-?[0-9][0-9.eE+-]*+)|({string})", "$1$3\u0001$2\u0001")
    return F.replace(F.replace(marked, F.lit("\u0001\u0001"), F.lit("")), F.lit("\u0001"), F.lit('"'))


def parse_recommendations(documents: DataFrame, column: str = "document") -> DataFrame:
    """SRC7: exactly one JSON object per document as name/value rows with the numbers' own text; else one error row."""
    alone = F.from_json(F.concat(F.lit("["), F.col(column), F.lit("]")), "array<variant>")
    valid = F.coalesce((F.size(alone) == 1) & F.ltrim(F.col(column)).startswith("{"), F.lit(False))
    texts = F.from_json(_numbers_as_text(F.col(column)), "map<string,string>")
    # Inside of an object or a list numbers stay numbers.
    plain = F.from_json(column, "map<string,string>")
    members = F.map_zip_with(texts, plain, lambda name, text, whole: F.when(whole.rlike(r"^\s*[\[{]"), whole).otherwise(text))
    values = F.when(valid, members)
    return documents.select(
        *[c for c in documents.columns if c != column], F.when(~valid, F.col(column)).alias("error"),
        F.explode_outer(values).alias("name", "value"))


# What follows a backslash in a quoted reason, and what it stands for.
ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def unquoted(text: Column) -> Column:
    """The text that a quoted one stands for, read once from left to right; a byte that is no character becomes U+FFFD."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\\]+|\\x[0-9a-f]{2}|\\u[0-9a-f]{4}|\\U[0-9a-f]{8}|\\."), 0)

    def meant(piece: Column) -> Column:
        letter, code = F.substring(piece, 2, 1), F.substring(piece, F.lit(3), F.lit(8))
        character = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        letters = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])
        return (F.when(~piece.startswith("\\"), piece)
                .when((letter == "x") & (code >= "80"), "\ufffd")
                .when(letter.isin("x", "u", "U") & (code != ""), character)
                .otherwise(F.coalesce(letters[letter], letter)))
    return F.array_join(F.transform(pieces, meant), "")


def parse_stage_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC8: stage log lines as rows; other lines are left out."""
    line = F.col(column)

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(line, rf"\b{name}=(\S+)", 1), F.lit(""))
    # A table's name may hold spaces: it ends where the next known field begins.
    table = F.nullif(F.btrim(F.regexp_extract(line, r"\btable=(.*?)(?: duration_ms=| reason=|$)", 1)), F.lit(""))
    reason = F.regexp_extract(line, r'\breason="((?:[^"\\]|\\.)*)"', 1)
    return lines.filter(line.contains(STAGE_LINE)).select(
        *[c for c in lines.columns if c != column],
        field("task_id").try_cast("int").alias("task_id"), field("statement_index").try_cast("int").alias("statement_index"),
        field("stage").alias("stage"), field("status").alias("status"), table.alias("table"),
        field("duration_ms").try_cast("bigint").alias("duration_ms"),
        F.nullif(unquoted(reason), F.lit("")).alias("reason"))


def parse_event_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC9: structured log events; a line that is not JSON has no event."""
    parsed = lines.withColumn("_e", F.from_json(column, schemas.EVENT, CORRUPT))
    good = F.col("_e._corrupt").isNull()
    fields = ("event", "scope", "group", "batch", "names", "outcome", "error", "source", "metadata", "scope_outcomes")
    return parsed.select(*[c for c in lines.columns if c != column], *[F.when(good, F.col(f"_e.{f}")).alias(f) for f in fields],
                         F.when(~good, F.col(column)).alias("unreadable"))


def info_grants(reports: DataFrame) -> DataFrame:
    """SRC10: grants of the collecting account."""
    return _document(reports, schemas.GRANTS).select("server_id", "collected_at", F.explode("_d.DB.Info.Grants").alias("grant"))


def info_extensions(reports: DataFrame) -> DataFrame:
    """SRC10: extensions with version and schema."""
    rows = _document(reports, schemas.EXTENSIONS).select("server_id", "collected_at", F.explode("_d.DB.Info.Extensions").alias("_e"))
    return rows.select("server_id", "collected_at", "_e.name", F.coalesce("_e.version", F.lit(NULL_MARKER)).alias("version"),
                       F.coalesce("_e.schema", F.lit(NULL_MARKER)).alias("schema"))


def info_rules(reports: DataFrame) -> DataFrame:
    """SRC10: access rules; missing parts are empty text."""
    rows = _document(reports, schemas.RULES).select("server_id", "collected_at", F.explode("_d.DB.Info.PgHba").alias("_r"))
    fields = ("type", "database", "user_name", "address", "auth_method", "error")
    return rows.select("server_id", "collected_at", *[F.coalesce(F.col(f"_r.{f}"), F.lit("")).alias(f) for f in fields])


def stat_views(reports: DataFrame, views: Sequence[str] = (*schemas.SERVER_VIEWS, *schemas.DATABASE_VIEWS)) -> DataFrame:
    """SRC11: rows of the statistics views as name/value pairs; a view that a server lacks gives no rows."""
    rows = "MAP<STRING, ARRAY<MAP<STRING, STRING>>>"
    held = reports.withColumn("_v", F.from_json("document", rows))
    return (held.select("server_id", "collected_at", F.explode("_v").alias("view", "_rows")).filter(F.col("view").isin(*views))
            .select("server_id", "collected_at", "view", F.posexplode("_rows").alias("row", "_row"))
            .select("server_id", "collected_at", "view", "row", F.explode("_row").alias("name", "value")))
