"""Schema catalogues: versioned columns, indexes, constraints, sequences, sections.

Joins by relation, column or index meet large tables on fine keys: both sides are sorted and never broadcast, and Spark splits
skewed partitions at run time. Joins by schema, collation or server meet small tables on coarse keys: they are lookups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import ACTION_WORDS, MATCH_WORDS, code_word, from_null_marker, since
from .filters import relkind_filter, user_schema
from .skew import lookup, meet

# Server versions from which a column exists, required columns, sections in their order.
IDENTITY, KEY_COUNT, GENERATED, NULLS_NOT_DISTINCT, LAST_SCAN = 100000, 110000, 120000, 150000, 160000
REQUIRED_COLUMNS = ("dbid", "queryid", "query", "calls")
TIMING_COLUMNS = ("total_exec_time", "total_time")
POSTGRES_SECTIONS = ("information_schema_tables", "information_schema_columns", "information_schema_indexes",
                     "information_schema_referential_constraints", "information_schema_key_column_usage", "pg_sequences")
MYSQL_SECTIONS = ("information_schema_tables", "information_schema_columns", "information_schema_indexes",
                  "information_schema_referential_constraints", "information_schema_key_column_usage",
                  "information_schema_table_constraints", "information_schema_triggers",
                  "performance_schema_table_io_waits_summary_by_index_usage")


def versioned_columns(columns: DataFrame) -> DataFrame:
    """Catalogue columns as the server version knows them, one job for mixed versions."""
    version = F.col("version")
    no, empty = F.lit(False), F.lit("")
    expression = since(version, GENERATED, F.coalesce("generation_expression", empty), empty)
    return columns.select(
        "column_id", "version",
        since(version, IDENTITY, F.col("is_identity") == "YES", no).alias("is_identity"),
        since(version, GENERATED, F.col("is_generated") != "NEVER", no).alias("is_generated"),
        F.nullif(expression, empty).alias("generation_expression"),
        since(version, KEY_COUNT, F.col("indnkeyatts"), F.col("indnatts")).alias("key_count"),
        since(version, NULLS_NOT_DISTINCT, F.col("indnullsnotdistinct"), no).alias("nulls_not_distinct"),
        F.nullif(since(version, LAST_SCAN, F.coalesce("last_idx_scan", empty), empty), empty).alias("last_scan"))


def statement_capabilities(columns: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """What the statement statistics of a server offer, from its column list."""
    name = F.lower("column_name")
    names = [*REQUIRED_COLUMNS, *TIMING_COLUMNS, "rows", "toplevel"]
    found = columns.groupBy(*keys).agg(*[F.bool_or(name == c).alias(f"_{c}") for c in names])
    timing = F.when(F.col("_total_exec_time"), "total_exec_time").when(F.col("_total_time"), "total_time")
    error = F.when(~F.col("_dbid"), "missing column dbid")
    for c in REQUIRED_COLUMNS[1:]:
        error = error.when(~F.col(f"_{c}"), f"missing column {c}")
    error = error.when(timing.isNull(), "no timing column")
    return found.select(*keys, timing.alias("timing_column"), F.col("_rows").alias("has_rows"),
                        F.col("_toplevel").alias("has_toplevel"), error.alias("error"))


def _short(catalog: DataFrame, namespaces: DataFrame, keys: Sequence[str], name: str, namespace: str, *more: str) -> DataFrame:
    """A small catalogue with the name of its schema."""
    schemas = namespaces.select(*keys, F.col("oid").alias(namespace), F.col("nspname").alias("schema"))
    return catalog.join(schemas, [*keys, namespace], "left").select(*keys, "oid", name, "schema", *more)


def index_keys(indexes: DataFrame, attributes: DataFrame, collations: DataFrame, opclasses: DataFrame, namespaces: DataFrame,
               keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Per index its ordered key columns and its included columns, in one pass.

    An index has at most 32 columns, so the collected arrays are short.
    """
    keys = list(keys)
    parts = (indexes.select(*keys, "indexrelid", "indrelid", "key_count", F.posexplode_outer(
        F.arrays_zip("indkey", "indcollation", "indclass", "indoption", "definitions")).alias("place", "part"))
        .select(*keys, "indexrelid", "indrelid", "key_count", (F.col("place") + 1).alias("position"), "part.*"))
    columns = attributes.select(*keys, F.col("attrelid").alias("indrelid"), F.col("attnum").alias("indkey"), "attname", "attcollation")
    sorting = _short(collations, namespaces, keys, "collname", "collnamespace")
    sorting = sorting.select(*keys, F.col("oid").alias("indcollation"), "collname", F.col("schema").alias("collschema"))
    classes = _short(opclasses, namespaces, keys, "opcname", "opcnamespace", "opcdefault")
    classes = classes.select(*keys, F.col("oid").alias("indclass"), "opcname", F.col("schema").alias("opcschema"), "opcdefault")
    joined = lookup(lookup(meet(parts, columns, [*keys, "indrelid", "indkey"], "left"), sorting, [*keys, "indcollation"]),
                    classes, [*keys, "indclass"])
    expression = F.col("indkey") == 0
    option = F.coalesce("indoption", F.lit(0))
    default_collation = (F.when(F.coalesce("indcollation", F.lit(0)) == 0, True)
                         .when(F.col("indkey") != 0, F.col("indcollation") == F.col("attcollation")).otherwise(False))
    key = F.struct(
        "position", F.when(~expression, F.col("attname")).alias("column_name"),
        F.when(expression, F.col("definitions")).alias("expression"), F.col("collname").alias("collation"),
        F.col("opcname").alias("opclass"), F.col("collschema").alias("collation_schema"), F.col("opcschema").alias("opclass_schema"),
        default_collation.alias("collation_is_default"), F.coalesce("opcdefault", F.lit(False)).alias("opclass_is_default"),
        (option.bitwiseAND(1) == 1).alias("descending"), (option.bitwiseAND(2) == 2).alias("nulls_first"),
        F.col("definitions").alias("definition"))
    included = F.when((F.col("position") > F.col("key_count")) & F.col("attname").isNotNull(), F.struct("position", "attname"))
    grouped = joined.groupBy(*keys, "indexrelid").agg(
        F.array_sort(F.collect_list(F.when(F.col("position") <= F.col("key_count"), key))).alias("keys"),
        F.array_sort(F.collect_list(included)).alias("_included"))
    return grouped.withColumn("include_columns", F.transform("_included", lambda x: x["attname"])).drop("_included")


def index_usage_attach(indexes: DataFrame, usage: DataFrame, resets: DataFrame, inherits: DataFrame,
                       keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Scan count, last scan and statistics reset of each index, and whether it hangs under a partitioned one."""
    keys = list(keys)
    attached = inherits.select(*keys, F.col("inhrelid").alias("indexrelid"), F.lit(True).alias("_attached")).distinct()
    scans = usage.select(*keys, "indexrelid", "idx_scan", "last_idx_scan")
    joined = meet(meet(indexes, scans, [*keys, "indexrelid"], "left"), attached, [*keys, "indexrelid"], "left")
    return (lookup(joined, resets.select(*keys, "stats_reset"), keys)
            .withColumn("idx_scan", F.coalesce("idx_scan", F.lit(0)))
            .withColumn("is_attached_partition", F.coalesce("_attached", F.lit(False))).drop("_attached"))


def index_rows(indexes: DataFrame, classes: DataFrame, methods: DataFrame, attributes: DataFrame, collations: DataFrame, opclasses: DataFrame,
               namespaces: DataFrame, usage: DataFrame, resets: DataFrame, inherits: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """J4, J5, J6 and N19 together: one row per index of a user schema with all that is known of it.

    What a server's version does not know has its fixed default; texts that are empty count as missing where a row may do
    without them. Large sides meet on relations and indexes, small ones by server.
    """
    keys = list(keys)
    version, empty = F.col("version"), F.lit("")
    known = indexes.withColumn("key_count", since(version, KEY_COUNT, F.col("indnkeyatts"), F.col("indnatts"))).withColumn(
        "nulls_not_distinct", since(version, NULLS_NOT_DISTINCT, F.col("indnullsnotdistinct"), F.lit(False)))
    own = classes.select(*keys, F.col("oid").alias("indexrelid"), F.col("relname").alias("name"), "relkind", "relam")
    table = _relations(classes, namespaces, keys, "indrelid", "table", "schema").filter(user_schema(F.col("schema")))
    am = methods.select(*keys, F.col("oid").alias("relam"), F.col("amname").alias("access_method"))
    rows = meet(meet(known, own, [*keys, "indexrelid"]), table, [*keys, "indrelid"])
    rows = lookup(rows, am, [*keys, "relam"], "inner")
    rows = index_usage_attach(rows, usage, resets, inherits, keys)
    parts = index_keys(known, attributes, collations, opclasses, namespaces, keys)
    rows = meet(rows, parts, [*keys, "indexrelid"], "left")
    last = since(version, LAST_SCAN, F.coalesce("last_idx_scan", empty), empty)
    return rows.select(
        *keys, "database", "schema", "table", "name", "access_method", "keys", "include_columns", F.coalesce("indpred", empty).alias("predicate"),
        F.col("indexdef").alias("definition"), F.col("indisunique").alias("is_unique"), F.col("indisprimary").alias("is_primary"),
        F.col("indisvalid").alias("is_valid"), F.col("indisready").alias("is_ready"), F.col("indisexclusion").alias("is_exclusion"),
        "nulls_not_distinct", (F.col("relkind") == "I").alias("is_partitioned"), "is_attached_partition", F.col("indisclustered").alias("is_clustered"),
        F.col("indisreplident").alias("is_replica_identity"), F.col("relkind").alias("relation_kind"), F.col("idx_scan").cast("bigint").alias("idx_scan"),
        F.nullif(last, empty).alias("last_idx_scan"), F.nullif(F.coalesce("stats_reset", empty), empty).alias("stats_reset"))


def _relations(classes: DataFrame, namespaces: DataFrame, keys: list[str], oid: str, relation: str, schema: str) -> DataFrame:
    names = namespaces.select(*keys, F.col("oid").alias("relnamespace"), F.col("nspname").alias(schema))
    return classes.join(names, [*keys, "relnamespace"]).select(*keys, F.col("oid").alias(oid), F.col("relname").alias(relation), schema)


def _unique_constraints(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """The constraint behind each index; an index backs at most one, the smallest id decides."""
    unique = constraints.filter(F.col("contype").isin("p", "u"))
    return unique.groupBy(*keys, "conindid", F.col("conrelid").alias("confrelid")).agg(
        F.min_by("conname", "oid").alias("unique_name"), F.min_by("conkey", "oid").alias("unique_key"))


def referential_constraints(constraints: DataFrame, classes: DataFrame, namespaces: DataFrame,
                            keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Foreign keys with both tables, the name of the referenced key and the rules in words."""
    keys = list(keys)
    child = _relations(classes, namespaces, keys, "conrelid", "table_name", "constraint_schema")
    parent = _relations(classes, namespaces, keys, "confrelid", "referenced_table_name", "unique_constraint_schema")
    index_names = classes.select(*keys, F.col("oid").alias("conindid"), F.col("relname").alias("_index"))
    foreign = constraints.filter(F.col("contype") == "f")
    joined = meet(meet(foreign, child, [*keys, "conrelid"]), parent, [*keys, "confrelid"])
    joined = meet(meet(joined, index_names, [*keys, "conindid"], "left"), _unique_constraints(constraints, keys), [*keys, "conindid", "confrelid"], "left")
    return joined.filter(user_schema(F.col("constraint_schema"))).select(
        *keys, "constraint_schema", F.col("conname").alias("constraint_name"), "unique_constraint_schema",
        F.coalesce("unique_name", "_index", F.lit("NULL")).alias("unique_constraint_name"),
        code_word(F.col("confmatchtype"), MATCH_WORDS, "NONE").alias("match_option"),
        code_word(F.col("confupdtype"), ACTION_WORDS).alias("update_rule"),
        code_word(F.col("confdeltype"), ACTION_WORDS).alias("delete_rule"), "table_name", "referenced_table_name")


def key_column_usage(constraints: DataFrame, classes: DataFrame, namespaces: DataFrame, attributes: DataFrame,
                     keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """One row per foreign key column with its place in the referenced key, else its own place."""
    keys = list(keys)
    child = _relations(classes, namespaces, keys, "conrelid", "table_name", "constraint_schema")
    parent = _relations(classes, namespaces, keys, "confrelid", "referenced_table_name", "referenced_table_schema")
    foreign = constraints.filter(F.col("contype") == "f")
    joined = meet(meet(foreign, child, [*keys, "conrelid"]), parent, [*keys, "confrelid"])
    joined = meet(joined, _unique_constraints(constraints, keys), [*keys, "conindid", "confrelid"], "left")
    parts = (joined.filter(user_schema(F.col("constraint_schema")))
             .withColumn("_parts", F.arrays_zip("conkey", "confkey"))
             .select("*", F.posexplode("_parts").alias("_place", "_part"))
             .withColumn("ordinal_position", F.col("_place") + 1)
             .withColumn("_child", F.col("_part.conkey")).withColumn("_parent", F.col("_part.confkey")))
    own = attributes.select(*keys, F.col("attrelid").alias("conrelid"), F.col("attnum").alias("_child"), F.col("attname").alias("column_name"))
    other = attributes.select(*keys, F.col("attrelid").alias("confrelid"), F.col("attnum").alias("_parent"), F.col("attname").alias("referenced_column_name"))
    place = F.nullif(F.expr("array_position(unique_key, _parent)"), F.lit(0))
    return (meet(meet(parts, own, [*keys, "conrelid", "_child"]), other, [*keys, "confrelid", "_parent"])
            .select(*keys, "constraint_schema", F.col("conname").alias("constraint_name"), "table_name", "column_name",
                    F.col("ordinal_position").cast("string").alias("ordinal_position"),
                    F.coalesce(place, F.col("ordinal_position")).cast("string").alias("position_in_unique_constraint"),
                    "referenced_table_schema", "referenced_table_name", "referenced_column_name"))


def sequence_ownership(sequences: DataFrame, namespaces: DataFrame, classes: DataFrame, dependencies: DataFrame,
                       attributes: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Sequences with their bounds and the column that owns them; unknown parts are missing values, an unknown cycle is false."""
    keys = list(keys)
    schemas = namespaces.groupBy(*keys, F.col("nspname").alias("schemaname")).agg(F.min("oid").alias("_namespace"))
    own = classes.filter(F.col("relkind") == "S").select(
        *keys, F.col("relnamespace").alias("_namespace"), F.col("relname").alias("sequencename"), F.col("oid").alias("_sequence"))
    owners = dependencies.filter((F.col("objsubid") == 0) & F.col("deptype").isin("a", "i")).select(
        *keys, F.col("objid").alias("_sequence"), F.col("refobjid").alias("_table"), F.col("refobjsubid").alias("_column"))
    tables = classes.join(namespaces.select(*keys, F.col("oid").alias("relnamespace"), F.col("nspname").alias("owned_table_schema")),
                          [*keys, "relnamespace"], "left").select(
        *keys, F.col("oid").alias("_table"), F.col("relname").alias("owned_table_name"), "owned_table_schema")
    columns = attributes.select(*keys, F.col("attrelid").alias("_table"), F.col("attnum").alias("_column"), F.col("attname").alias("owned_column_name"),
                                F.col("data_type").alias("owned_column_data_type"))
    joined = lookup(sequences.filter(user_schema(F.col("schemaname"))), schemas, [*keys, "schemaname"])
    joined = meet(meet(joined, own, [*keys, "_namespace", "sequencename"], "left"), owners, [*keys, "_sequence"], "left")
    joined = meet(meet(joined, tables, [*keys, "_table"], "left"), columns, [*keys, "_table", "_column"], "left")
    values = ("data_type", "start_value", "min_value", "max_value", "increment_by", "cache_size", "last_value",
              "owned_table_schema", "owned_table_name", "owned_column_name", "owned_column_data_type")
    return joined.select(*keys, "schemaname", "sequencename", *[from_null_marker(F.col(v)).alias(v) for v in values],
                         F.coalesce(from_null_marker(F.col("cycle")), F.lit("false")).alias("cycle"))


def tables_section(tables: DataFrame, namespaces: DataFrame, classes: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Tables with sizes and a row estimate that is never negative; analyse stamps only for kinds that have them."""
    keys = list(keys)
    schemas = namespaces.select(*keys, F.col("nspname").alias("table_schema"), F.col("oid").alias("relnamespace"))
    relations = classes.filter(relkind_filter(F.col("relkind"))).withColumnRenamed("relname", "table_name").drop("oid")
    joined = lookup(tables.filter(user_schema(F.col("table_schema"))), schemas, [*keys, "table_schema"], "inner")
    joined = joined.join(relations, [*keys, "relnamespace", "table_name"])
    analysed = F.col("relkind").isin("r", "m", "p")

    def size(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(name)
    return joined.select(
        *keys, "table_schema", "table_name", "table_type", "relkind",
        F.greatest(F.coalesce("reltuples", F.lit(0.0)), F.lit(0.0)).cast("bigint").alias("estimated_rows"),
        size("table_size"), size("index_size"), size("total_size"),
        F.coalesce(F.when(analysed, F.col("mod_since_analyze")), F.lit(0)).alias("mod_since_analyze"),
        F.when(analysed, F.col("last_analyze")).alias("last_analyze"),
        *[F.when(analysed, F.col(c)).alias(c) for c in present(joined, ("last_autoanalyze",))])


# Further columns of the servers' catalogues, delivered as they are where the input has them.
COLUMN_DETAILS = ("character_maximum_length", "numeric_precision", "numeric_scale")
STATISTICS_DETAILS = ("n_live_tup", "n_dead_tup", "n_mod_since_analyze", "n_tup_ins", "n_tup_upd", "n_tup_del", "last_vacuum", "last_autovacuum",
                      "last_analyze", "last_autoanalyze", "vacuum_count", "autovacuum_count", "analyze_count", "autoanalyze_count")


def present(rows: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of the names that the rows have."""
    return [name for name in names if name in rows.columns]


def columns_section(columns: DataFrame) -> DataFrame:
    """Columns of user schemas with flags by server version; empty expressions are missing values."""
    version = F.col("version")
    return columns.filter(user_schema(F.col("table_schema"))).select(
        "server_id", "table_schema", "table_name", "column_name", "ordinal_position",
        F.coalesce("column_default", F.lit("")).alias("column_default"), (F.col("is_nullable") == "YES").alias("is_nullable"), "data_type",
        since(version, IDENTITY, F.col("is_identity") == "YES", F.lit(False)).alias("is_identity"),
        since(version, GENERATED, F.col("is_generated") != "NEVER", F.lit(False)).alias("is_generated"),
        F.nullif(since(version, GENERATED, F.coalesce("generation_expression", F.lit("")), F.lit("")), F.lit("")).alias("generation_expression"),
        *present(columns, COLUMN_DETAILS))


def table_statistics(classes: DataFrame, namespaces: DataFrame, index_scans: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Table statistics with the scans of all indexes of the table; null when it has none."""
    keys = list(keys)
    scans = index_scans.groupBy(*keys, F.col("indrelid").alias("oid")).agg(F.sum("numscans").alias("idx_scan"))
    schemas = namespaces.select(*keys, F.col("oid").alias("relnamespace"), F.col("nspname").alias("schemaname"))
    kept = ~F.col("schemaname").isin("pg_catalog", "information_schema") & ~F.startswith("schemaname", F.lit("pg_toast"))
    return (lookup(classes.filter(relkind_filter(F.col("relkind"), statistics=True)), schemas, [*keys, "relnamespace"], "inner")
            .filter(kept).join(scans, [*keys, "oid"], "left")
            .select(*keys, F.col("oid").alias("relid"), "schemaname", "relname", "seq_scan", "idx_scan", *present(classes, STATISTICS_DETAILS)))


def engine_merge(support: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Supported engines with their sizes; engines without tables have zeros, unsupported ones are left out."""
    values = ("tables", "total_size", "data_size", "index_size")
    return support.join(sizes, [*keys, "engine"], "left").fillna(0, subset=["tables"]).withColumns(
        {v: F.coalesce(F.col(v), F.lit(0).cast(sizes.schema[v].dataType)) for v in values})


def myisam_index_size(engines: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Index size of one engine per server, 0 when the server has none."""
    value = F.max(F.when(F.col("engine") == "MyISAM", F.col("index_size")))
    return engines.groupBy(*keys).agg(F.coalesce(value, F.lit(0).cast(engines.schema["index_size"].dataType)).alias("myisam_index_size"))


def role_membership(roles: DataFrame, grants: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Roles with the sorted list of roles granted to them, '' if none.

    Grants are counted per pair first, so repeated grants do not reach the list's task one by one.
    """
    keys = list(keys)
    pairs = grants.groupBy(*keys, "member", "roleid").agg(F.count(F.lit(1)).alias("_times"))
    names = roles.select(*keys, F.col("oid").alias("roleid"), F.col("rolname").alias("granted"))
    listed = lookup(pairs, names, [*keys, "roleid"], "inner").groupBy(*keys, F.col("member").alias("oid")).agg(
        F.array_sort(F.flatten(F.collect_list(F.expr("array_repeat(granted, int(_times))")))).alias("_granted"))
    return (roles.join(listed, [*keys, "oid"], "left")
            .withColumn("member_of", F.coalesce(F.array_join("_granted", ","), F.lit(""))).drop("_granted"))


def open_sections(rows: DataFrame, failures: DataFrame, collected: DataFrame, sections: Sequence[str],
                  keys: Sequence[str] = ("server_id", "database")) -> DataFrame:
    """Number of published rows per section; sections that failed are left out, good empty ones stay with 0."""
    keys = list(keys)
    expected = collected.select(*keys).distinct().withColumn("section", F.explode(F.array(*[F.lit(s) for s in sections])))
    good = expected.join(failures.select(*keys, "section").distinct(), [*keys, "section"], "left_anti")
    counts = rows.groupBy(*keys, "section").agg(F.count(F.lit(1)).alias("_rows"))
    return good.join(counts, [*keys, "section"], "left").withColumn("rows", F.coalesce("_rows", F.lit(0))).drop("_rows")


def published_rows(rows: DataFrame, failures: DataFrame, keys: Sequence[str] = ("server_id", "database")) -> DataFrame:
    """The rows of all sections that did not fail; a section that failed in one database stays in the others."""
    return rows.join(failures.select(*keys, "section").distinct(), [*keys, "section"], "left_anti")


def ordered_catalogue(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in catalogue order for the sink: ranges of the order go to one file each, sorted inside."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def sorted_names(names: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """The distinct parameter names of a server in byte order; at most one entry per known parameter."""
    return names.select(*keys, "name").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("name")).alias("names"))
