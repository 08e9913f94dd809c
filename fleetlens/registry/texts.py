"""Queries over statement texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from . import bindings as b
from .base import Tables, query
from .catalog import pick

PREFIXES = (
    "select $1 ", "/* c */ with upd as (update orders set status = 1 returning id) select ", "-- c\ninsert into orders (id) values (1) ",
    "select '$1', \"insert into x values\" ", "explain ", "merge into t using s on true when matched then delete; ", "  delete from only t where x = $2 ",
    "WITH update AS (SELECT 1) SELECT * FROM update, ")

SPACE = r"[ \t\n\r\f]"
LEADING = rf"(?s)^(?:{SPACE}+|--[^\n]*|/\*.*?\*/)*([A-Za-z]*)"
NAME = r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_$\x{80}-\x{10FFFF}]*"
MASK = "|".join([
    r"--[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/", r"(/\*).*", r"(?:[eE]|[uU]&)'(?:[^'\\]|\\.|'')*(?:'|\z)", r"'[^']*(?:'|\z)",
    rf"({NAME}|[0-9][A-Za-z0-9_$\x{{80}}-\x{{10FFFF}}]*)", r'(")(?:[^"]|"")*(?:"|\z)', r"\$\$.*?\$\$", r"(\$)(?:[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*)?\$.*"])
ID = rf'(?:"|{NAME})'
PLACE = rf"(?:only\s*(?:\(\s*{ID}\s*\)|{ID})|{ID})\s*(?:\.\s*{ID}\s*)?"
REST = r"(?:values|default|overriding|select|with|table)\s"
MODIFYING = (rf"(?i)(?:^|[^A-Za-z0-9_$])(?:insert\s+(?:into\s+)?{PLACE}(?:\(|{REST}|(?:as\s+)?{ID}\s*(?:\(|{REST}))|merge\s+into\s|delete\s+from\s"
             rf"|update\s+{PLACE}\*?\s*(?:as\s+{ID}\s*set\s|set\s|{ID}\s*set\s))")


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


CORPUS = f"""
corpus AS (SELECT doc_id, doc_id % 10 AS server_id, lang AS schema_name, ({strings(PREFIXES)})[CAST(doc_id % 8 AS INTEGER) + 1] || text AS text FROM documents),
masked AS (SELECT *, regexp_replace(text, {quoted(MASK)}, '\\1\\2\\3\\4 ', 'gs') AS m FROM corpus),
profile AS (SELECT doc_id, server_id, schema_name, lower(regexp_extract(text, {quoted(LEADING)}, 1)) AS leading_word, lower(regexp_extract(text, {quoted(LEADING)}, 1)) IN ('select', 'with') AS explainable,
  regexp_matches(m, '\\$[0-9]') AS has_parameter, regexp_matches(replace(lower(m), 'update as ', ''), {quoted(MODIFYING)}) AS data_modifying,
  contains(m, '/*') OR m LIKE '%$ ' AS unread_tail FROM masked)"""


def corpus(t: Tables):
    return t.documents.select("doc_id", (F.col("doc_id") % 10).alias("server_id"), F.col("lang").alias("schema_name"),
                              F.concat(pick(PREFIXES, "doc_id"), F.col("text")).alias("text"))


@query("statement_profile", f"WITH {CORPUS} SELECT * FROM profile")
def statement_profile(t: Tables):
    return tx.statement_profile(corpus(t)).drop("text")


@query("statement_corpus_profile", f"""WITH {CORPUS} SELECT server_id, schema_name, leading_word, count(*) AS statements, count(*) FILTER (WHERE explainable) AS explainable,
  count(*) FILTER (WHERE has_parameter) AS with_parameter, count(*) FILTER (WHERE data_modifying) AS data_modifying, count(*) FILTER (WHERE unread_tail) AS unread_tail
FROM profile GROUP BY ALL""")
def statement_corpus_profile(t: Tables):
    return tx.corpus_profile(corpus(t), ["server_id", "schema_name"])


# Comments as deep as the document's number says, with quotes and dollars that mean nothing inside; one in some texts is not closed.
NESTED = r"""nested AS (SELECT doc_id, repeat('/* don''t $1 ', CAST(doc_id % 50 AS INTEGER) + 1) || repeat('end */ ', CAST(doc_id % 50 AS INTEGER) + 1)
    || CASE doc_id % 3 WHEN 0 THEN 'select ' WHEN 1 THEN 'with n as (delete from t) select ' ELSE 'show ' END || CASE WHEN doc_id % 4 = 0 THEN '$2 ' ELSE chr(39) || '$2' || chr(39) || ' ' END
    || repeat('/* "', CAST(doc_id % 7 AS INTEGER)) || repeat(' */', CAST(doc_id % 7 AS INTEGER) - CASE WHEN doc_id % 21 = 1 THEN 1 ELSE 0 END) || translate(text, '-*/$"\' || chr(39), '       ') AS m FROM documents),
peeled AS (SELECT doc_id, m FROM nested UNION ALL SELECT doc_id, regexp_replace(m, '/\*[^*/]*\*/', ' ', 'g') FROM peeled WHERE regexp_matches(m, '/\*[^*/]*\*/')),
flat AS (SELECT doc_id, m FROM peeled WHERE NOT regexp_matches(m, '/\*[^*/]*\*/'))"""


def nested(t: Tables):
    doc = F.col("doc_id")
    times = lambda word, n: F.repeat(F.lit(word), n.cast("int"))
    deep, small = doc % 50 + 1, doc % 7
    body = F.concat(
        times("/* don't $1 ", deep), times("end */ ", deep), F.when(doc % 3 == 0, "select ").when(doc % 3 == 1, "with n as (delete from t) select ").otherwise("show "),
        F.when(doc % 4 == 0, "$2 ").otherwise("'$2' "), times('/* "', small), times(" */", small - F.when(doc % 21 == 1, 1).otherwise(0)))
    return t.documents.select("doc_id", F.concat(body, F.translate("text", "-*/$'\"\\", " " * 7)).alias("text"))


@query("statement_profile_nested", f"""WITH RECURSIVE {NESTED} SELECT doc_id, regexp_extract(ltrim(m), '^[a-z]*') AS leading_word, regexp_extract(ltrim(m), '^[a-z]*') IN ('select', 'with') AS explainable,
  doc_id % 4 = 0 AS has_parameter, doc_id % 3 = 1 AS data_modifying, contains(m, '/*') AS unread_tail FROM flat""")
def statement_profile_nested(t: Tables):
    """Comments up to fifty deep; the SQL takes the innermost ones out again and again."""
    return tx.statement_profile(nested(t)).drop("text")


# Texts with @ for the table, and the reason each one is refused for.
DDL = [
    ("ALTER TABLE @ DROP COLUMN note", None),
    ("ALTER ONLINE TABLE shop.@ ALTER COLUMN price SET DEFAULT (1 + (2 * (3)))", None),
    ("CREATE FULLTEXT INDEX ft ON `shop`.`@` (title)", None),
    ("CREATE INDEX IF NOT EXISTS by_day USING BTREE ON @ (day) LOCK NONE", None),
    ("ALTER TABLE `@` FORCE, ALGORITHM=INSTANT", None),
    ("ALTER TABLE shop.@ CHANGE COLUMN a b BIGINT", None),
    ("ALTER TABLE @ RENAME INDEX i TO j -- later", None),
    ("ALTER TABLE @ MODIFY\tc INT", None),
    ("ALTER TABLE @ ADD d INT, DROP  PRIMARY\n KEY", None),
    ("ALTER TABLE @ /* widen */ ADD SPATIAL INDEX (p)", None),
    ("ALTER TABLE @ COMMENT 'modify later' -- MODIFY c", None),
    ("ALTER TABLE @ ADD KEY k ((lower(title))), LOCK = NONE", None),
    ("ALTER TABLE @ COMMENT 'a ; RENAME TO b' # LOCK=SHARED", None),
    ("ALTER TABLE shop.@ RENAME AS archive", "table-rename"),
    ("ALTER TABLE @ ADD c INT CHECK (((((((((c > 0))))))))), RENAME TO shop.x", "table-rename"),
    ("ALTER TABLE @ ADD c INT DEFAULT (((((((((((1))))))))))), ALGORITHM = COPY", "copy-algorithm"),
    ("ALTER TABLE @ ENGINE=InnoDB, ALGORITHM DEFAULT", "copy-algorithm"),
    ("ALTER TABLE @ ENGINE=InnoDB, ALGORITHM=FAST", "unknown-algorithm"),
    ("ALTER TABLE @ FORCE, LOCK EXCLUSIVE", "blocking-lock"),
    ("ALTER TABLE @ FORCE, LOCK=SOFT", "unknown-lock"),
    ("ALTER TABLE @ FORCE, LOCK=", "invalid-lock-clause"),
    ("ALTER TABLE @ FORCE, ALGORITHM=NOCOPY, ALGORITHM=INSTANT", "invalid-algorithm-clause"),
    ("ALTER TABLE @ EXCHANGE PARTITION p9 WITH TABLE cold", "exchange-partition"),
    ("ALTER TABLE @ ADD d INT /*! COMMENT 'x' */", "executable-comment"),
    ("ALTER TABLE @ COMMENT = 'don\\'t'", "backslash-quote"),
    ("ALTER TABLE @ FORCE; DROP TABLE @", "several-statements"),
    ("ALTER TABLE @ ADD e INT DEFAULT ((1)", "not-read"),
    ("ALTER TABLE archive.@ FORCE", "target-mismatch"),
    ("DROP TABLE @", "no-target"),
]

AUDIT = f"""
statements AS (SELECT p_partkey, p_size % 5 AS server_id, CAST(p_partkey % {len(DDL)} AS INTEGER) + 1 AS k, 'stock' || CAST(p_partkey AS VARCHAR) AS target FROM part),
audit AS (SELECT p_partkey, server_id, replace(({b.sql_list([d for d, _ in DDL])})[k], '@', target) AS ddl_statement, ({b.sql_list([r for _, r in DDL])})[k] AS reason,
  NOT regexp_matches(upper(replace(({b.sql_list([d for d, _ in DDL])})[k], '@', target)),
    '(?:STOCK[0-9]+`?|,)\\s+(?:/[*].*?[*]/\\s+)?(?:ADD\\s+(?:FULLTEXT|SPATIAL)|DROP\\s+PRIMARY|MODIFY|CHANGE)\\b') AS static_online FROM statements)"""


def audited(t: Tables):
    target = F.concat(F.lit("stock"), F.col("p_partkey").cast("string"))
    statements = t.part.select("p_partkey", (F.col("p_size") % 5).alias("server_id"), F.replace(pick([d for d, _ in DDL], "p_partkey"), F.lit("@"), target).alias("ddl_statement"),
                               F.lit("shop").alias("schema_name"), F.lit("shop").alias("target_schema"), target.alias("target_table"))
    return tx.ddl_audit(statements)


@query("ddl_audit", f"WITH {AUDIT} SELECT p_partkey, ddl_statement, reason, static_online FROM audit")
def ddl_audit(t: Tables):
    return audited(t).select("p_partkey", "ddl_statement", "reason", "static_online")


@query("ddl_reason_counts", f"WITH {AUDIT} SELECT server_id, coalesce(reason, 'accepted') AS reason, count(*) AS statements FROM audit GROUP BY ALL")
def ddl_reason_counts(t: Tables):
    return tx.ddl_reason_counts(audited(t), ["server_id"])
