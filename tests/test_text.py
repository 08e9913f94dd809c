"""Truth tables over statement texts and schema changes."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.operators import filters
from fleetlens.registry import texts


@pytest.fixture(scope="module")
def profile(spark):
    def run(text):
        return tx.statement_profile(spark.createDataFrame([(text,)], "text string")).first()
    return run


@pytest.mark.parametrize("text,want", [
    ("select a from t where b > $2", True), ("select 'costs $5'", False), ("select 2 /* was $3 */", False), ("select $q$ pay $4 now $q$", False),
    ('select "col$1", 3 from t', False), ("select 4 -- $6\n", False), ("select 5 -- y\n - $7", True), ("select E'a\\'b $8' , 6", False),
    ("select 'o''clock' || $9", True), ("select $$ $1 $$", False), ("select /* x /* $2 */ y */ 7", False), ("select /* x /* y */ */ $3", True)])
def test_parameters(profile, text, want):
    assert profile(text)["has_parameter"] is want


@pytest.mark.parametrize("text,want", [
    ("with gone as (delete from logs where day < 3 returning 1) select count(*) from gone", True), ("with delete as (select 2) table delete", False),
    ("select 'update t set a = 1'", False), ("with n as (insert into logs (a) values (2) returning a) table n", True),
    ("update only (logs) set a = 3", True), ("merge into logs l using new n on l.a = n.a when not matched then do nothing", True),
    ("with update as (select 3) select 4", False), ('update "Logs" as l set a = 1', True), ("select a from logs for no key update", False),
    ("select b /* delete from logs */ from logs", False), ('insert into "x"."y" select 5', True)])
def test_data_modifying(profile, text, want):
    assert profile(text)["data_modifying"] is want


@pytest.mark.parametrize("text,want", [
    ("select 1", "select"), ("\n\tWith x as (select 2) table x", "with"), ("/* job 7 */select 3", "select"), ("-- note\n--\nselect 4", "select"),
    ("delete from t", "delete"), ("SHOW TABLES", "show"), ("", ""), ("/* never closed select 5", ""), ("((select 6))", "")])
def test_leading_word(spark, text, want):
    row = spark.range(1).select(tx.mysql_leading_word(F.lit(text)).alias("m"), tx.postgres_leading_word(F.lit(text)).alias("p")).first()
    assert (row["m"], row["p"]) == (want, want)


def test_nested_comments(spark):
    nested = {"/* a /* b */ c */ select 1": "select", "/* 1 /* 2 /* 3 */ */ */ select 1": "select", "/* 1 /* 2 */ select 1": "",
              "/* a /* b /* c /* d /* e */ */ */ */ */ -- x\n With y": "with", "/* 1 /* 2 /* 3 /* 4 */ */ */ */ 'a' select": "",
              "/* 1 /* 2 /* 3 /* 4 */ */ */ */ $$ select $$": "", "/* 1 /* 2 /* 3 /* 4 */ */ */ select 5": ""}
    df = spark.createDataFrame(list(nested.items()), "t string, want string")
    for row in df.select("t", "want", tx.postgres_leading_word(F.col("t")).alias("x")).collect():
        assert row.x == row.want, row.t
    assert spark.range(1).select(tx.unread_tail(tx.postgres_masked(F.lit("select 1 /* open"))).alias("x")).first()["x"]


def test_long_texts_do_not_exhaust_the_stack(profile):
    body = "('it''s', E'a\\\\b', \"c\") /* x * y / z */ -- t\n" * 20000
    assert profile("select " + body + " + $3")["has_parameter"]


@pytest.fixture(scope="module")
def audit(spark):
    """All cases in one job: target and reason by text."""
    cases = [d.replace("@", "stock") for d, _ in texts.DDL] + [d for d, _, _ in TARGETS] + [d for d, _ in DEEP] + [None]
    df = spark.createDataFrame([(d, "shop", "shop", "stock") for d in cases], "ddl_statement string, schema_name string, target_schema string, target_table string")
    return {r.ddl_statement: ((r.ddl_schema, r.ddl_table), r.reason) for r in tx.ddl_audit(df).collect()}


TARGETS = [("ALTER TABLE", ("shop", ""), "no-target"), ("ALTER TABLE `a``b`.`we``ird` FORCE", ("a`b", "we`ird"), "target-mismatch"),
           ('CREATE OR REPLACE UNIQUE INDEX i ON "stock" (a)', ("shop", "stock"), None), ("ALTER TABLE IF EXISTS shop . stock FORCE", ("shop", "stock"), None),
           ("ALTER TABLE shop. FORCE", ("shop", "FORCE"), "target-mismatch"), ("ALTER TABLE shop.", ("shop", ""), "no-target"),
           ("CREATE INDEX i ON stock", ("shop", "stock"), None), ("CREATE TABLE stock (a INT)", ("shop", ""), "no-target"),
           ("ALTER /* x */ TABLE -- y\n stock FORCE", ("shop", "stock"), None), ("ALTER TABLE stock FORCE;", ("shop", "stock"), None)]
DEEP = [(f"ALTER TABLE stock ADD a INT DEFAULT {'(' * n}1{')' * n}, {rest}", reason) for n in (1, 7, 8, 9, 10, 40)
        for rest, reason in (("RENAME TO shop.other", "table-rename"), ("ALGORITHM=COPY", "copy-algorithm"), ("LOCK=NONE", None))]
DEEP += [("ALTER TABLE stock ADD a INT DEFAULT ((1), RENAME TO shop.other", "not-read"), ("ALTER TABLE stock ADD a INT), FORCE", "not-read")]


def test_ddl_reasons(audit):
    assert {d: audit[d][1] for d in (d.replace("@", "stock") for d, _ in texts.DDL)} == {d.replace("@", "stock"): r for d, r in texts.DDL}
    assert audit[None] == (("shop", ""), "no-target")


def test_ddl_targets(audit):
    assert {d: audit[d] for d, _, _ in TARGETS} == {d: (t, r) for d, t, r in TARGETS}


def test_parentheses_are_left_out_at_any_depth(audit):
    assert {d: audit[d][1] for d, _ in DEEP} == dict(DEEP)


def test_deeply_nested_comment_is_no_refusal(spark):
    df = spark.createDataFrame([("/* 1 /* 2 /* 3 /* 4 */ */ */ */ select 1",), ("/* 1 */ select 1",), ("drop table t",), ("/* 1 /* 2 /* 3 /* 4 */ */ */ select 1",)], "q string")
    reason = filters.postgres_candidate_reason(F.lit("db"), F.col("q"), F.lit(""), F.lit(False))
    assert [r[0] for r in df.select(reason).collect()] == [None, None, "not-explainable", "not-read"]


def test_comments_at_any_depth(spark):
    """Quotes, dollars and dashes inside mean nothing, and what follows is read as ever."""
    rows = []
    for depth in (1, 3, 4, 50, 400):
        comment = "/* it's $x$ -- \" " * depth + " */" * depth
        quoted, named = comment.replace("'", "''"), comment.replace('"', '""')
        rows += [(f"{comment} select '{quoted}', \"{named}\", $q${comment}$q$ {comment} from t", ("select", True, False, False, False)),
                 (f"with a as (delete {comment} from t) select E'\\'{quoted}' + $1 {comment}", ("with", True, True, True, False)),
                 (f"select 1 {comment} /* $1", ("select", True, False, False, True))]
    got = tx.statement_profile(spark.createDataFrame([(t,) for t, _ in rows], "text string")).collect()
    assert {r.text: tuple(r)[1:] for r in got} == {t: want for t, want in rows if "it's" in t} and len(got) == 15


def by_hand(text):
    """Masked text by a walk over characters."""
    out, at, n = [], 0, len(text)
    is_word = lambda c: c.isascii() and c.isalnum() or c in "_$" or c >= "\x80"
    while at < n:
        prior = text[at - 1] if at else " "
        if text.startswith("/*", at):
            depth, at = 1, at + 2
            while at < n and depth:
                step = {"/*": 1, "*/": -1}.get(text[at:at + 2], 0)
                depth, at = depth + step, at + (2 if step else 1)
            out.append(" " if not depth else "/* ")
        elif text.startswith("--", at):
            at = text.find("\n", at) if "\n" in text[at:] else n
            out.append(" ")
        elif (match := re.compile(r"(?:[eE]|[uU]&)?'").match(text, at)) and not (len(match[0]) > 1 and is_word(prior)):
            escaped, at = len(match[0]) > 1, match.end()
            while at < n:
                if escaped and text[at] == "\\":
                    at += 2
                elif text.startswith("''", at):
                    at += 2
                else:
                    at += 1
                    if text[at - 1] == "'":
                        break
            out.append(" ")
        elif text[at] == '"':
            at += 1
            while at < n and (text[at] != '"' or text.startswith('""', at)):
                at += 2 if text[at] == '"' else 1
            at += 1
            out.append('" ')
        elif not is_word(prior) and (match := re.compile(r"\$(?:[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*)?\$").match(text, at)):
            end = text.find(match[0], match.end())
            out.append(" " if end >= 0 else "$ ")
            at = end + len(match[0]) if end >= 0 else n
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def test_masking_equals_a_walk_by_hand(spark):
    rng = random.Random(6)
    bits = ["'", "''", "E'", "u&'", "\\", "\\'", '"', "$$", "$q$", "$q", "$1", " $", "/*", "*/", "/", "*", "-", "--", "\n", " ", "a", "x1", "é", "select", "(", ";", "e"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(1500)]
    texts += ["/*" * 5 + "".join(rng.choices(bits, k=10)) + "*/" * 5 + "".join(rng.choices(bits, k=20)) for _ in range(700)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", tx.postgres_masked(F.col("t")).alias("m"), F.replace(tx._walked(F.col("t")), F.lit("'"), F.lit(" ")).alias("w"))
    short = lambda x: re.sub(" +", " ", x).strip(" ")
    for row in df.collect():
        assert short(row.m) == short(row.w) == short(by_hand(row.t)), row.t


def test_a_long_deep_text_is_read_in_time(profile):
    body = "/* /* /* /* x */ */ */ */ ('it''s', $1) " * 4000
    started = time.perf_counter()
    assert tuple(profile("select " + body))[1:] == ("select", True, True, False, False)
    assert time.perf_counter() - started < 60


ONLINE = [("MODIFY\tc INT", False), ("DROP  PRIMARY  KEY", False), ("drop primary key", False), ("ADD c INT, CHANGE a b INT", False), ("ADD\nFULLTEXT KEY (a)", False),
          ("ADD SPATIAL INDEX i (p)", False), ("MODIFY COLUMN c INT", False), ("ADD COLUMN modify INT", True), ("COMMENT 'MODIFY COLUMN c'", True),
          ("FORCE /* DROP PRIMARY KEY */", True), ("ADD `change` INT", True), ("DROP COLUMN a, ADD INDEX (b)", True), ("ALTER c SET DEFAULT (modify (1))", True)]


def test_online_is_decided_on_tokens(spark):
    df = spark.createDataFrame([(f"ALTER TABLE stock {d}", "shop", "shop", "stock") for d, _ in ONLINE], "ddl_statement string, schema_name string, target_schema string, target_table string")
    got = {r.ddl_statement: r.static_online for r in tx.ddl_audit(df).collect()}
    assert got == {f"ALTER TABLE stock {d}": online for d, online in ONLINE}


def test_names_may_differ_in_case(spark):
    df = spark.createDataFrame([("ALTER TABLE SHOP.Stock FORCE", "shop", "shop", "stock")], "ddl_statement string, schema_name string, target_schema string, target_table string")
    assert tx.ddl_audit(df).first()["reason"] == "target-mismatch"
    assert tx.ddl_audit(df, lower_case_names=F.lit(True)).first()["reason"] is None


def test_deep_comments_are_read_by_one_expression(spark):
    """Only texts with an unclosed comment or one deeper than the expression reads are walked; runs without marks are one piece."""
    text = "/* it's " * 50 + "*/ " * 50 + "select $1"
    df = spark.createDataFrame([(text, "/* a, b c; d " * 65 + "*/" * 65 + " with n as (delete from t) select 1")], "t string, u string")
    row = df.select(tx._flat_masked(F.col("t")).alias("m"), tx.postgres_leading_word(F.col("u")).alias("word"), tx.is_data_modifying(tx.postgres_masked(F.col("u"))).alias("modifying"),
                    F.size(F.regexp_extract_all(F.lit("one, two (three) four E'a b' $1"), F.lit(tx.PIECE), F.lit(0))).alias("pieces")).first()
    assert tuple(row) == ("  select $1", "with", True, 7)
