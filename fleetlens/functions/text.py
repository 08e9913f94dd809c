"""Expressions over statement texts: leading word, masked text, and the commands and clauses found in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import bound, scan

# Tokens of the two SQL dialects as regular expressions.
HIGH = r"\x{0080}-\x{10FFFF}"
MYSQL_SPACE = r"[ \t\n\r\f\x0B]"
POSTGRES_SPACE = r"[ \t\n\r\f]"
LINE_COMMENT = r"--[^\n]*+"
FLAT_COMMENT = r"/\*.*?\*/"
COMMENT_TEXT = r"[^*/]++|\*(?!/)|/(?!\*)"
COMMENT_DEPTH = 64
NESTED = rf"/\*(?:{COMMENT_TEXT})*+\*/"
for _ in range(COMMENT_DEPTH - 1):
    NESTED = rf"/\*(?:{COMMENT_TEXT}|{NESTED})*+\*/"
ESCAPE_STRING = rf"(?<![A-Za-z0-9_${HIGH}])(?:[eE]|[uU]&)'(?:[^'\\]++|\\(?:.|\z)|'')*+(?:'|\z)"
PLAIN_STRING = r"'[^']*+(?:'|\z)"
WORD = rf"[A-Za-z_{HIGH}][A-Za-z0-9_${HIGH}]*+"
WORD_END = rf"(?![A-Za-z0-9_${HIGH}])"
TAG = rf"[A-Za-z_{HIGH}][A-Za-z0-9_{HIGH}]*+"
BACKTICK_NAME = r"`(?:[^`]++|``)*+(?:`|\z)"
BACKSLASH_STRING = r"'(?:[^'\\]++|\\.|'')*+(?:'|\z)"
BACKSLASH_NAME = r'"(?:[^"\\]++|\\.|"")*+(?:"|\z)'
HASH_COMMENT = r"#[^\r\n]*+"
DASH_COMMENT = r"--(?=[\x00-\x20\x7F]|\z)[^\r\n]*+"
BLOCK_COMMENT = r"/\*.*?(?:\*/|\z)"

# Words that decide what a statement may do.
EXPLAINABLE = ("select", "with")
INSERT_REST = "values|default|overriding|select|with|table"
MYSQL_SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "NULL")
POSTGRES_SKIPPED_DATABASES = ("template0", "template1", "NULL")
ONLINE_ALGORITHMS = ("INPLACE", "INSTANT", "NOCOPY")
COPY_ALGORITHMS = ("COPY", "DEFAULT")
SHARED_LOCKS = ("DEFAULT", "SHARED", "EXCLUSIVE")

# Words between the command and the name of its target, as the server's grammar has them.
ALTER_OPTIONS = ("ONLINE", "IGNORE")
INDEX_KINDS = ("UNIQUE", "FULLTEXT", "SPATIAL")
ALGORITHM_WORDS = ("DEFAULT", "INPLACE", "COPY", "INSTANT", "NOCOPY")
LOCK_WORDS = ("DEFAULT", "NONE", "SHARED", "EXCLUSIVE")
RENAMED_PARTS = ("COLUMN", "INDEX", "KEY")

# Clauses of ALTER TABLE during which others may not write, as the server's manual on online changes has them.
REDEFINING_VERBS = ("CHANGE", "MODIFY")
BLOCKING_INDEXES = ("FULLTEXT", "SPATIAL")
DDL_WORD = rf"[A-Za-z0-9_${HIGH}]++"
DDL_TOKEN = rf"(?s){DDL_WORD}|`(?:[^`]|``)*+`|\"(?:[^\"]|\"\")*+\"|\S"


def mysql_leading_word(text: Column) -> Column:
    """The first word after spaces and comments, in lower case; empty when there is none."""
    return F.lower(F.regexp_extract(text, rf"(?s)^(?:{MYSQL_SPACE}++|{LINE_COMMENT}|{FLAT_COMMENT})*+([A-Za-z]*)", 1))


def _flat_leading_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, rf"(?s)^(?:{POSTGRES_SPACE}++|{LINE_COMMENT}|{NESTED})*+([A-Za-z]*)", 1))


def _leading_deep(text: Column) -> Column:
    """Whether a comment that one regular expression cannot read stands before the first word."""
    return F.coalesce(text.rlike(rf"(?s)^(?:{POSTGRES_SPACE}++|{LINE_COMMENT}|{NESTED})*+/\*"), F.lit(False))


def _walked_leading_word(walked: Column) -> Column:
    return F.lower(F.regexp_extract(walked, rf"^{POSTGRES_SPACE}*+([A-Za-z]*)", 1))


def postgres_leading_word(text: Column) -> Column:
    """The first word after spaces and comments, which may nest; empty when there is none."""
    return F.when(_leading_deep(text), _walked_leading_word(_walked(text))).otherwise(_flat_leading_word(text))


def leading_unread(text: Column) -> Column:
    """Whether a comment stands before the first word that is never closed."""
    return F.when(_leading_deep(text), _walked(text).rlike(rf"^{POSTGRES_SPACE}*+/\* \z")).otherwise(False)


# Fixed value: the pieces of a text that may change how the rest is read, and the runs between them.
ESCAPE_START = rf"(?<![A-Za-z0-9_${HIGH}])(?:[eE]|[uU]&)'"
PIECE = (rf"(?s){ESCAPE_START}'*+|'+|\"+|[$\\\n*/-]|"
         rf"(?:(?!{ESCAPE_START})[A-Za-z0-9_{HIGH}]++|[^A-Za-z0-9_{HIGH}$'\"\\\n*/-]++)++")


def _walked(text: Column) -> Column:
    """The text without comments, however deep they nest, read piece by piece with a counter of their depth.

    A string is left as a single quote, else as in ``postgres_masked``.
    """
    known: dict = {}

    def lit(value) -> Column:
        if isinstance(value, Column):
            return value
        key = (type(value), value)
        if key not in known:
            known[key] = F.lit(value)
        return known[key]

    def state_of(mode, depth, tag, held, word, out) -> Column:
        fields = {"mode": mode, "depth": depth, "tag": tag, "held": held, "word": word, "out": out}
        return F.named_struct(*[lit(x) for pair in fields.items() for x in pair])

    def step(state: Column, piece: Column) -> Column:
        mode, depth, tag, held = state["mode"], state["depth"], state["tag"], state["held"]
        first, both = F.substring(piece, 1, 1), F.concat(held, piece)
        quotes = F.length(piece) - F.length(F.replace(piece, lit("'"), lit("")))
        names, odd, odd_names = first == '"', quotes % 2 == 1, F.length(piece) % 2 == 1
        ends_word = piece.rlike(rf"[A-Za-z0-9_{HIGH}]\z")
        star, slash, dollar_sign, back = piece == "*", piece == "/", piece == "$", piece == "\\"

        def to(mode, out="", keep="", level=depth, open_tag=tag, after=False) -> Column:
            return state_of(mode, level, open_tag, keep, after, out)

        code = (F.when(quotes > 0, to(F.when(~odd, "code").when(first == "'", "str").otherwise("estr"), F.concat(held, lit("'"))))
                .when(names, to(F.when(odd_names, "name").otherwise("code"), F.concat(held, lit('" '))))
                .when(star & (held == "/"), to("comment", level=1))
                .when((piece == "-") & (held == "-"), to("line", " "))
                .when(dollar_sign & held.startswith("$"), to("dollar", open_tag=both))
                .when(slash | (piece == "-") | (dollar_sign & ~state["word"]), to("code", held, piece))
                .when((held == "$") & piece.rlike(rf"^{TAG}\z"), to("code", "", both))
                .otherwise(to("code", both, after=ends_word | dollar_sign)))
        line = F.when(piece == "\n", to("code", piece)).otherwise(to("line"))
        string = F.when(odd, to("code")).otherwise(to("str"))
        # The character behind a backslash is part of the string, whatever it is.
        escaped = (F.when((quotes - ((held == "\\") & (first == "'")).cast("int")) % 2 == 1, to("code"))
                   .otherwise(to("estr", keep=F.when(back & (held == ""), piece).otherwise(""))))
        name = F.when(names & odd_names, to("code")).otherwise(to("name"))
        dollar = (F.when(dollar_sign & (both == tag), to("code", "'", after=True))
                  .otherwise(to("dollar", keep=F.when(dollar_sign, piece).when((held == "$") & piece.rlike(rf"^{TAG}\z"), both).otherwise(""))))
        closes = slash & (held == "*")
        comment = (F.when(closes & (depth == 1), to("code", " ", level=0)).when(closes, to("comment", level=depth - 1))
                   .when(star & (held == "/"), to("comment", level=depth + 1))
                   .otherwise(to("comment", keep=F.when(slash | star, piece).otherwise(""))))
        return (F.when(mode == "comment", comment).when(mode == "code", code).when(mode == "line", line).when(mode == "str", string)
                .when(mode == "estr", escaped).when(mode == "name", name).otherwise(dollar))

    done = scan(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), state_of("code", 0, "", "", False, ""), step)

    def whole(found: Column) -> Column:
        end = found["state"]
        rest = F.when(end["mode"] == "comment", "/* ").when(end["mode"] == "dollar", "$ ").when(end["mode"] == "code", end["held"]).otherwise("")
        return F.concat(F.array_join(found["outs"], ""), rest)
    return bound(done, whole)


def is_explainable(leading_word: Column) -> Column:
    """Whether a plan can be asked for."""
    return leading_word.isin(*EXPLAINABLE)


def _flat_masked(text: Column) -> Column:
    tokens = "|".join([
        LINE_COMMENT, NESTED, r"(/\*).*+", ESCAPE_STRING, PLAIN_STRING, r'(")(?:[^"]|"")*+(?:"|\z)',
        rf"(?<![A-Za-z0-9_${HIGH}])(?:\$\$.*?\$\$|(\${TAG}\$).*?\3|(\$)(?:{TAG})?\$.*+)",
    ])
    return F.regexp_replace(text, rf"(?s)(?=[-/eEuU'\"$])(?:{tokens})", "$1$2$4 ")


def _strings_blank(walked: Column) -> Column:
    return F.replace(walked, F.lit("'"), F.lit(" "))


def postgres_masked(text: Column) -> Column:
    """The text without comments and strings; a quoted name is left as a single double quote.

    Comments nest to any depth. Reading stops at a comment or dollar string that is never closed; its opening stays in the
    result as a slash and star or a bare dollar sign at the end. One regular expression reads comments up to ``COMMENT_DEPTH``
    deep; only texts where it stops at a comment are walked piece by piece.
    """
    flat = _flat_masked(text)
    return F.when(flat.endswith("/* "), _strings_blank(_walked(text))).otherwise(flat)


def unread_tail(masked: Column) -> Column:
    """Whether masking had to stop before the end of the text."""
    return masked.contains("/*") | masked.rlike(r"\$ \z")


def has_parameter(masked: Column) -> Column:
    """Whether a numbered parameter stands outside of strings, names and comments."""
    return masked.rlike(r"\$[0-9]")


def is_data_modifying(masked: Column) -> Column:
    """Whether an insert, update, delete or merge command stands in the text."""
    name = rf'(?:"|{WORD})'
    only = rf"(?:only{WORD_END}\s*(?:\(\s*{name}\s*\)|{name})|(?!only{WORD_END}){name})"
    place = rf"{only}\s*(?:\.\s*{name}\s*)?"
    rest = rf"(?:{INSERT_REST}){WORD_END}"
    set_word = rf"set{WORD_END}"
    insert = rf"insert{WORD_END}\s*(?!as{WORD_END})(?:into{WORD_END}\s*)?{place}(?:\(|{rest}|(?:as{WORD_END}\s*)?{name}\s*(?:\(|{rest}))"
    update = rf"update{WORD_END}\s*(?!as{WORD_END}){place}\*?\s*(?:as{WORD_END}\s*{name}\s*{set_word}|{set_word}|{name}\s*{set_word})"
    merge, delete = rf"merge{WORD_END}\s*into{WORD_END}", rf"delete{WORD_END}\s*from{WORD_END}"
    return masked.rlike(rf"(?i)(?=[iumd])(?<![A-Za-z0-9_${HIGH}])(?:{insert}|{update}|{merge}|{delete})")


def statement_profile(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Per statement its leading word and what it may do."""
    # One walk serves both, for the texts that need it: a comment that stops the reading of the first word stops that of the text.
    stopped = F.col("_flat").endswith("/* ")
    return (corpus.withColumn("_flat", _flat_masked(F.col(text))).withColumn("_walked", F.when(stopped, _walked(F.col(text))))
            .withColumn("leading_word", F.when(stopped & _leading_deep(F.col(text)), _walked_leading_word(F.col("_walked"))).otherwise(_flat_leading_word(F.col(text))))
            .withColumn("_masked", F.when(stopped, _strings_blank(F.col("_walked"))).otherwise(F.col("_flat")))
            .withColumn("explainable", is_explainable(F.col("leading_word")))
            .withColumn("has_parameter", has_parameter(F.col("_masked")))
            .withColumn("data_modifying", is_data_modifying(F.col("_masked")))
            .withColumn("unread_tail", unread_tail(F.col("_masked")))
            .drop("_masked", "_flat", "_walked"))


def corpus_profile(corpus: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Counts of the profile per server and schema."""
    return statement_profile(corpus, text).groupBy(*keys, "leading_word").agg(
        F.count(F.lit(1)).alias("statements"),
        F.count_if("explainable").alias("explainable"),
        F.count_if("has_parameter").alias("with_parameter"),
        F.count_if("data_modifying").alias("data_modifying"),
        F.count_if("unread_tail").alias("unread_tail"))


def _bare_name(name: Column) -> Column:
    """A name as the server stores it: without its quotes, a doubled quote inside being one."""
    inside = F.substring(name, F.lit(2), F.length(name) - 2)
    plain = name
    for mark in ("`", '"'):
        plain = F.when(F.substring(name, 1, 1) == mark, F.replace(inside, F.lit(mark * 2), F.lit(mark))).otherwise(plain)
    return plain


def _outer(tokens: Column) -> Column:
    """The tokens outside of parentheses, however deep those nest, the depth at the end, and whether one closes too much.

    Only the parentheses are walked; the places where the depth leaves and reaches zero cut the tokens into the slices that stay.
    """
    marks = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin("(", ")"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("broken"), F.array().cast("array<int>").alias("edges"))

    def step(state: Column, mark: Column) -> Column:
        opens = mark["t"] == "("
        depth = state["depth"] + F.when(opens, 1).otherwise(-1)
        edge = (opens & (depth == 1)) | (~opens & (depth == 0))
        return F.struct(depth.alias("depth"), (state["broken"] | (depth < 0)).alias("broken"),
                        F.when(edge, F.concat(state["edges"], F.array(mark["i"]))).otherwise(state["edges"]).alias("edges"))

    def slices(edges: Column) -> Column:
        """A slice begins behind every second edge and ends before the next."""
        ends = F.filter(F.transform(edges, lambda e, i: F.struct(e.alias("low"), F.get(edges, i + 1).alias("high"), i.alias("i"))),
                        lambda x: (x["i"] % 2 == 0) & (x["high"] > x["low"] + 1))
        return F.flatten(F.transform(ends, lambda x: F.slice(tokens, x["low"] + 2, x["high"] - x["low"] - 1)))

    def whole(walked: Column) -> Column:
        kept = bound(F.concat(F.array(F.lit(-1)), walked["edges"], F.array(F.size(tokens))), slices)
        return F.struct(walked["depth"].alias("depth"), walked["broken"].alias("broken"), F.filter(kept, lambda t: ~t.isin("(", ")")).alias("kept"))
    return bound(F.aggregate(marks, start, step), whole)


def _target(tokens: str) -> Column:
    """Where the target's name stands: behind ALTER TABLE or the ON of CREATE INDEX with their options; null for other commands."""
    def word(place) -> Column:
        return F.coalesce(F.upper(F.try_element_at(tokens, place if isinstance(place, Column) else F.lit(place))), F.lit(""))

    def past(place: Column, *words: str) -> Column:
        """Behind these words if all of them stand here, else here."""
        there = word(place) == words[0]
        for more, one in enumerate(words[1:], 1):
            there = there & (word(place + more) == one)
        return place + F.when(there, len(words)).otherwise(0)

    option = lambda place: place + word(place).isin(*ALTER_OPTIONS).cast("int")
    table = option(option(F.lit(2)))
    alter = F.when((word(1) == "ALTER") & (word(table) == "TABLE"), past(table + 1, "IF", "EXISTS"))
    kind = past(F.lit(2), "OR", "REPLACE")
    index = kind + word(kind).isin(*INDEX_KINDS).cast("int")
    named = past(index + 1, "IF", "NOT", "EXISTS") + 1
    on = named + F.when(word(named) == "USING", 2).otherwise(0)
    create = F.when((word(1) == "CREATE") & (word(index) == "INDEX") & (word(on) == "ON"), on + 1)
    return F.coalesce(alter, create)


def _clause(rest: Column, clause: str, words: Sequence[str]) -> tuple[Column, Column]:
    """The value of a clause among upper-cased tokens, and whether it is malformed or repeated.

    An equals sign always begins a value; without one only a word that the clause knows does.
    """
    two = F.transform(rest, lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get(rest, i + 1), F.lit("")).alias("one"),
                                                  F.coalesce(F.get(rest, i + 2), F.lit("")).alias("two")))
    found = F.filter(two, lambda x: (x["t"] == clause) & ((x["one"] == "=") | x["one"].isin(*words)))
    values = F.transform(found, lambda x: F.when(x["one"] == "=", x["two"]).otherwise(x["one"]))
    wrong = F.exists(values, lambda v: ~v.rlike("^[A-Z_]+$"))
    return F.coalesce(F.get(values, F.lit(0)), F.lit("")), wrong | (F.size(values) > 1)


def ddl_audit(statements: DataFrame, ddl: str = "ddl_statement", schema: str = "schema_name",
              expected_schema: str = "target_schema", expected_table: str = "target_table",
              lower_case_names: Column | None = None) -> DataFrame:
    """Target, online clauses and the first reason to reject each DDL text.

    The text is masked, cut into tokens and read in order; what stands in parentheses is left out at any depth. A text whose
    parentheses do not match is refused as ``not-read``.
    """
    sql = F.btrim(F.coalesce(F.col(ddl), F.lit("")))
    masked = F.regexp_replace(
        sql, rf"(?s){BACKSLASH_STRING}|({BACKSLASH_NAME}|{BACKTICK_NAME})|{HASH_COMMENT}|{BLOCK_COMMENT}|{DASH_COMMENT}", "$1 ")
    df = statements.withColumn("_masked", F.regexp_replace(masked, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "))
    df = df.withColumn("_tokens", F.regexp_extract_all(F.col("_masked"), F.lit(DDL_TOKEN), F.lit(0)))
    df = df.withColumn("_all", _outer(F.col("_tokens"))).withColumn("_out", F.col("_all.kept")).withColumn("_at", _target("_out"))
    name = lambda place: F.coalesce(F.try_element_at("_out", place), F.lit(""))
    is_name = lambda token: token.rlike(rf"^(?:{DDL_WORD}|[`\"].*[`\"])$")
    at = F.coalesce("_at", F.lit(1_000_000))
    dotted = name(at + 1) == "."
    valid = F.col("_at").isNotNull() & is_name(name(at)) & (~dotted | is_name(name(at + 2)))
    df = (df.withColumn("_valid", valid).withColumn("qualified", valid & dotted)
          .withColumn("ddl_schema", F.when(valid & dotted, _bare_name(name(at))).otherwise(F.col(schema)))
          .withColumn("ddl_table", F.when(valid & dotted, _bare_name(name(at + 2))).when(valid, _bare_name(name(at))).otherwise("")))
    rest = F.when(valid, F.slice("_out", at + F.when(dotted, 3).otherwise(1), F.greatest(F.size("_out"), F.lit(1))))
    df = df.withColumn("_rest", F.transform(F.coalesce(rest, F.array().cast("array<string>")), F.upper))
    algorithm, bad_algorithm = _clause(F.col("_rest"), "ALGORITHM", ALGORITHM_WORDS)
    lock, bad_lock = _clause(F.col("_rest"), "LOCK", LOCK_WORDS)
    comments = F.regexp_replace(
        sql, rf"(?s){BACKSLASH_STRING}|{BACKSLASH_NAME}|{BACKTICK_NAME}|{HASH_COMMENT}|{DASH_COMMENT}|(/\*)[mM]?!.*?(?:\*/|\z)|{BLOCK_COMMENT}",
        "$1 ")
    quotes = F.regexp_replace(
        sql, r"(?s)(')(?:[^'\\]++|\\[^']|'')*+\\'(?:[^'\\]++|\\.|'')*+(?:'|\z)|(\")(?:[^\"\\]++|\\[^\"]|\"\")*+\\\"(?:[^\"\\]++|\\.|\"\")*+(?:\"|\z)"
             rf"|{BACKSLASH_STRING}|{BACKSLASH_NAME}|{BACKTICK_NAME}|{HASH_COMMENT}|{BLOCK_COMMENT}|{DASH_COMMENT}", "$1$2 ")
    inner = F.slice("_tokens", 1, F.greatest(F.size("_tokens") - 1, F.lit(0)))
    same = ((F.col("ddl_schema") == F.col(expected_schema)) & (F.col("ddl_table") == F.col(expected_table)))
    if lower_case_names is not None:
        same = same | (lower_case_names & (F.lower("ddl_schema") == F.lower(expected_schema))
                       & (F.lower("ddl_table") == F.lower(expected_table)))
    # A clause begins behind the target or a comma, and its first words say what it does.
    clauses = F.filter(F.transform(F.col("_rest"), lambda t, i: F.struct(
        F.when(i == 0, ",").otherwise(F.get("_rest", i - 1)).alias("before"), t.alias("verb"), F.coalesce(F.get("_rest", i + 1), F.lit("")).alias("what"))),
        lambda x: x["before"] == ",")
    blocks = F.exists(clauses, lambda x: x["verb"].isin(*REDEFINING_VERBS) | ((x["verb"] == "ADD") & x["what"].isin(*BLOCKING_INDEXES))
                      | ((x["verb"] == "DROP") & (x["what"] == "PRIMARY")))
    is_alter = F.upper(F.try_element_at("_out", F.lit(1))) == "ALTER"
    follows = lambda first, test: F.exists(F.transform(F.col("_rest"), lambda t, i: F.struct(
        t.alias("t"), F.coalesce(F.get("_rest", i + 1), F.lit("")).alias("n"))), lambda x: (x["t"] == first) & test(x["n"]))
    unread = (F.col("_all.depth") != 0) | F.col("_all.broken")
    df = (df.withColumn("algorithm", algorithm).withColumn("lock", lock)
          .withColumn("executable_comment", comments.contains("/*"))
          .withColumn("backslash_quote", quotes.contains("'") | quotes.contains('"'))
          .withColumn("several_statements", F.array_contains(inner, ";"))
          .withColumn("static_online", ~(is_alter & blocks)))
    reason = (F.when(~F.col("_valid"), "no-target")
              .when(~same, "target-mismatch")
              .when(is_alter & follows("RENAME", lambda n: ~n.isin(*RENAMED_PARTS)), "table-rename")
              .when(is_alter & follows("EXCHANGE", lambda n: n == "PARTITION"), "exchange-partition")
              .when(F.col("executable_comment"), "executable-comment")
              .when(F.col("backslash_quote"), "backslash-quote")
              .when(F.col("several_statements"), "several-statements")
              .when(unread, "not-read")
              .when(bad_algorithm, "invalid-algorithm-clause")
              .when(bad_lock, "invalid-lock-clause")
              .when((F.col("algorithm") != "") & ~F.col("algorithm").isin(*ONLINE_ALGORITHMS),
                    F.when(F.col("algorithm").isin(*COPY_ALGORITHMS), "copy-algorithm").otherwise("unknown-algorithm"))
              .when((F.col("lock") != "") & (F.col("lock") != "NONE"),
                    F.when(F.col("lock").isin(*SHARED_LOCKS), "blocking-lock").otherwise("unknown-lock")))
    return df.withColumn("reason", reason).drop("_masked", "_tokens", "_all", "_out", "_at", "_valid", "_rest")


def ddl_reason_counts(audited: DataFrame, keys: list[str]) -> DataFrame:
    """Number of DDL texts per reason."""
    return audited.groupBy(*keys, F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("statements"))
