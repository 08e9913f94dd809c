"""Column expressions that bring collected values into one shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Limits, units and names that the collected data uses.
UNSIGNED = DecimalType(20, 0)
WIDE = DecimalType(38, 0)
MAX_UNSIGNED = "18446744073709551615"
NULL_MARKER = "NULL"
RDS = "aws/rds"
IDENTITY_PREFIX = "pgss:v1:"
TRUNCATED_PERCENT = "innodb_max_dirty_pages_pct"
NATIVE_UNIT_BYTES = {
    "work_mem": 1024,
    "maintenance_work_mem": 1024,
    "shared_buffers": 8192,
    "effective_cache_size": 8192,
    "wal_buffers": 8192,
}
MATCH_WORDS = {"f": "FULL", "p": "PARTIAL"}
ACTION_WORDS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}

FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_TEXT = r"(?i)^[+]?inf(inity)?$"
WHITE = " \t\n\r\f\u000b"


def maximum() -> Column:
    """The largest unsigned 64-bit value."""
    return F.lit(MAX_UNSIGNED).cast(UNSIGNED)


def saturated(total: Column) -> Column:
    """A wide decimal cut at the largest unsigned 64-bit value."""
    return F.least(total.cast(WIDE), maximum().cast(WIDE)).cast(UNSIGNED)


def trimmed(text: Column) -> Column:
    """Text without white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def null_marker(value: Column) -> Column:
    """A missing value as the marker text."""
    return F.coalesce(value.cast("string"), F.lit(NULL_MARKER))


def from_null_marker(text: Column) -> Column:
    """Empty text and the marker text as a missing value."""
    return F.when(~text.isin("", NULL_MARKER), text)


def mysql_version(text: Column) -> Column:
    """The part before the first dash."""
    return F.split_part(text, F.lit("-"), F.lit(1))


def postgres_version(text: Column) -> Column:
    """The first two dotted parts of the second word."""
    word = F.split_part(text, F.lit(" "), F.lit(2))
    return F.concat_ws(".", F.split_part(word, F.lit("."), F.lit(1)), F.split_part(word, F.lit("."), F.lit(2)))


def to_size_double(value: Column) -> Column:
    """N3 for doubles: truncated, never negative, saturated; NaN is 0. Exact above 2^53 by splitting at 2^32."""
    high = F.floor(value / F.lit(4294967296.0))
    low = F.floor(value - high.cast("double") * F.lit(4294967296.0))
    exact = high.cast(UNSIGNED) * F.lit(4294967296).cast(DecimalType(11, 0)) + low.cast(UNSIGNED)
    zero = F.lit(0).cast(UNSIGNED)
    return (F.when(value.isNull() | F.isnan(value) | (value <= 0), zero)
            .when(value >= F.lit(18446744073709551616.0), maximum())
            .otherwise(exact.cast(UNSIGNED)))


def to_size(text: Column) -> Column:
    """Any metric text as an unsigned 64-bit size."""
    clean = trimmed(text)
    digits = F.ltrim(clean, F.lit("0"))
    whole = (F.when(F.length(digits) == 0, F.lit(0).cast(UNSIGNED))
             .when(F.length(digits) > 20, maximum())
             .otherwise(saturated(digits.try_cast(DecimalType(38, 0)))))
    return (F.when(clean.rlike("^[0-9]+$"), whole)
            .when(clean.rlike(FLOAT_TEXT), to_size_double(clean.try_cast("double")))
            .when(clean.rlike(INFINITY_TEXT), maximum())
            .otherwise(F.lit(0).cast(UNSIGNED)))


def effective_ram(instance_type: Column, total: Column) -> Column:
    """RAM in bytes; one provider reports KiB."""
    size = total.cast(WIDE)
    return F.when(instance_type == RDS, saturated(size * F.lit(1024).cast(DecimalType(4, 0)))).otherwise(saturated(size))


def timer_to_us(picoseconds: Column) -> Column:
    """Picoseconds to whole microseconds, half up; timers are never negative."""
    return F.call_function("div", picoseconds + F.lit(500000), F.lit(1000000))


def normalize_query_id(text: Column) -> Column:
    """A signed 64-bit id as its unsigned text; any other text unchanged."""
    signed = text.try_cast("bigint")
    clean = trimmed(text)
    number = F.when(clean.rlike("^[0-9]{1,30}$"), clean.try_cast(WIDE))
    return (F.when(signed.isNotNull(), F.conv(F.hex(signed), 16, 10))
            .when(number <= F.lit(MAX_UNSIGNED).cast(WIDE), number.cast("string"))
            .otherwise(text))


def statement_identity(database_id: Column, query_id: Column, top_level: Column) -> Column:
    """The first 64 bits of a hash over database, unsigned id and level, as unsigned decimal text."""
    level = F.coalesce(top_level.cast("string"), F.lit("unknown"))
    text = F.concat(F.lit(IDENTITY_PREFIX), database_id, F.lit(":"), normalize_query_id(query_id), F.lit(":"), level)
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)


def uptime(value: Column) -> Column:
    """The uptime text, '0' when missing."""
    return F.coalesce(value, F.lit("0"))


def parameter_value(name: Column, value: Column) -> Column:
    """The canonical text of a parameter; null when it is not valid."""
    number = F.when(value.rlike(FLOAT_TEXT), value.try_cast("double"))
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when(name == TRUNCATED_PERCENT, whole.cast("string")).otherwise(value)


def plain_number(value: Column) -> Column:
    """A finite double as text without exponent, with all its digits; null when it is not finite."""
    number = value.cast("double")
    text = F.abs(number).cast("string")
    mantissa, power = F.regexp_extract(text, r"^([0-9.]+)", 1), F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    point = F.instr(mantissa, ".") - 1
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    whole = point + power  # digits before the point; not above nought for small numbers
    filled = F.when(whole > 0, F.rpad(digits, F.greatest(whole, F.length(digits)), "0")).otherwise(F.concat(F.repeat(F.lit("0"), 1 - whole), digits))
    cut = F.greatest(whole, F.lit(1))
    fraction = F.regexp_replace(F.substring(filled, cut + 1, F.length(filled)), "0+$", "")
    plain = F.concat(F.substring(filled, F.lit(1), cut), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))
    signed = F.concat(F.when((number < 0) & (plain != "0"), "-").otherwise(""), plain)
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), signed)


def native_units(database_type: Column, name: Column, value: Column) -> Column:
    """Bytes in the provider's own unit; null when the value does not divide."""
    divisors = F.create_map(*[F.lit(x) for pair in NATIVE_UNIT_BYTES.items() for x in pair])
    divisor = divisors[name].cast(DecimalType(20, 0))
    number = F.when(value.rlike("^[0-9]{1,20}$"), value.try_cast(WIDE))
    valid = number <= F.lit(MAX_UNSIGNED).cast(WIDE)
    converted = F.when(valid & (number % divisor == 0), F.floor(number / divisor).cast("string"))
    return F.when((database_type == "postgresql") & divisor.isNotNull(), converted).otherwise(value)


def values_equal(left: Column, right: Column) -> Column:
    """Equal without case and outer space, or equal numbers."""
    a, b = trimmed(F.coalesce(left, F.lit(""))), trimmed(F.coalesce(right, F.lit("")))
    x = F.when(a.rlike(FLOAT_TEXT), a.try_cast("double"))
    y = F.when(b.rlike(FLOAT_TEXT), b.try_cast("double"))
    return (F.lower(a) == F.lower(b)) | F.coalesce(F.abs(x - y) < F.lit(1e-9), F.lit(False))


def switch_text(value: Column) -> Column:
    """A boolean as ON or OFF, missing as empty text."""
    return F.when(value.isNull(), "").when(value, "ON").otherwise("OFF")


def config_text(value: Column) -> Column:
    """A JSON value (a variant) as the text that a provider is sent.

    A boolean is ON or OFF, a number has its digits without exponent or idle zeros, a text is trimmed, null is empty; any
    other value stays JSON.
    """
    kind, text = F.schema_of_variant(value), F.to_json(value)
    decimal = F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1")
    return (F.when(value.isNull() | F.is_variant_null(value), "")
            .when(kind == "BOOLEAN", switch_text(F.try_variant_get(value, "$", "boolean")))
            .when(kind == "BIGINT", text)
            .when(kind.startswith("DECIMAL"), F.regexp_replace(decimal, r"\.$", ""))
            .when(kind.isin("DOUBLE", "FLOAT"), plain_number(F.try_variant_get(value, "$", "double")))
            .when(kind == "STRING", trimmed(F.try_variant_get(value, "$", "string")))
            .otherwise(text))


def setting_value(setting: Column, raw: Column) -> Column:
    """The nested setting if there is one, else the value itself, trimmed."""
    return trimmed(F.coalesce(setting, raw))


def session_reset(source: Column, setting: Column, reset: Column) -> Column:
    """The effective setting of a value changed by the collecting session."""
    return F.when(source == "session", reset).otherwise(setting)


def database_type(engine: Column) -> Column:
    """The database type of a provider engine."""
    name = F.lower(engine)
    return (F.when(F.contains(name, F.lit("postgres")), "postgresql")
            .when((name == "aurora") | F.contains(name, F.lit("mariadb")) | F.contains(name, F.lit("mysql")), "mysql")
            .otherwise(""))


def is_aurora(engine: Column) -> Column:
    """Whether the engine is of the clustered family."""
    name = F.lower(engine)
    return (name == "aurora") | F.startswith(name, F.lit("aurora-"))


def code_word(code: Column, words: dict[str, str], default: str | None = None) -> Column:
    """The word of a one-letter code."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(table[code], F.lit(default))


def since(version: Column, minimum: int, value: Column, default: Column) -> Column:
    """A value that exists from one server version on."""
    return F.when(version >= minimum, value).otherwise(default)
