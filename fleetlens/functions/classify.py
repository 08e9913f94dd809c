"""Classes of error texts and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error texts, error codes and exit codes that the classes are decided by.
PERMISSION_CODE = "42501"
UNDEFINED_TABLE_CODE = "42P01"
UNDEFINED_COLUMN_CODE = "42703"
RETRY_CODES = ("42P18", "42883", "42704")
RETRY_TEXTS = ("could not determine data type of parameter", "indeterminate_datatype", "cannot determine data type of",
               "operator does not exist")
NEED_GRANT = "need_grant_permission"
ONLINE_UNSUPPORTED_NUMBERS = (1845, 1846, 1847, 1848, 1849, 1850, 1851, 1852, 1853, 1854, 1855, 1856, 1857, 1861, 3060, 3103,
                              3178, 3187, 4083, 4157, 4158)
ONLINE_QUALIFIERS = ("algorithm=inplace", "algorithm=nocopy", "algorithm=instant", "lock=none")
AZURE_DENIED = ("authorizationfailed", "forbidden", "unauthorized", "access denied", "denied")
MANAGED_DATABASES = {"aws/rds": "rdsadmin", "gcp/cloudsql": "cloudsqladmin", "azure/postgresql": "azure_maintenance"}
EXIT_FAILURE, EXIT_DENIED, EXIT_TIMEOUT = 8, 9, 6


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def mysql_plan_error(message: Column) -> Column:
    """The stored plan error of a MySQL message."""
    select_denied = message.contains("SELECT command denied to user") | message.contains("Access denied for user")
    return F.when(select_denied, NEED_GRANT).otherwise(message)


def mysql_error_class(message: Column) -> Column:
    """Permission, other denial, or any other error."""
    select_denied = message.contains("SELECT command denied to user") | message.contains("Access denied for user")
    return (F.when(select_denied, NEED_GRANT).when(message.contains("command denied to user"), "denied").otherwise("error"))


def postgres_permission_error(code: Column, message: Column) -> Column:
    """Whether the error is a missing permission."""
    text = F.lower(message)
    return (F.coalesce(code == PERMISSION_CODE, F.lit(False)) | text.contains("select command denied to user")
            | text.contains("access denied for user") | text.contains("permission denied"))


def postgres_error_class(code: Column, message: Column, modifying: Column) -> Column:
    """Permission, worth a retry, sign of changed capabilities, or any other error."""
    safe = F.coalesce(code, F.lit(""))
    return (F.when(postgres_permission_error(code, message) & ~modifying, NEED_GRANT)
            .when(safe.isin(*RETRY_CODES) | _any(F.lower(message), RETRY_TEXTS), "retryable")
            .when(safe.isin(UNDEFINED_TABLE_CODE, UNDEFINED_COLUMN_CODE), "invalidating")
            .otherwise("error"))


def online_ddl_unsupported(number: Column, message: Column) -> Column:
    """Whether the server says that the change cannot be made online."""
    text = F.lower(message)
    refused = text.contains("not supported") | text.contains("unsupported")
    return (F.coalesce(number.isin(*ONLINE_UNSUPPORTED_NUMBERS), F.lit(False)) | text.contains("try algorithm=copy")
            | (_any(text, ONLINE_QUALIFIERS) & refused))


def azure_exit_code(message: Column) -> Column:
    """Exit code of a failed change at this provider."""
    return F.when(_any(F.lower(message), AZURE_DENIED), EXIT_DENIED).otherwise(EXIT_FAILURE)


def gcp_exit_code(message: Column) -> Column:
    """Exit code of a failed change at this provider."""
    return F.when(message.contains("notAuthorized"), EXIT_DENIED).otherwise(EXIT_FAILURE)


def rds_denied(code: Column, message: Column) -> Column:
    """Whether access was denied."""
    return (F.lower(F.coalesce(code, F.lit(""))).contains("accessdenied") | F.lower(message).contains("accessdenied"))


def rds_exit_code(timed_out: Column, code: Column, message: Column) -> Column:
    """Exit code of a failed change at this provider."""
    return (F.when(timed_out, EXIT_TIMEOUT).when(rds_denied(code, message), EXIT_DENIED).otherwise(EXIT_FAILURE))


def rds_safe_error(timed_out: Column, code: Column, message: Column) -> Column:
    """An error text that is safe to log."""
    safe = code.rlike(r"^[A-Za-z0-9._-]{1,128}\z")
    return (F.when(timed_out, "timeout").when(rds_denied(code, message), "access-denied")
            .when(F.coalesce(safe, F.lit(False)), F.concat(F.lit("aws-api:"), code)).otherwise("aws-api-error"))


def managed_database(instance_type: Column) -> Column:
    """the database that a provider keeps for itself; null on other servers."""
    table = F.create_map(*[F.lit(x) for pair in MANAGED_DATABASES.items() for x in pair])
    return table[F.lower(F.btrim(instance_type))]


def hba_unavailable(instance_type: Column, code: Column) -> Column:
    """SEC3: whether access rules could not be read for an expected reason."""
    return ((code == UNDEFINED_TABLE_CODE)
            | ((code == PERMISSION_CODE) & managed_database(instance_type).isNotNull()))
