"""Security findings over accounts, roles and access rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import lookup

# Plugins, accounts, hosts, rule types and addresses that the findings are decided by.
NATIVE_PLUGIN = "mysql_native_password"
SOCKET_PLUGINS = ("auth_socket", "unix_socket", "win_socket", "auth_pam_compat")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")
REMOTE_RULE_TYPES = ("host", "hostssl", "hostnossl")
LOCAL_ADDRESSES = ("", "127.0.0.1/32", "::1/128", "samehost")


# Versions from which the account table tells plugins, and locks and expiry.
PLUGINS_FROM, LOCKS_FROM = 50501, 80000


def native_hash(name: Column) -> Column:
    """The stored form of a password equal to ``name``."""
    return F.concat(F.lit("*"), F.upper(F.sha1(F.unhex(F.sha1(name)))))


def mysql_user_findings(accounts: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """SEC1: findings per account, without the names of user and host.

    Where the server has the table of global privileges, an account is blank if its native password is empty text. Elsewhere
    a missing secret is blank too, the plugin counts from version 5.5.1 on, where a missing one rules the account out, and
    locked or expired accounts are left out from 8.0 on. ``version_number`` is 50501 for 5.5.1.
    """
    user, secret = F.col("user"), F.coalesce("secret", F.lit(""))
    instance, version = F.col("instance_type"), F.col("version_number")
    forked = (F.col("plugin") == NATIVE_PLUGIN) & (F.col("secret") == "") & ~F.coalesce("account_locked", F.lit(False))
    plugin = (version < PLUGINS_FROM) | ~F.col("plugin").isin(*SOCKET_PLUGINS)
    active = (version < LOCKS_FROM) | (~F.col("account_locked") & ~F.col("password_expired"))
    blank = (user != "") & F.when(F.col("has_global_priv"), forked).otherwise((secret == "") & plugin & active)
    excepted = ((user == "mariadb.sys") | ((instance == "aws/rds") & (user == "rdsadmin"))
                | ((instance == "gcp/cloudsql") & (user.contains("cloudsql") | (user == "root"))))
    remote_root = (instance == "local") & (user == "root") & ~F.col("host").isin(*LOCAL_HOSTS)
    return accounts.select(
        *keys,
        F.coalesce(blank & ~excepted, F.lit(False)).cast("int").alias("blank_password"),
        ((secret == native_hash(user)) | (secret == native_hash(F.upper(user)))).cast("int").alias("password_as_user"),
        remote_root.cast("int").alias("remote_conn_root"),
        (F.btrim(user) == "").cast("int").alias("anonymous_user"))


def pg_user_findings(roles: DataFrame, rules: DataFrame, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """SEC2: whether a role is a superuser that can log in from remote. Without readable rules nothing is found.

    Rules for everybody become one flag per server, rules with names one row per name, so that no rule meets every
    role.
    """
    keys = list(keys)

    def clean(name: str) -> Column:
        return F.lower(F.btrim(F.coalesce(name, F.lit(""))))
    remote = rules.filter(clean("type").isin(*REMOTE_RULE_TYPES) & ~clean("address").isin(*LOCAL_ADDRESSES)).select(
        *keys, clean("user_name").alias("_users")).distinct()
    everybody = remote.filter(F.col("_users").isin("", "all")).select(*keys, F.lit(True).alias("_everybody")).distinct()
    named = remote.select(*keys, F.explode(F.split("_users", ",")).alias("_name")).select(
        *keys, F.btrim("_name").alias("_name")).distinct().withColumn("_named", F.lit(True))
    joined = lookup(lookup(roles.withColumn("_name", F.lower("rolname")), everybody, keys), named, [*keys, "_name"])
    reachable = F.coalesce("_everybody", "_named", F.lit(False))
    zero = F.lit(0)
    return joined.select(*keys, (F.col("rolsuper") & F.col("rolcanlogin") & reachable).cast("int").alias("remote_conn_superuser"),
                         zero.alias("anonymous_user"), zero.alias("blank_password"), zero.alias("password_as_user"))


def finding_counts(findings: DataFrame, names: Sequence[str], keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Accounts and findings per server."""
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("accounts"), *[F.sum(n).alias(n) for n in names])
