"""Queries of the security findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..operators import security
from . import bindings as b
from .base import Tables, query
from .catalog import pick

USERS = ("", "root", "mariadb.sys", "rdsadmin", "cloudsqladmin", " ")
HOSTS = ("localhost", "%", "127.0.0.1", "10.0.0.1", "::1")
PLUGINS = ("mysql_native_password", "auth_socket", "caching_sha2_password", None)
TYPES = ("local", "aws/rds", "gcp/cloudsql", "azure/mysql")

ACCOUNTS = f"""
accounts AS (SELECT c_nationkey AS server_id, CASE WHEN c_custkey % 10 < 6 THEN ({b.sql_list(USERS)})[CAST(c_custkey % 10 AS INTEGER) + 1] ELSE c_name END AS u,
  ({b.sql_list(HOSTS)})[CAST((c_custkey // 10) % 5 AS INTEGER) + 1] AS host, ({b.sql_list(PLUGINS)})[CAST(c_custkey % 4 AS INTEGER) + 1] AS plugin, c_custkey,
  ({b.sql_list(TYPES)})[CAST(c_nationkey % 4 AS INTEGER) + 1] AS instance_type, c_nationkey % 6 = 0 AS privileges, ([50100, 50700, 80000, 80400])[CAST(c_nationkey % 4 AS INTEGER) + 1] AS version, c_custkey % 13 = 0 AS locked, c_custkey % 11 = 0 AS expired FROM customer),
secrets AS (SELECT *, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '*' || upper(sha1(unhex(sha1(u)))) WHEN 3 THEN '*' || upper(sha1(unhex(sha1(upper(u))))) ELSE '*OTHER' END AS secret FROM accounts),
findings AS (SELECT server_id,
  CAST(coalesce(CASE WHEN u = '' THEN false WHEN privileges THEN plugin = 'mysql_native_password' AND secret = '' AND NOT locked
      WHEN secret <> '' THEN false WHEN version >= 50501 AND (plugin IS NULL OR plugin IN ('auth_socket', 'unix_socket', 'win_socket', 'auth_pam_compat')) THEN false
      WHEN version >= 80000 AND (locked OR expired) THEN false ELSE true END
    AND NOT (u = 'mariadb.sys' OR (instance_type = 'aws/rds' AND u = 'rdsadmin') OR (instance_type = 'gcp/cloudsql' AND (contains(u, 'cloudsql') OR u = 'root'))), false) AS INTEGER) AS blank_password,
  CAST(coalesce(secret, '') = '*' || upper(sha1(unhex(sha1(u)))) OR coalesce(secret, '') = '*' || upper(sha1(unhex(sha1(upper(u))))) AS INTEGER) AS password_as_user,
  CAST(instance_type = 'local' AND u = 'root' AND host NOT IN ('localhost', '127.0.0.1', '::1') AS INTEGER) AS remote_conn_root, CAST(trim(u) = '' AS INTEGER) AS anonymous_user FROM secrets)"""


def accounts(t: Tables):
    key = F.col("c_custkey")
    user = F.when(key % 10 < 6, F.get(F.array(*[F.lit(x) for x in USERS]), (key % 10).cast("int"))).otherwise(F.col("c_name"))
    secret = (F.when(key % 5 == 0, "").when(key % 5 == 1, None).when(key % 5 == 2, security.native_hash(user))
              .when(key % 5 == 3, security.native_hash(F.upper(user))).otherwise("*OTHER"))
    return t.customer.select(
        F.col("c_nationkey").alias("server_id"), user.alias("user"), pick(HOSTS, "c_custkey", 10).alias("host"), pick(PLUGINS, "c_custkey").alias("plugin"),
        secret.alias("secret"), pick(TYPES, "c_nationkey").alias("instance_type"), (F.col("c_nationkey") % 6 == 0).alias("has_global_priv"),
        F.get(F.array(*[F.lit(v) for v in (50100, 50700, 80000, 80400)]), (F.col("c_nationkey") % 4).cast("int")).alias("version_number"),
        (key % 13 == 0).alias("account_locked"), (key % 11 == 0).alias("password_expired"))


@query("mysql_user_findings", f"WITH {ACCOUNTS} SELECT * FROM findings")
def mysql_user_findings(t: Tables):
    return security.mysql_user_findings(accounts(t))


@query("mysql_finding_counts", f"""WITH {ACCOUNTS} SELECT server_id, count(*) AS accounts, CAST(sum(blank_password) AS BIGINT) AS blank_password,
  CAST(sum(password_as_user) AS BIGINT) AS password_as_user, CAST(sum(remote_conn_root) AS BIGINT) AS remote_conn_root, CAST(sum(anonymous_user) AS BIGINT) AS anonymous_user
FROM findings GROUP BY server_id""")
def mysql_finding_counts(t: Tables):
    return security.finding_counts(security.mysql_user_findings(accounts(t)), ("blank_password", "password_as_user", "remote_conn_root", "anonymous_user"))


RULE_TYPES = ("local", "host", "hostssl", " HOSTNOSSL", "hostgssenc")
ADDRESSES = ("", "127.0.0.1/32", "10.0.0.0/8", "::1/128", "samehost", "0.0.0.0/0 ", "samenet")


@query("pg_user_findings", f"""WITH roles AS (SELECT c_custkey % 40 AS server_id, 'Role' || CAST(c_custkey % 30 AS VARCHAR) AS rolname, c_acctbal < 3000 AS rolsuper, c_custkey % 2 = 0 AS rolcanlogin FROM customer),
rules AS (SELECT o_custkey % 45 + CASE WHEN o_custkey % 45 % 4 = 0 THEN 100 ELSE 0 END AS server_id, lower(trim(({b.sql_list(RULE_TYPES)})[CAST(o_orderkey % 5 AS INTEGER) + 1])) AS type,
  lower(trim(({b.sql_list(ADDRESSES)})[CAST(o_custkey % 7 AS INTEGER) + 1])) AS address,
  CASE WHEN o_orderkey % 300 = 7 THEN 'ALL' ELSE 'role' || CAST(o_orderkey % 60 AS VARCHAR) || ', Role' || CAST(o_custkey % 60 AS VARCHAR) END AS user_name FROM orders),
remote AS (SELECT DISTINCT server_id, lower(trim(user_name)) AS users FROM rules WHERE type IN ('host', 'hostssl', 'hostnossl') AND address NOT IN ('', '127.0.0.1/32', '::1/128', 'samehost')),
names AS (SELECT DISTINCT server_id, trim(unnest(string_split(users, ','))) AS name FROM remote)
SELECT r.server_id, CAST(r.rolsuper AND r.rolcanlogin AND (EXISTS (SELECT 1 FROM remote m WHERE m.server_id = r.server_id AND m.users IN ('', 'all'))
  OR EXISTS (SELECT 1 FROM names n WHERE n.server_id = r.server_id AND n.name = lower(r.rolname))) AS INTEGER) AS remote_conn_superuser,
  0 AS anonymous_user, 0 AS blank_password, 0 AS password_as_user FROM roles r""")
def pg_user_findings(t: Tables):
    roles = t.customer.select((F.col("c_custkey") % 40).alias("server_id"), F.concat(F.lit("Role"), (F.col("c_custkey") % 30).cast("string")).alias("rolname"),
                              (F.col("c_acctbal") < 3000).alias("rolsuper"), (F.col("c_custkey") % 2 == 0).alias("rolcanlogin"))
    # Some rules are of servers without roles, and some servers have roles without rules.
    rules = t.orders.select(
        (F.col("o_custkey") % 45 + F.when(F.col("o_custkey") % 45 % 4 == 0, 100).otherwise(0)).alias("server_id"), pick(RULE_TYPES, "o_orderkey").alias("type"), pick(ADDRESSES, "o_custkey").alias("address"),
        F.when(F.col("o_orderkey") % 300 == 7, "ALL").otherwise(F.concat(F.lit("role"), (F.col("o_orderkey") % 60).cast("string"), F.lit(", Role"),
                                                                          (F.col("o_custkey") % 60).cast("string"))).alias("user_name"))
    return security.pg_user_findings(roles, rules)


HBA_CODES = ("42501", "42P01", "08006")
HBA_TYPES = ("aws/rds", "local", "gcp/cloudsql", "azure/postgresql", "")


@query("hba_unavailable", f"""WITH e AS (SELECT o_orderkey, ({b.sql_list(HBA_TYPES)})[CAST(o_orderkey % 5 AS INTEGER) + 1] AS instance_type, ({b.sql_list(HBA_CODES)})[CAST(o_custkey % 3 AS INTEGER) + 1] AS code FROM orders)
SELECT o_orderkey, code = '42P01' OR (code = '42501' AND instance_type IN ('aws/rds', 'gcp/cloudsql', 'azure/postgresql')) AS expected FROM e""")
def hba_unavailable(t: Tables):
    return t.orders.select("o_orderkey", classify.hba_unavailable(pick(HBA_TYPES, "o_orderkey"), pick(HBA_CODES, "o_custkey")).alias("expected"))
