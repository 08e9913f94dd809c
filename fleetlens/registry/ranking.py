"""Queries of the ranking and quota operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, ranking, rollups
from ..session import pinned
from . import bindings as b
from .base import Tables, query
from .catalog import pick


def statements(t: Tables):
    return rollups.statement_rollup_full(b.statement_stats(t), b.databases(t)).withColumns(
        {"calls": F.col("calls").cast("bigint"), "rows": F.col("rows").cast("bigint")})


@query("rank_statements", f"""WITH {b.STATEMENT_STATS} SELECT server_id, queryid, total_exec_time_us,
  row_number() OVER (PARTITION BY server_id ORDER BY total_exec_time_us DESC, queryid) AS rank FROM statements""")
def rank_statements(t: Tables):
    ranked = ranking.rank_statements(statements(t).select("server_id", "queryid", "total_exec_time_us"), "total_exec_time_us")
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


@query("top_k_statements", f"""WITH {b.STATEMENT_STATS} SELECT * FROM (
  SELECT server_id, datname, queryid, pg_queryid, toplevel, query, calls, rows, total_exec_time_us, mean_exec_time_us,
    row_number() OVER (PARTITION BY server_id ORDER BY total_exec_time_us DESC, queryid) AS rank FROM statements) WHERE rank <= 100""")
def top_k_statements(t: Tables):
    return ranking.top_k_with_texts(b.statement_stats(t), b.databases(t), "total_exec_time_us").select(
        "server_id", "datname", "queryid", "pg_queryid", "toplevel", "query", F.col("calls").cast("bigint").alias("calls"), F.col("rows").cast("bigint").alias("rows"),
        "total_exec_time_us", "mean_exec_time_us", F.col("rank").cast("bigint").alias("rank"))


SUCCESS = "CAST(right(queryid, 1) AS INTEGER) % 3 = 0"


def success():
    return F.right("queryid", F.lit(1)).cast("int") % 3 == 0


def slim(t: Tables):
    return rollups.statement_rollup(b.statement_stats(t), b.databases(t)).select(
        "server_id", "queryid", "total_exec_time_us", "mean_exec_time_us")


def quota_sql(source: str, field: str) -> str:
    return f"""SELECT * EXCLUDE (before) FROM (SELECT *, coalesce(sum(CASE WHEN {SUCCESS} THEN 1 ELSE 0 END) OVER (PARTITION BY server_id ORDER BY {field} DESC, queryid
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source}) WHERE before < 100"""


@query("plan_quota", f"""WITH {b.STATEMENT_STATS}, slim AS (SELECT server_id, queryid, total_exec_time_us, mean_exec_time_us FROM statements)
{quota_sql('slim', 'total_exec_time_us')}""")
def plan_quota(t: Tables):
    return ranking.plan_quota(slim(t), "total_exec_time_us", success())


@query("two_rankings", f"""WITH {b.STATEMENT_STATS}, slim AS (SELECT server_id, queryid, total_exec_time_us, mean_exec_time_us FROM statements),
one AS ({quota_sql('slim', 'total_exec_time_us')}),
rest AS (SELECT * FROM slim s WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.server_id = s.server_id AND o.queryid = s.queryid)),
two AS ({quota_sql('rest', 'mean_exec_time_us')})
SELECT *, 'total_exec_time_us' AS ranking FROM one UNION ALL SELECT *, 'mean_exec_time_us' AS ranking FROM two""")
def two_rankings(t: Tables):
    return ranking.two_rankings(slim(t), "total_exec_time_us", "mean_exec_time_us", success())


@query("plan_sharing", f"""WITH {b.STATEMENT_STATS}, keyed AS (SELECT server_id, datname, unsigned_id AS native_id, query, max(total_exec_time_us) AS total_exec_time_us,
  concat_ws('|', datname, unsigned_id, query) AS queryid FROM statements GROUP BY ALL),
ranked AS (SELECT *, coalesce(sum(CASE WHEN length(queryid) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY server_id ORDER BY total_exec_time_us DESC, queryid
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed),
attempted AS (SELECT *, CASE WHEN length(queryid) % 3 = 0 THEN 'plan ' || native_id END AS plan FROM ranked WHERE before < 100)
SELECT s.server_id, s.queryid, a.plan, a.queryid IS NOT NULL AS resolved FROM statements s LEFT JOIN attempted a
  ON a.server_id = s.server_id AND a.datname = s.datname AND a.native_id = s.unsigned_id AND a.query = s.query""")
def plan_sharing(t: Tables):
    keys = ["server_id", "datname", "native_id", "query"]
    rows = statements(t).select("server_id", "queryid", "total_exec_time_us", ranking.plan_key(F.col("datname"), F.col("pg_queryid"), F.col("query")).alias("k")).select(
        "server_id", "queryid", "total_exec_time_us", "k.*")
    keyed = pinned(rows.groupBy(*keys).agg(F.max("total_exec_time_us").alias("total_exec_time_us")).withColumn(
        "plan_id", F.concat_ws("|", "datname", "native_id", "query")))
    good = F.length("plan_id") % 3 == 0
    attempted = ranking.plan_quota(keyed, "total_exec_time_us", good, tie="plan_id")
    outcomes = attempted.select(*keys, F.when(good, F.concat(F.lit("plan "), "native_id")).alias("plan"), F.lit(True).alias("resolved"))
    return ranking.plan_sharing(rows, outcomes, keys).select("server_id", "queryid", "plan", F.coalesce("resolved", F.lit(False)).alias("resolved"))


@query("plan_candidates", f"""WITH {b.STATEMENT_STATS}, allowed AS (SELECT *, min(queryid) OVER (PARTITION BY server_id, datname, unsigned_id, query) AS attempt FROM statements WHERE calls > 20),
slim AS (SELECT server_id, attempt AS queryid, max(total_exec_time_us) AS total_exec_time_us, max(mean_exec_time_us) AS mean_exec_time_us FROM allowed GROUP BY server_id, attempt),
one AS ({quota_sql('slim', 'total_exec_time_us')}),
rest AS (SELECT * FROM slim s WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.server_id = s.server_id AND o.queryid = s.queryid)),
two AS ({quota_sql('rest', 'mean_exec_time_us')}),
chosen AS (SELECT server_id, queryid AS attempt, 'total_exec_time_us' AS ranking, {SUCCESS} AS planned FROM one
  UNION ALL SELECT server_id, queryid, 'mean_exec_time_us', {SUCCESS} FROM two)
SELECT a.server_id, a.queryid, a.attempt, c.ranking, c.planned FROM allowed a LEFT JOIN chosen c ON c.server_id = a.server_id AND c.attempt = a.attempt""")
def plan_candidates(t: Tables):
    return ranking.plan_candidates(statements(t), F.col("calls") > 20, success())


def outcomes_sql(source: str, id_column: str) -> str:
    """The two passes over ``source`` (server_id, id, db, one, two, plan_key, ok, fails, reason), walked by windows."""
    def walk(name: str, rows: str, field: str) -> str:
        return f"""{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY {field} DESC, id) AS n FROM {rows}),
{name}_first AS (SELECT server_id, db, min(n) AS stop, arg_min('connection_failed: ' || coalesce(nullif(reason, ''), 'connection failed'), n) AS text FROM {name}_ranked WHERE fails AND known IS NULL GROUP BY ALL),
{name}_marked AS (SELECT r.*, known IS NOT NULL OR coalesce(n > stop, false) AS skipped, coalesce(known, CASE WHEN n >= stop THEN text END) AS error
  FROM {name}_ranked r LEFT JOIN {name}_first f ON f.server_id = r.server_id AND f.db = r.db),
{name} AS (SELECT *, CASE WHEN skipped THEN 'skipped' WHEN fails THEN 'connection-failed' WHEN ok THEN 'planned' ELSE 'no-plan' END AS outcome FROM (
  SELECT *, coalesce(sum(CASE WHEN ok AND NOT fails AND NOT skipped THEN 1 ELSE 0 END) OVER (PARTITION BY server_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {name}_marked) WHERE before < 100)"""
    return f"""grouped AS (SELECT server_id, db, plan_key, min(id) AS id, max(one) AS one, max(two) AS two, arg_min(ok, id) AS ok, arg_min(fails, id) AS fails, arg_min(reason, id) AS reason,
  CAST(NULL AS VARCHAR) AS known FROM {source} GROUP BY server_id, db, plan_key),
{walk('pass1', 'grouped', 'one')},
dead AS (SELECT DISTINCT server_id, db, error FROM pass1 WHERE outcome = 'connection-failed'),
rest AS (SELECT g.* EXCLUDE (known), d.error AS known FROM grouped g LEFT JOIN dead d ON d.server_id = g.server_id AND d.db = g.db
  WHERE NOT EXISTS (SELECT 1 FROM pass1 p WHERE p.server_id = g.server_id AND p.id = g.id)),
{walk('pass2', 'rest', 'two')},
chosen AS (SELECT server_id, id, 'total_exec_time_us' AS ranking, outcome, error FROM pass1 UNION ALL SELECT server_id, id, 'mean_exec_time_us', outcome, error FROM pass2)
SELECT s.server_id, s.id AS {id_column}, g.id AS attempt, c.ranking, c.outcome, c.error AS explain_error FROM {source} s
JOIN grouped g ON g.server_id = s.server_id AND g.db = s.db AND g.plan_key = s.plan_key LEFT JOIN chosen c ON c.server_id = g.server_id AND c.id = g.id"""


@query("postgres_plan_outcomes", f"""WITH {b.STATEMENT_STATS}, eligible AS (SELECT server_id, queryid AS id, datname AS db, total_exec_time_us AS one, mean_exec_time_us AS two,
  concat_ws('|', coalesce(unsigned_id, ''), query) AS plan_key, {SUCCESS} AS ok, right(queryid, 2) = '41' AS fails, CASE WHEN length(queryid) % 2 = 0 THEN 'no route to ' || datname ELSE '' END AS reason FROM statements
  WHERE datname NOT IN ('template0', 'template1', 'NULL') AND regexp_matches(lower(query), '^\\s*(select|with)\\b') AND datname <> 'db3'),
{outcomes_sql('eligible', 'queryid')}""")
def postgres_plan_outcomes(t: Tables):
    """F7 to W4 over all statements; all databases but one are allowed, and some cannot be reached."""
    rows = statements(t)
    others = F.when(F.col("datname") == "db3", "another").otherwise("")
    eligible = filters.postgres_candidate_reason(F.col("datname"), F.col("query"), others, F.lit(False)).isNull()
    shared = ranking.plan_key(F.col("datname"), F.col("pg_queryid"), F.unhex(F.sha2("query", 256)))
    reason = F.when(F.length("queryid") % 2 == 0, F.concat(F.lit("no route to "), F.col("datname"))).otherwise("")
    return ranking.plan_outcomes(rows, eligible, shared, F.col("datname"), success(), F.right("queryid", F.lit(2)) == "41", reason)


DIGEST_TEXTS = ("select a from t", "WITH x AS (SELECT 1) SELECT * FROM x", "select SQL_NO_CACHE * from t", "update t set a = 1", "select b from ...", "EXPLAIN FORMAT=JSON select 1", "", "/* c */ select c")
DIGEST_SCHEMAS = ("app", "shop", "mysql", "crm", "erp")
DIGESTS = f"""digests AS (SELECT l_suppkey % 20 AS server_id, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id, ({b.sql_list(DIGEST_SCHEMAS)})[CAST(l_partkey % 5 AS INTEGER) + 1] AS db,
  ({b.sql_list(DIGEST_TEXTS)})[CAST(l_orderkey % 8 AS INTEGER) + 1] AS q, CAST(floor(l_extendedprice) AS BIGINT) AS one, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS two,
  l_linenumber <> 2 AS ok, l_orderkey % 300 = 7 AS fails, CASE WHEN l_linenumber % 2 = 0 THEN 'down' ELSE '' END AS reason, CAST(epoch(l_shipdate) AS BIGINT) AS last_seen, l_linenumber = 6 AS resolved FROM lineitem)"""


@query("mysql_plan_outcomes", f"""WITH {DIGESTS}, eligible AS (SELECT *, id AS plan_key FROM digests WHERE q <> '' AND NOT contains(q, 'SQL_NO_CACHE') AND NOT contains(q, 'EXPLAIN FORMAT=JSON') AND db <> 'mysql'
  AND regexp_matches(lower(q), '^(/\\*.*?\\*/|\\s)*(select|with)\\b') AND NOT resolved AND q NOT LIKE '%...' AND last_seen >= CAST(epoch(TIMESTAMP '1995-01-01') AS BIGINT) - 604800),
{outcomes_sql('eligible', 'digest')}""")
def mysql_plan_outcomes(t: Tables):
    """F6 to W3 over all digests of the other engine, of which none shares a plan."""
    id_column = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    line = F.col("l_linenumber")
    digests = t.lineitem.select(
        (F.col("l_suppkey") % 20).alias("server_id"), id_column.alias("digest"), pick(DIGEST_SCHEMAS, "l_partkey").alias("schema_name"), pick(DIGEST_TEXTS, "l_orderkey").alias("query_text"),
        F.floor("l_extendedprice").alias("total_exec_time_us"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("mean_exec_time_us"), (line != 2).alias("ok"),
        (F.col("l_orderkey") % 300 == 7).alias("fails"), F.when(line % 2 == 0, "down").otherwise("").alias("reason"), b.seconds("l_shipdate").alias("last_seen"),
        F.when(line == 6, "{}").alias("explain"), F.lit(None).cast("string").alias("explain_error"))
    eligible = filters.mysql_candidate_reason(digests, F.lit(""), b.seconds(F.lit("1995-01-01 00:00:00"))).isNull()
    return ranking.plan_outcomes(digests, eligible, F.col("digest"), F.col("schema_name"), F.col("ok"), F.col("fails"), F.col("reason"), tie="digest")


@query("attempt_dedupe", f"""WITH {b.STATEMENT_EVENTS} SELECT server_id, schema_name, digest, arg_min(event_id, (timer_start, event_id)) AS event_id,
  min(timer_start) AS timer_start FROM statement_events WHERE schema_name IS NOT NULL AND digest IS NOT NULL GROUP BY ALL""")
def attempt_dedupe(t: Tables):
    events = b.statement_events(t).filter("schema_name IS NOT NULL AND digest IS NOT NULL").select("server_id", "schema_name", "digest", "timer_start", "event_id")
    return ranking.attempt_dedupe(events, ["server_id", "schema_name", "digest"], ["timer_start", "event_id"])


@query("failed_database_skip", """WITH a AS (SELECT o_custkey % 50 AS server_id, 'db' || CAST(o_custkey % 7 AS VARCHAR) AS datname, o_orderkey AS attempt,
  o_orderstatus = 'F' AND o_orderkey % 20 = 0 AS failed, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS reason FROM orders),
f AS (SELECT server_id, datname, min(attempt) AS first, arg_min('connection_failed: ' || coalesce(nullif(reason, ''), 'connection failed'), attempt) AS text FROM a WHERE failed GROUP BY ALL)
SELECT a.server_id, a.datname, a.attempt, coalesce(a.attempt > f.first, false) AS skipped, CASE WHEN a.attempt >= f.first THEN f.text END AS explain_error
FROM a LEFT JOIN f ON f.server_id = a.server_id AND f.datname = a.datname""")
def failed_database_skip(t: Tables):
    attempts = t.orders.select(
        (F.col("o_custkey") % 50).alias("server_id"), F.concat(F.lit("db"), (F.col("o_custkey") % 7).cast("string")).alias("datname"), F.col("o_orderkey").alias("attempt"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 20 == 0)).alias("failed"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("reason"))
    marked = ranking.failed_database_skip(attempts, "attempt", F.col("failed"), "reason", ["server_id", "datname"])
    return marked.select("server_id", "datname", "attempt", "skipped", "explain_error")


@query("first_failure_stops", """WITH s AS (SELECT l_orderkey AS task_id, l_linenumber AS statement_index, bool_or(l_returnflag = 'R') AS failed FROM lineitem GROUP BY ALL),
f AS (SELECT task_id, min(statement_index) AS stop FROM s WHERE failed GROUP BY 1)
SELECT s.*, f.stop IS NULL OR s.statement_index <= f.stop AS run FROM s LEFT JOIN f ON f.task_id = s.task_id""")
def first_failure_stops(t: Tables):
    steps = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("statement_index")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("failed"))
    return ranking.first_failure_stops(steps, "statement_index", F.col("failed"), ["task_id"])
