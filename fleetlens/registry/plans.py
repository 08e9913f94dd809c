"""Queries of the configuration plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..plans import config
from ..sources import write
from . import bindings as b
from .base import Tables, query
from .joins import TOPOLOGY, topology

ENGINES = ("aurora-postgresql", "aurora-mysql", "postgres", "mysql")
APPLY_TYPES = ("static", "Dynamic", "dynamic", "engine-default", "dynamic")


def _name(n):
    return (F.when(n == 0, "innodb_max_dirty_pages_pct").when(n == 1, "work_mem").when(n == 2, "wal_buffers")
            .otherwise(F.concat(F.lit("p_"), n.cast("string"))))


def values(t: Tables):
    """Per server and parameter number: largest and smallest quantity."""
    n = F.col("l_partkey") % 40
    sums = t.lineitem.groupBy(F.col("l_suppkey").alias("server_id"), n.alias("n")).agg(
        F.max("l_quantity").cast("bigint").alias("high"), F.min("l_quantity").cast("bigint").alias("low"))
    return sums.withColumn("name", _name(F.col("n"))).withColumn("value", _text("high")).withColumn("live", _text("low"))


def _text(column):
    number = F.col(column)
    return F.when(F.col("n") == 0, F.concat(number.cast("string"), F.lit(".5"))).when(F.col("n") == 2, (number * 4096).cast("string")).otherwise((number * 1024).cast("string"))


VALUES = f"""
sums AS (SELECT l_suppkey AS server_id, l_partkey % 40 AS n, CAST(max(l_quantity) AS BIGINT) AS high, CAST(min(l_quantity) AS BIGINT) AS low FROM lineitem GROUP BY ALL),
vals AS (SELECT *, CASE n WHEN 0 THEN 'innodb_max_dirty_pages_pct' WHEN 1 THEN 'work_mem' WHEN 2 THEN 'wal_buffers' ELSE 'p_' || CAST(n AS VARCHAR) END AS name,
  CASE n WHEN 0 THEN CAST(high AS VARCHAR) || '.5' WHEN 2 THEN CAST(high * 4096 AS VARCHAR) ELSE CAST(high * 1024 AS VARCHAR) END AS value,
  CASE n WHEN 0 THEN CAST(low AS VARCHAR) || '.5' WHEN 2 THEN CAST(low * 4096 AS VARCHAR) ELSE CAST(low * 1024 AS VARCHAR) END AS live FROM sums),
params AS (SELECT server_id, name, scope, ({b.sql_list(APPLY_TYPES)})[CAST(n % 5 AS INTEGER) + 1] AS apply_type, n % 7 <> 0 AS is_modifiable,
  CASE n % 6 WHEN 0 THEN ['Provisioned'] WHEN 1 THEN CAST([] AS VARCHAR[]) END AS engine_modes, CASE WHEN n % 3 = 0 THEN CASE WHEN server_id % 3 = 0 THEN value ELSE live END END AS value
  FROM vals, (SELECT unnest(['instance', 'cluster']) AS scope)
  WHERE CASE WHEN scope = 'cluster' THEN n % 4 IN (0, 1) ELSE n % 4 IN (1, 2) OR (n % 4 = 3 AND server_id % 2 = 1) END),
meta AS (SELECT s_suppkey AS server_id, ({b.sql_list(ENGINES)})[CAST(s_suppkey % 4 AS INTEGER) + 1] AS engine, CASE WHEN s_suppkey % 3 = 0 THEN 'serverless' ELSE 'provisioned' END AS engine_mode,
  s_suppkey % 5 <> 0 AS is_cluster_writer, CASE WHEN s_suppkey % 9 = 0 THEN 'modifying' ELSE 'available' END AS instance_status,
  CASE s_suppkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'Default.pg15' ELSE 'ig' END AS configured_group, CASE WHEN s_suppkey % 8 = 2 THEN 'other' WHEN s_suppkey % 8 = 1 THEN 'Default.pg15' ELSE 'ig' END AS instance_group,
  CASE WHEN s_suppkey % 7 = 3 THEN 'applying' ELSE 'in-sync' END AS instance_group_status, 'cg' AS configured_cluster_group, CASE WHEN s_suppkey % 6 = 4 THEN 'cx' ELSE 'cg' END AS cluster_group,
  CASE WHEN s_suppkey % 10 = 6 THEN 'applying' ELSE 'in-sync' END AS cluster_group_status FROM supplier)"""


def recommendations(t: Tables):
    return values(t).select("server_id", "name", "value")


def live(t: Tables):
    return values(t).filter(F.col("n") % 9 != 0).select("server_id", "name", F.col("live").alias("value"))


def parameters(t: Tables):
    n, server = F.col("n"), F.col("server_id")
    scopes = F.array_compact(F.array(
        F.when((n % 4).isin(1, 2) | ((n % 4 == 3) & (server % 2 == 1)), "instance"), F.when((n % 4).isin(0, 1), "cluster")))
    modes = F.when(n % 6 == 0, F.array(F.lit("Provisioned"))).when(n % 6 == 1, F.array().cast("array<string>"))
    return values(t).select(
        "server_id", "name", F.explode(scopes).alias("scope"), F.array(*[F.lit(x) for x in APPLY_TYPES])[(n % 5).cast("int")].alias("apply_type"),
        (n % 7 != 0).alias("is_modifiable"), modes.alias("engine_modes"), F.when(n % 3 == 0, F.when(server % 3 == 0, F.col("value")).otherwise(F.col("live"))).alias("value"))


def metadata(t: Tables):
    s = F.col("s_suppkey")
    return t.supplier.select(
        s.alias("server_id"), F.array(*[F.lit(x) for x in ENGINES])[(s % 4).cast("int")].alias("engine"), F.when(s % 3 == 0, "serverless").otherwise("provisioned").alias("engine_mode"),
        (s % 5 != 0).alias("is_cluster_writer"), F.when(s % 9 == 0, "modifying").otherwise("available").alias("instance_status"),
        F.when(s % 8 == 0, "").when(s % 8 == 1, "Default.pg15").otherwise("ig").alias("configured_group"),
        F.when(s % 8 == 2, "other").when(s % 8 == 1, "Default.pg15").otherwise("ig").alias("instance_group"),
        F.when(s % 7 == 3, "applying").otherwise("in-sync").alias("instance_group_status"), F.lit("cg").alias("configured_cluster_group"),
        F.when(s % 6 == 4, "cx").otherwise("cg").alias("cluster_group"), F.when(s % 10 == 6, "applying").otherwise("in-sync").alias("cluster_group_status"))


def plan_sql(dynamic_only: bool, pending_only: bool) -> str:
    method = "'pending-reboot'" if pending_only else "CASE WHEN lower(apply_type) = 'dynamic' THEN 'immediate' ELSE 'pending-reboot' END"
    return f"""{VALUES},
joined AS (SELECT v.server_id, v.name, v.n, v.value AS recommended, CASE WHEN v.n % 9 <> 0 THEN v.live END AS live, i.name IS NOT NULL AS has_i, c.name IS NOT NULL AS has_c,
  CASE WHEN i.name IS NOT NULL THEN i.apply_type ELSE c.apply_type END AS apply_type, CASE WHEN i.name IS NOT NULL THEN i.is_modifiable ELSE c.is_modifiable END AS is_modifiable,
  CASE WHEN i.name IS NOT NULL THEN i.engine_modes ELSE c.engine_modes END AS engine_modes, CASE WHEN i.name IS NOT NULL THEN i.value ELSE c.value END AS stored,
  m.engine, m.engine_mode, m.is_cluster_writer FROM vals v LEFT JOIN params i ON i.server_id = v.server_id AND i.name = v.name AND i.scope = 'instance'
  LEFT JOIN params c ON c.server_id = v.server_id AND c.name = v.name AND c.scope = 'cluster' JOIN meta m ON m.server_id = v.server_id),
canonical AS (SELECT *, CASE WHEN n = 0 THEN CAST(CAST(trunc(TRY_CAST(recommended AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE recommended END AS r,
  CASE WHEN n = 0 THEN CAST(CAST(trunc(TRY_CAST(stored AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE stored END AS s,
  CASE WHEN n = 0 THEN CAST(CAST(trunc(TRY_CAST(live AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE live END AS l, contains(engine, 'postgres') AS pg,
  CASE n WHEN 1 THEN 1024 WHEN 2 THEN 8192 END AS divisor FROM joined),
native AS (SELECT *, CASE WHEN pg AND divisor IS NOT NULL THEN CASE WHEN CAST(r AS BIGINT) % divisor = 0 THEN CAST(CAST(r AS BIGINT) // divisor AS VARCHAR) END ELSE r END AS wanted FROM canonical),
plan AS (SELECT server_id, name, CASE WHEN has_i OR NOT has_c THEN 'instance' ELSE 'cluster' END AS scope, wanted, apply_type,
  CASE WHEN NOT has_i AND NOT has_c THEN 'absent' WHEN NOT has_i AND NOT engine LIKE 'aurora-%' THEN 'cluster-not-supported' WHEN NOT has_i AND NOT is_cluster_writer THEN 'not-cluster-writer'
    WHEN NOT is_modifiable THEN 'unmodifiable' WHEN len(coalesce(engine_modes, [])) > 0 AND NOT list_contains(list_transform(engine_modes, lambda x: lower(x)), lower(engine_mode)) THEN 'unsupported-engine-mode'
    WHEN wanted IS NULL THEN 'invalid-value' WHEN CASE WHEN stored IS NOT NULL THEN s = wanted ELSE coalesce(l = wanted, false) END THEN 'unchanged'
    WHEN {'true' if dynamic_only else 'false'} AND apply_type = 'static' THEN 'not-dynamic' WHEN lower(apply_type) NOT IN ('dynamic', 'static') THEN 'unsupported-apply-type' END AS reason FROM native),
planned AS (SELECT server_id, name, scope, reason, CASE WHEN reason IS NULL THEN {method} END AS method, CASE WHEN reason IS NULL THEN wanted END AS planned FROM plan)"""


def plan(t: Tables, **options):
    return config.apply_plan_rds(recommendations(t), parameters(t), live(t), metadata(t), **options)


@query("apply_plan_rds", f"WITH {plan_sql(False, False)} SELECT * FROM planned")
def apply_plan_rds(t: Tables):
    return plan(t)


@query("apply_plan_rds_dynamic", f"WITH {plan_sql(True, False)} SELECT * FROM planned")
def apply_plan_rds_dynamic(t: Tables):
    return plan(t, dynamic_only=True)


@query("apply_plan_rds_reboot", f"WITH {plan_sql(False, True)} SELECT * FROM planned")
def apply_plan_rds_reboot(t: Tables):
    return plan(t, pending_reboot_only=True)


@query("unchanged_rule", f"WITH {plan_sql(False, False)} SELECT server_id, count(*) AS unchanged FROM planned WHERE reason = 'unchanged' GROUP BY server_id")
def unchanged_rule(t: Tables):
    return plan(t).filter("reason = 'unchanged'").groupBy("server_id").agg(F.count(F.lit(1)).alias("unchanged"))


LOOKUPS = f"""{VALUES}, missing AS (SELECT DISTINCT v.server_id FROM vals v WHERE NOT EXISTS (SELECT 1 FROM params p WHERE p.server_id = v.server_id AND p.name = v.name AND p.scope = 'instance')),
lookups AS (SELECT m.*, m.engine LIKE 'aurora-%' AND x.server_id IS NOT NULL AS cluster_lookup FROM meta m LEFT JOIN missing x ON x.server_id = m.server_id)"""


@query("cluster_lookup_needed", f"WITH {LOOKUPS} SELECT server_id, cluster_lookup FROM lookups")
def cluster_lookup_needed(t: Tables):
    return config.cluster_lookup_needed(recommendations(t), parameters(t), metadata(t))


@query("group_readiness", f"""WITH {LOOKUPS} SELECT server_id, CASE WHEN instance_status <> 'available' THEN 1
  WHEN configured_group = '' OR lower(configured_group) LIKE 'default.%' OR configured_group <> instance_group THEN 3 WHEN instance_group_status <> 'in-sync' THEN 2
  WHEN engine LIKE 'aurora-%' AND cluster_group_status <> 'in-sync' THEN 4 WHEN cluster_lookup AND configured_cluster_group <> cluster_group THEN 5 ELSE 0 END AS exit_code FROM lookups""")
def group_readiness(t: Tables):
    return config.group_readiness(metadata(t), config.cluster_lookup_needed(recommendations(t), parameters(t), metadata(t)))


BATCHED = f"""{plan_sql(False, False)}, numbered AS (SELECT *, (row_number() OVER (PARTITION BY server_id, scope ORDER BY name) - 1) // 3 + 1 AS batch FROM planned WHERE reason IS NULL),
marked AS (SELECT *, (server_id + batch) % 5 = 0 AS failed FROM numbered),
stops AS (SELECT server_id, min(CASE WHEN failed AND scope = 'instance' THEN batch END) AS i, min(CASE WHEN failed AND scope = 'cluster' THEN batch END) AS c FROM marked GROUP BY 1),
outcomes AS (SELECT m.server_id, m.name, m.scope, m.planned, m.batch, CASE WHEN m.scope = 'cluster' AND s.i IS NOT NULL THEN 'not-run'
  WHEN CASE m.scope WHEN 'instance' THEN s.i ELSE s.c END IS NULL OR m.batch < CASE m.scope WHEN 'instance' THEN s.i ELSE s.c END THEN 'applied'
  WHEN m.batch = CASE m.scope WHEN 'instance' THEN s.i ELSE s.c END THEN 'failed' ELSE 'not-run' END AS outcome FROM marked m JOIN stops s ON s.server_id = m.server_id)"""


def batch_outcomes_of(t: Tables):
    """Batches of three, so that scopes have several; every fifth batch number fails."""
    batched = ranking.batches(plan(t).filter(F.col("reason").isNull()), size=3)
    return ranking.batch_outcomes(batched, (F.col("server_id") + F.col("batch")) % 5 == 0)


@query("batches", f"WITH {BATCHED} SELECT server_id, name, scope, batch, outcome FROM outcomes")
def batches(t: Tables):
    return batch_outcomes_of(t).select("server_id", "name", "scope", "batch", "outcome")


@query("observed_after_apply", f"""WITH {BATCHED}, applied AS (SELECT * FROM outcomes WHERE outcome = 'applied'),
seen AS (SELECT server_id, scope, bool_and(CASE WHEN server_id % 4 = 0 AND batch = 2 THEN false ELSE true END) AS observed FROM applied GROUP BY ALL),
states AS (SELECT server_id, CASE scope WHEN 'instance' THEN CASE WHEN server_id % 6 = 1 THEN 'modifying' ELSE 'available' END ELSE 'available' END AS status, scope,
  CASE server_id % 5 WHEN 0 THEN 'pending-reboot' WHEN 1 THEN 'failed' WHEN 2 THEN 'applying' ELSE 'in-sync' END AS group_status FROM meta, (SELECT unnest(['instance', 'cluster']) AS scope))
SELECT s.server_id, s.scope, observed, observed AND status = 'available' AND group_status IN ('in-sync', 'pending-reboot') AS done,
  observed AND status = 'available' AND group_status = 'failed' AS group_failed, group_status = 'pending-reboot' AS needs_reboot
FROM seen s JOIN states t ON t.server_id = s.server_id AND t.scope = s.scope""")
def observed_after_apply(t: Tables):
    applied = batch_outcomes_of(t).filter("outcome = 'applied'")
    server = F.col("server_id")
    listed = applied.filter(~((server % 4 == 0) & (F.col("batch") == 2))).select("server_id", "scope", "name", F.col("planned").alias("value"))
    states = metadata(t).select("server_id", F.explode(F.array(F.lit("instance"), F.lit("cluster"))).alias("scope")).select(
        "server_id", "scope", F.when((F.col("scope") == "instance") & (server % 6 == 1), "modifying").otherwise("available").alias("status"),
        F.when(server % 5 == 0, "pending-reboot").when(server % 5 == 1, "failed").when(server % 5 == 2, "applying").otherwise("in-sync").alias("group_status"))
    return config.observed_after_apply(applied, listed, states)


@query("scope_outcomes", f"""WITH m AS (SELECT o_orderkey AS server_id, scope, o_orderkey % 3 <> 0 OR scope = 'instance' AS modified, o_orderkey % 2 = 0 AS wait_failed,
  CASE o_custkey % 3 WHEN 0 THEN 'instance' WHEN 1 THEN 'cluster' END AS failed_scope, o_custkey % 5 < 3 AS unresolved FROM orders, (SELECT unnest(['instance', 'cluster']) AS scope))
SELECT server_id, scope, CASE WHEN NOT wait_failed THEN 'success' WHEN failed_scope IS NULL THEN 'failed' WHEN failed_scope = scope THEN 'failed' WHEN unresolved THEN 'unresolved' ELSE 'success' END AS outcome
FROM m WHERE modified""")
def scope_outcomes(t: Tables):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(order.alias("server_id"), order, cust, F.explode(F.array(F.lit("instance"), F.lit("cluster"))).alias("scope"))
    modified = rows.select("server_id", "scope", ((order % 3 != 0) | (F.col("scope") == "instance")).alias("modified"), (order % 2 == 0).alias("wait_failed"),
                           F.when(cust % 3 == 0, "instance").when(cust % 3 == 1, "cluster").alias("failed_scope"), (cust % 5 < 3).alias("unresolved"))
    return config.scope_outcomes(modified)


@query("write_apply_result", f"""WITH {BATCHED}, everything AS (SELECT server_id, scope, name, 'skipped' AS outcome, reason FROM planned WHERE reason IS NOT NULL
  UNION ALL SELECT server_id, scope, name, outcome, NULL FROM outcomes),
lists AS (SELECT server_id, coalesce(string_agg('"' || name || '"', ',' ORDER BY name) FILTER (WHERE scope = 'instance' AND outcome = 'applied'), '') AS ia,
  coalesce(string_agg('{{"name":"' || name || '","reason":"' || reason || '"}}', ',' ORDER BY name) FILTER (WHERE scope = 'instance' AND outcome = 'skipped'), '') AS isk,
  string_agg('"' || name || '"', ',' ORDER BY name) FILTER (WHERE scope = 'instance' AND outcome = 'failed') AS f1,
  coalesce(string_agg('"' || name || '"', ',' ORDER BY name) FILTER (WHERE scope = 'cluster' AND outcome = 'applied'), '') AS ca,
  coalesce(string_agg('{{"name":"' || name || '","reason":"' || reason || '"}}', ',' ORDER BY name) FILTER (WHERE scope = 'cluster' AND outcome = 'skipped'), '') AS csk,
  string_agg('"' || name || '"', ',' ORDER BY name) FILTER (WHERE scope = 'cluster' AND outcome = 'failed') AS f2 FROM everything GROUP BY server_id)
SELECT server_id, '{{"instance":{{"applied":[' || ia || '],"skipped":[' || isk || '],"failed":[' || coalesce('{{"parameters":[' || f1 || '],"error":"aws-api-error"}}', '') || ']}},"cluster":{{"applied":[' || ca ||
  '],"skipped":[' || csk || '],"failed":[' || coalesce('{{"parameters":[' || f2 || '],"error":"aws-api-error"}}', '') || ']}}}}' AS result FROM lists""")
def write_apply_result(t: Tables):
    skipped = plan(t).filter(F.col("reason").isNotNull()).select("server_id", "scope", "name", F.lit("skipped").alias("outcome"), "reason")
    done = batch_outcomes_of(t).select("server_id", "scope", "name", "outcome", F.lit(None).cast("string").alias("reason"))
    return write.write_apply_result(skipped.unionByName(done))


FLAGS = f"""{VALUES}, flags AS (SELECT server_id, name, CASE WHEN n % 3 = 0 THEN live ELSE 'kept' END AS value FROM vals WHERE n % 2 = 0 UNION ALL SELECT server_id, 'own_' || name, live FROM vals WHERE n % 10 = 0),
livev AS (SELECT server_id, name, CASE WHEN n % 5 = 0 THEN value ELSE live END AS value FROM vals WHERE n % 7 <> 0),
known AS (SELECT server_id, name, n % 6 = 0 AS requires_restart FROM vals WHERE NOT (n % 13 = 12 AND server_id % 3 = 0))"""


def flags(t: Tables):
    v, n = values(t), F.col("n")
    own = v.filter(n % 10 == 0).select("server_id", F.concat(F.lit("own_"), "name").alias("name"), F.col("live").alias("value"))
    current = v.filter(n % 2 == 0).select("server_id", "name", F.when(n % 3 == 0, F.col("live")).otherwise("kept").alias("value")).unionByName(own)
    running = v.filter(n % 7 != 0).select("server_id", "name", F.when(n % 5 == 0, F.col("value")).otherwise(F.col("live")).alias("value"))
    known = v.filter(~((n % 13 == 12) & (F.col("server_id") % 3 == 0))).select("server_id", "name", (n % 6 == 0).alias("requires_restart"))
    return current, running, known


def merged_sql(wanted: str, servers: str) -> str:
    return f"""changed AS (SELECT v.server_id, v.name, v.value FROM {wanted} v LEFT JOIN livev l ON l.server_id = v.server_id AND l.name = v.name WHERE v.value IS DISTINCT FROM l.value)
SELECT coalesce(c.server_id, f.server_id) AS server_id, coalesce(c.name, f.name) AS name, coalesce(c.value, f.value) AS value, c.value IS NOT NULL AS changed
FROM changed c FULL JOIN (SELECT * FROM flags {servers}) f ON f.server_id = c.server_id AND f.name = c.name"""


@query("merged_flags", f"WITH {FLAGS}, {merged_sql('vals', '')}")
def merged_flags(t: Tables):
    current, running, known = flags(t)
    return config.merged_flags(recommendations(t), current, running, known)


@query("merged_flags_dynamic", f"""WITH {FLAGS}, aborted AS (SELECT DISTINCT v.server_id FROM vals v WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.server_id = v.server_id AND k.name = v.name)),
wanted AS (SELECT v.* FROM vals v JOIN known k ON k.server_id = v.server_id AND k.name = v.name WHERE NOT k.requires_restart AND v.server_id NOT IN (SELECT server_id FROM aborted)),
{merged_sql('wanted', 'WHERE server_id NOT IN (SELECT server_id FROM aborted)')}""")
def merged_flags_dynamic(t: Tables):
    current, running, known = flags(t)
    return config.merged_flags(recommendations(t), current, running, known, dynamic_only=True)


@query("unknown_names", f"""WITH {FLAGS} SELECT v.server_id, string_agg(v.name, ',' ORDER BY v.name) AS unknown FROM vals v
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.server_id = v.server_id AND k.name = v.name) GROUP BY v.server_id""")
def unknown_names(t: Tables):
    return config.unknown_names(recommendations(t), flags(t)[2]).withColumn("unknown", F.array_join("unknown", ","))


AZURE = f"""{VALUES}, azure AS (SELECT server_id, upper(name) AS name, CASE WHEN n % 4 = 0 THEN value || '.0' ELSE live END AS stored, n % 11 = 0 AS read_only, n % 3 <> 0 AS dynamic, n % 8 = 0 AS pending FROM vals WHERE n % 17 <> 5),
livev AS (SELECT server_id, name, CASE WHEN n % 5 = 0 THEN ' ' || upper(value) ELSE live END AS value FROM vals WHERE n % 7 <> 0),
joined AS (SELECT v.server_id, v.name, v.value, l.value AS live, a.name AS known, a.stored, a.read_only, a.dynamic, a.pending FROM vals v LEFT JOIN livev l ON l.server_id = v.server_id AND l.name = v.name
  LEFT JOIN azure a ON a.server_id = v.server_id AND lower(a.name) = lower(v.name)),
eq AS (SELECT *, lower(trim(coalesce(live, ''))) = lower(trim(value)) OR coalesce(abs(TRY_CAST(nullif(trim(live), '') AS DOUBLE) - TRY_CAST(value AS DOUBLE)) < 1e-9, false) AS same_live,
  lower(trim(coalesce(stored, ''))) = lower(trim(value)) OR coalesce(abs(TRY_CAST(stored AS DOUBLE) - TRY_CAST(value AS DOUBLE)) < 1e-9, false) AS same_stored FROM joined)"""


def azure_sql(dynamic_only: bool) -> str:
    return f"""{AZURE}, acted AS (SELECT *, CASE WHEN same_live THEN 'equal' WHEN known IS NULL THEN 'unknown' WHEN read_only THEN 'read-only' WHEN {'true' if dynamic_only else 'false'} AND NOT dynamic THEN 'needs-restart'
  WHEN same_stored AND pending THEN 'pending-restart' WHEN same_stored THEN 'stored' ELSE 'update' END AS action FROM eq),
plan AS (SELECT server_id, name, action, coalesce(action = 'pending-restart' OR (action = 'update' AND NOT dynamic), false) AS restart,
  known AS provider_name, stored, CASE WHEN action = 'update' THEN trim(value) END AS sent FROM acted)"""


def azure_plan(t: Tables, dynamic_only: bool = False):
    v, n = values(t), F.col("n")
    known = v.filter(n % 17 != 5).select("server_id", F.upper("name").alias("name"), F.when(n % 4 == 0, F.concat("value", F.lit(".0"))).otherwise(F.col("live")).alias("value"),
                                         (n % 11 == 0).alias("read_only"), (n % 3 != 0).alias("dynamic"), (n % 8 == 0).alias("pending_restart"))
    running = v.filter(n % 7 != 0).select("server_id", "name", F.when(n % 5 == 0, F.concat(F.lit(" "), F.upper("value"))).otherwise(F.col("live")).alias("value"))
    return config.apply_plan_azure(recommendations(t), running, known, dynamic_only)


@query("apply_plan_azure", f"WITH {azure_sql(False)} SELECT * FROM plan")
def apply_plan_azure(t: Tables):
    return azure_plan(t)


@query("apply_plan_azure_dynamic", f"WITH {azure_sql(True)} SELECT * FROM plan")
def apply_plan_azure_dynamic(t: Tables):
    return azure_plan(t, True)


@query("azure_exit", f"""WITH {azure_sql(False)} SELECT server_id, count(*) FILTER (WHERE action = 'update') AS updates, count(*) FILTER (WHERE action = 'unknown') AS unknown,
  count(*) FILTER (WHERE action = 'read-only') AS read_only, bool_or(restart) AS restart_required,
  CASE WHEN bool_or(restart) THEN 10 ELSE 0 END AS exit_code, CASE WHEN bool_or(restart) THEN 4 ELSE 1 END AS task_status FROM plan GROUP BY server_id""")
def azure_exit(t: Tables):
    return config.azure_exit(azure_plan(t), restarting=False)


@query("apply_plan_local", f"""WITH {VALUES}, livev AS (SELECT server_id, name, CASE WHEN n % 5 = 0 THEN value || ' ' ELSE live END AS value FROM vals WHERE n % 7 <> 0),
changed AS (SELECT v.server_id, v.name, v.value FROM vals v LEFT JOIN livev l ON l.server_id = v.server_id AND l.name = v.name WHERE v.value <> coalesce(trim(l.value), '<nil>'))
SELECT server_id, 'set global ' || name || '=' || value AS statement, name AS names FROM changed WHERE server_id % 2 = 0
UNION ALL SELECT server_id, 'SELECT pg_reload_conf()', string_agg(name, ',' ORDER BY name) FROM changed WHERE server_id % 2 = 1 GROUP BY server_id""")
def apply_plan_local(t: Tables):
    v, n = values(t), F.col("n")
    running = v.filter(n % 7 != 0).select("server_id", "name", F.when(n % 5 == 0, F.concat("value", F.lit(" "))).otherwise(F.col("live")).alias("value"))
    servers = t.supplier.select(F.col("s_suppkey").alias("server_id"), F.when(F.col("s_suppkey") % 2 == 1, "postgresql").otherwise("mysql").alias("database_type"))
    return config.apply_plan_local(recommendations(t), running, servers).withColumn("names", F.array_join("names", ","))


LOCAL_ERRORS = (None, "Access denied for user", "variable x is a read only variable", "innodb_log_file_size must be at least 4", "syntax error", "permission denied")


@query("local_outcome", f"""WITH a AS (SELECT o_custkey AS server_id, ({b.sql_list(LOCAL_ERRORS)})[CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 6 = 4 THEN 1 ELSE CAST(o_orderkey % 6 % (1 + o_custkey % 6) AS INTEGER) + 1 END] AS error FROM orders),
k AS (SELECT server_id, CASE WHEN error IS NULL THEN '' WHEN contains(error, 'is a read only variable') OR contains(error, 'innodb_log_file_size must be at least') THEN 'restart'
  WHEN contains(error, 'Access denied') OR contains(error, 'permission denied') THEN 'denied' ELSE 'other' END AS kind FROM a),
c AS (SELECT server_id, CASE WHEN bool_or(kind = 'other') THEN 8 WHEN bool_or(kind = 'denied') THEN 9 WHEN bool_or(kind = 'restart') THEN 10 ELSE 0 END AS exit_code FROM k GROUP BY server_id)
SELECT server_id, exit_code, CASE WHEN exit_code IN (8, 9) THEN 4 ELSE 1 END AS task_status FROM c""")
def local_outcome(t: Tables):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    place = F.when((cust % 4 == 0) & (order % 6 == 4), 0).otherwise(order % 6 % (1 + cust % 6)).cast("int")
    return config.local_outcome(t.orders.select(cust.alias("server_id"), F.array(*[F.lit(x) for x in LOCAL_ERRORS])[place].alias("error")))


@query("topology_fields", f"""WITH {TOPOLOGY} SELECT instance_id AS server_id, engine, engine_mode, is_cluster_writer, instance_status FROM topology WHERE error IS NULL""")
def topology_fields(t: Tables):
    """SNK2: the endpoint and the resource id never pass."""
    found = topology(t).filter(F.col("error").isNull()).withColumnRenamed("instance_id", "server_id").withColumn("endpoint", F.lit("secret.host")).withColumn("db_instance_resource_id", F.lit("db-X"))
    return write.topology_fields(found)
