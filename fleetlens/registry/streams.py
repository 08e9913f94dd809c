"""Queries of the stateful jobs, as tables and as streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import read
from ..streaming import state
from ..streaming.store import Store
from . import bindings as b
from . import landing
from .base import Tables, query

DAY = 86400
PARTS = 3
YEARS = "yyyy"


def run_landing(t: Tables, rows, part, sink) -> None:
    """Land the rows in a few parts, by the number in ``part``, and run the stream after each: a part is one batch, bounded by its number of files."""
    source, checkpoint = landing.fresh_dir(t, "landed"), landing.fresh_dir(t, "checkpoint")
    files = t.spark.sparkContext.defaultParallelism
    for number in range(PARTS):
        rows.filter(part == number).repartition(files).write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)
        state.run_to_end(stream, checkpoint, sink)


def mixed(*columns):
    """A part that says nothing about time, so that old rows come after new ones."""
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS))


REPORTS = """SELECT o_custkey AS server_id, CASE o_orderstatus WHEN 'F' THEN 'Metrics' WHEN 'O' THEN 'Queries' ELSE 'Configurations' END AS report_type,
  CAST(epoch(o_orderdate) AS BIGINT) AS collected_at FROM orders"""


@query("dedupe_reports", f"SELECT DISTINCT * FROM ({REPORTS})")
def dedupe_reports(t: Tables):
    reports = landing.bronze(t).select("server_id", "report_type", "collected_at")
    twice = reports.unionByName(reports)
    return state.dedupe_reports(twice).withColumn("collected_at", F.unix_timestamp("collected_at"))


@query("read_snapshot_stream", f"SELECT DISTINCT * FROM ({REPORTS})")
def read_snapshot_stream(t: Tables):
    """SRC2 and ST1: the reports land twice and are read by two streams, the second with a checkpoint of its own; each is stored once."""
    documents = landing.report_documents(t)
    source = landing.landed(t, documents.unionByName(documents))
    path, stream = landing.fresh_dir(t, "out"), None
    for _ in range(2):
        stream = read.read_snapshot_stream(t.spark, source, t.spark.sparkContext.defaultParallelism).select("server_id", "report_type", "collected_at")
        state.run_to_end(stream, landing.fresh_dir(t, "checkpoint"), state.report_sink(path, YEARS))
    stored = state.report_store(t.spark, path, stream.schema).read().drop("day")
    return stored.withColumn("collected_at", F.unix_timestamp("collected_at"))


@query("late_reports", f"""SELECT r.*, strftime(make_timestamp(collected_at * 1000000), '%Y') AS day FROM (SELECT DISTINCT * FROM ({REPORTS})) r""")
def late_reports(t: Tables):
    """ST1: batches that mix all times, so that late reports meet the stored keys of their own year."""
    rows = landing.bronze(t).select("server_id", "report_type", "collected_at")
    path = landing.fresh_dir(t, "out")
    run_landing(t, rows.unionByName(rows), mixed("server_id", "report_type"), state.report_sink(path, YEARS))
    return state.report_store(t.spark, path, rows.schema).read().withColumn("collected_at", F.unix_timestamp("collected_at"))


NEWEST_TEXTS = f"""{b.STATEMENT_EVENTS}, newest AS (SELECT server_id, schema_name, digest, arg_max(sql_text, (timer_start, event_id)) AS sql_text, max(timer_start) AS seen
FROM statement_events WHERE schema_name IS NOT NULL AND digest IS NOT NULL AND sql_text IS NOT NULL GROUP BY ALL)"""
LIVE_TEXTS = f"""WITH {NEWEST_TEXTS} SELECT server_id, schema_name, digest, sql_text FROM (SELECT *, max(seen) OVER (PARTITION BY server_id) AS last_seen FROM newest)
WHERE seen >= last_seen - {10 * DAY * 1000000}"""


def texts(t: Tables, ttl=None):
    """ST2: the statement events come in three batches that mix all times."""
    path, events = landing.fresh_dir(t, "out"), b.statement_events(t)
    run_landing(t, events, mixed("event_id"), state.sample_text_sink(path, ttl))
    stored = Store(t.spark, path, state.sample_text_state(events).schema, lambda rows: state.newest_texts(rows, ttl)).read()
    return stored.select(*state.TEXT_KEYS, "sql_text")


@query("sample_text_state", f"WITH {NEWEST_TEXTS} SELECT server_id, schema_name, digest, sql_text FROM newest")
def sample_text_state(t: Tables):
    return texts(t)


@query("sample_text_ttl", LIVE_TEXTS)
def sample_text_ttl(t: Tables):
    return state.sample_text_state(b.statement_events(t), 10 * DAY * 1000000).select(*state.TEXT_KEYS, "sql_text")


@query("sample_text_ttl_stream", LIVE_TEXTS)
def sample_text_ttl_stream(t: Tables):
    return texts(t, 10 * DAY * 1000000)


def task_reports(t: Tables):
    order = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("task_id"), (F.col("o_custkey") % 9).cast("int").alias("task_type_id"), F.when(F.col("o_orderstatus") == "O", 3).when(F.col("o_orderstatus") == "F", 4).otherwise(1).alias("task_status"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(order % 11).cast("int").alias("task_exit_code"), b.seconds("o_orderdate").alias("reported_at"))


TASKS = """WITH r AS (SELECT o_custkey AS task_id, CAST(o_custkey % 9 AS INTEGER) AS task_type_id, CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'F' THEN 4 ELSE 1 END AS task_status,
  CASE o_orderstatus WHEN 'O' THEN 0 ELSE CAST(o_orderkey % 11 AS INTEGER) END AS task_exit_code, CAST(epoch(o_orderdate) AS BIGINT) AS reported_at FROM orders)
SELECT task_id, task_type_id, task_status, task_exit_code, reported_at FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY reported_at DESC, task_status <> 3 DESC, task_status DESC, task_exit_code DESC) AS n FROM r) WHERE n = 1"""


@query("task_state", TASKS)
def task_state(t: Tables):
    return state.task_state(task_reports(t))


@query("task_state_stream", TASKS)
def task_state_stream(t: Tables):
    path, reports = landing.fresh_dir(t, "out"), task_reports(t)
    run_landing(t, reports, mixed("task_id", "reported_at"), state.running_sink(path, state.task_state))
    return Store(t.spark, path, state.task_state(reports).schema, state.task_state).read()


def snapshot_log(t: Tables):
    order = F.col("o_orderkey")
    return t.orders.select(
        (F.col("o_custkey") % 50).alias("server_id"), b.seconds("o_orderdate").alias("at"), order.alias("id"), (F.col("o_orderstatus") != "F").alias("ok"),
        (order * 7 % 30000).cast("decimal(20,0)").alias("tables"), (F.floor("o_totalprice") * 20000).cast("decimal(20,0)").alias("size"),
        ((F.col("o_custkey") % 50 + 1) * 10000000).cast("decimal(20,0)").alias("ram"))


LOG = """log AS (SELECT o_custkey % 50 AS server_id, CAST(epoch(o_orderdate) AS BIGINT) AS seen, o_orderkey AS id, o_orderstatus <> 'F' AS ok, o_orderkey * 7 % 30000 AS tables,
  CAST(floor(o_totalprice) AS BIGINT) * 20000 AS size, (o_custkey % 50 + 1) * 10000000 AS ram FROM orders)"""


@query("snapshot_peek", f"""WITH {LOG} SELECT server_id, seen AS "at", id, ok, last_value(CASE WHEN ok THEN id END IGNORE NULLS) OVER (PARTITION BY server_id ORDER BY seen, id) AS served FROM log""")
def snapshot_peek(t: Tables):
    return state.snapshot_peek(snapshot_log(t), F.col("id")).select("server_id", "at", "id", "ok", "served")


@query("snapshot_state", f"""WITH RECURSIVE {LOG}, parts AS (SELECT *, CASE WHEN id % 10 = 0 THEN {PARTS - 1} ELSE (seen - (SELECT min(seen) FROM log)) // ((SELECT max(seen) - min(seen) FROM log) // {PARTS} + 1) END AS part FROM log),
ends AS (SELECT server_id AS server, max((seen, id)) AS place FROM parts WHERE part < {PARTS - 1} GROUP BY server_id),
judged AS (SELECT parts.*, part = {PARTS - 1} AND coalesce((seen, id) <= place, false) AS late FROM parts LEFT JOIN ends ON server_id = server),
numbered AS (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY seen, id) AS n, tables > 10000 AND size > ram * 4 AS own FROM judged WHERE NOT late),
walk AS (SELECT server_id, n, seen, id, CASE WHEN ok THEN 'refreshed' ELSE 'error' END AS state, CASE WHEN ok THEN seen END AS taken_at, CASE WHEN ok THEN size END AS held, CASE WHEN ok THEN own END AS large FROM numbered WHERE n = 1
  UNION ALL SELECT l.server_id, l.n, l.seen, l.id,
    CASE WHEN w.taken_at IS NOT NULL AND l.seen < w.taken_at + CASE WHEN w.large THEN 604800 ELSE 42900 END AND (l.tables > 10000 AND w.held > l.ram * 4) = w.large THEN 'reused'
      WHEN l.ok THEN 'refreshed' WHEN w.taken_at IS NULL THEN 'error' ELSE 'stale' END AS state,
    CASE WHEN NOT (w.taken_at IS NOT NULL AND l.seen < w.taken_at + CASE WHEN w.large THEN 604800 ELSE 42900 END AND (l.tables > 10000 AND w.held > l.ram * 4) = w.large) AND l.ok THEN l.seen ELSE w.taken_at END,
    CASE WHEN NOT (w.taken_at IS NOT NULL AND l.seen < w.taken_at + CASE WHEN w.large THEN 604800 ELSE 42900 END AND (l.tables > 10000 AND w.held > l.ram * 4) = w.large) AND l.ok THEN l.size ELSE w.held END,
    CASE WHEN NOT (w.taken_at IS NOT NULL AND l.seen < w.taken_at + CASE WHEN w.large THEN 604800 ELSE 42900 END AND (l.tables > 10000 AND w.held > l.ram * 4) = w.large) AND l.ok THEN l.own ELSE w.large END
  FROM walk w JOIN numbered l ON l.server_id = w.server_id AND l.n = w.n + 1)
SELECT server_id, seen AS "at", id, state, taken_at, large FROM walk
UNION ALL SELECT l.server_id, l.seen, l.id, 'late', h.taken_at, h.large FROM judged l LEFT JOIN (
  SELECT w.server_id, arg_max(w.taken_at, w.n) FILTER (WHERE w.taken_at IS NOT NULL) AS taken_at, arg_max(w.large, w.n) FILTER (WHERE w.taken_at IS NOT NULL) AS large
  FROM walk w JOIN parts p USING (server_id, id) WHERE p.part < {PARTS - 1} GROUP BY w.server_id) h USING (server_id) WHERE l.late""")
def snapshot_state(t: Tables):
    """ST3: the calls come in the order of time in three batches, but for a tenth of them, which the last batch brings."""
    log = snapshot_log(t)
    low, high = log.agg(F.min("at"), F.max("at")).first()
    part = F.when(F.col("id") % 10 == 0, PARTS - 1).otherwise(F.floor((F.col("at") - F.lit(low)) / F.lit((high - low) // PARTS + 1)))
    path = landing.fresh_dir(t, "out")
    run_landing(t, log, part, state.snapshot_sink(path))
    return state.snapshot_calls(t.spark, path)


TOPOLOGY = """WITH d AS (SELECT user_id AS server_id, epoch_us(ts) AS seen, event_id, event_type NOT IN ('error', 'view') AS ok, event_type || CAST(event_id AS VARCHAR) AS topology FROM events),
u AS (SELECT *, last_value(CASE WHEN ok THEN topology END IGNORE NULLS) OVER (PARTITION BY server_id ORDER BY seen, event_id) AS topology_used FROM d)
SELECT server_id, event_id, topology_used, CASE WHEN ok THEN 'live' WHEN topology_used IS NOT NULL THEN 'cache' ELSE 'none' END AS source FROM u"""


def discoveries(t: Tables):
    return t.events.select(F.col("user_id").alias("server_id"), b.micros("ts").alias("at"), "event_id", (~F.col("event_type").isin("error", "view")).alias("ok"),
                           F.concat("event_type", F.col("event_id").cast("string")).alias("topology"))


@query("topology_state", TOPOLOGY)
def topology_state(t: Tables):
    used = state.topology_state(discoveries(t), F.col("topology"))
    return used.select("server_id", "event_id", "topology_used", "source")


@query("topology_state_stream", TOPOLOGY)
def topology_state_stream(t: Tables):
    """The same from batches that mix all times, each of which corrects those before it."""
    path = landing.fresh_dir(t, "out")
    run_landing(t, discoveries(t), mixed("event_id"), state.topology_sink(path))
    return state.topology_uses(t.spark, path).select("server_id", "event_id", "topology_used", "source")


PERIODS = """buckets AS (SELECT server_id, report_type, seen // period * period AS period_start, count(*) AS reports FROM (
  SELECT user_id AS server_id, CASE event_id % 3 WHEN 0 THEN 'Metrics' WHEN 1 THEN 'Queries' ELSE 'Configurations' END AS report_type,
    CASE event_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 3600 ELSE 43200 END AS period, CAST(floor(epoch(ts)) AS BIGINT) AS seen FROM events) GROUP BY ALL)"""


def buckets(t: Tables):
    kind = F.when(F.col("event_id") % 3 == 0, "Metrics").when(F.col("event_id") % 3 == 1, "Queries").otherwise("Configurations")
    return state.period_buckets(t.events.select(F.col("user_id").alias("server_id"), kind.alias("report_type"), b.seconds("ts").alias("at")), F.col("at"))


@query("period_buckets", f"WITH {PERIODS} SELECT * FROM buckets")
def period_buckets(t: Tables):
    return buckets(t)


@query("period_gaps", f"""WITH {PERIODS} SELECT server_id, report_type, count(*) AS periods, CAST(sum(reports - 1) AS BIGINT) AS duplicates,
  (max(period_start) - min(period_start)) // CASE report_type WHEN 'Metrics' THEN 60 WHEN 'Queries' THEN 3600 ELSE 43200 END + 1 - count(*) AS gaps FROM buckets GROUP BY server_id, report_type""")
def period_gaps(t: Tables):
    return state.period_gaps(buckets(t))


@query("counter_rate", """WITH c AS (SELECT user_id AS server_id, event_type AS name, CAST(floor(epoch(ts)) AS BIGINT) AS seen, event_id, event_id * 10 + CAST(floor(value) AS BIGINT) AS v, event_id % 1000 AS uptime,
  CASE WHEN event_id > 5000 THEN 'r' END AS reset_at FROM events),
p AS (SELECT *, lag(seen) OVER w AS s0, lag(v) OVER w AS v0, lag(uptime) OVER w AS u0, lag(reset_at) OVER w AS r0 FROM c WINDOW w AS (PARTITION BY server_id, name ORDER BY seen, event_id))
SELECT server_id, name, event_id AS id, CASE WHEN uptime >= u0 AND reset_at IS NOT DISTINCT FROM r0 AND v >= v0 AND seen > s0 THEN (v - v0) / (seen - s0) END AS rate FROM p""")
def counter_rate(t: Tables):
    event = F.col("event_id")
    counters = t.events.select(F.col("user_id").alias("server_id"), F.col("event_type").alias("name"), b.seconds("ts").alias("at"), event.alias("id"),
                               (event * 10 + F.floor("value")).alias("value"), (event % 1000).alias("uptime"), F.when(event > 5000, "r").alias("reset_at"))
    return state.counter_rate(counters).select("server_id", "name", "id", "rate")
