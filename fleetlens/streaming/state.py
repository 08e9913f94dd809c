"""Continuous jobs: deduplication, newest texts, snapshot reuse, task state and report periods."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.hosts import LARGE_RAM_FACTOR, LARGE_TABLES, LARGE_TTL, ORDINARY_TTL
from ..operators.skew import carry_last
from ..session import pinned
from .store import Store, current_run

# The rules of snapshots travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Seconds between two reports of a kind, and the state of a started task.
REPORT_PERIODS = {"Metrics": 60, "Queries": 3600, "Configurations": 43200}
STARTED = 3
MAX_UNSIGNED = 2**64 - 1


REPORT_KEYS = ["server_id", "report_type", "collected_at"]


def dedupe_reports(reports: DataFrame) -> DataFrame:
    """ST1: one row per server, report type and time. A stream that runs on goes through ``report_sink``, as its state here keeps every key."""
    return reports.dropDuplicates(REPORT_KEYS)


def report_store(spark: SparkSession, path: str, schema: StructType) -> Store:
    """ST1: the stored reports by day, with a filter of each part's keys."""
    return Store(spark, path, schema, days=True, keys=REPORT_KEYS)


DAYS = "yyyy-MM-dd"
"""Stored reports are kept apart by day; thin ones by a longer period."""


def report_sink(path: str, period: str = DAYS) -> Callable[[DataFrame, int], None]:
    """ST1 on a stream: each batch's reports that are not stored yet, however late they are, and whichever checkpoint wrote the others.

    Only the days that the batch has are looked at, and their stored keys only where the filters do not rule out all of the
    batch. A batch that was stored before is left out.
    """
    def write(batch: DataFrame, number: int) -> None:
        run = current_run(batch.sparkSession)
        store = report_store(batch.sparkSession, path, batch.schema)
        version = store.current()
        if store.written(run, number, version):
            return
        fresh = dedupe_reports(batch).withColumn("day", F.coalesce(F.date_format("collected_at", period), F.lit("none"))).persist()
        try:
            days = [r.day for r in fresh.select("day").distinct().collect()]
            known = [p for p in version.parts if p.day in days]
            if known:
                met = {r.day for r in store.perhaps_stored(fresh, days, version).select("day").distinct().collect()}
                known = [p for p in known if p.day in met]
            new = fresh
            if known:
                stored = store.rows(known, REPORT_KEYS).select(*[F.col(c).alias(f"_{c}") for c in REPORT_KEYS])
                first, *rest = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in REPORT_KEYS]
                for same in rest:
                    first = first & same
                new = fresh.join(stored, first, "left_anti")
            store.append(new, run, number, version)
        finally:
            fresh.unpersist()
    return write


def running_sink(path: str, merge: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for running results: each batch's own result, which ``merge`` puts together with those before it.

    ``merge`` takes results to results, in any order and grouping; the stream itself keeps no state.
    """
    def write(batch: DataFrame, number: int) -> None:
        run = current_run(batch.sparkSession)
        rows = merge(prepare(batch) if prepare else batch)
        store = Store(batch.sparkSession, path, rows.schema, merge)
        version = store.current()
        if not store.written(run, number, version):
            store.append(rows, run, number, version)
    return write


TEXT_KEYS = ("server_id", "schema_name", "digest")


def text_points(events: DataFrame) -> DataFrame:
    """ST2: the events that have a text, with the place that decides which is the newest."""
    known = events.filter(F.col("schema_name").isNotNull() & F.col("digest").isNotNull() & F.col("sql_text").isNotNull())
    return known.select(*TEXT_KEYS, "sql_text", F.struct("timer_start", "event_id").alias("seen"))


def newest_texts(points: DataFrame, ttl: int | None = None) -> DataFrame:
    """ST2: the newest text per server, schema and digest; texts whose newest event lies more than ``ttl`` before the server's newest go.

    Merging results gives the result of all their events, so it serves tables and streams alike. Texts of a hot key are
    reduced on the map side.
    """
    newest = points.groupBy(*TEXT_KEYS).agg(F.max_by("sql_text", "seen").alias("sql_text"), F.max("seen").alias("seen"))
    if ttl is None:
        return newest
    ends = points.groupBy("server_id").agg(F.max("seen.timer_start").alias("_end")).withColumnRenamed("server_id", "_server")
    return newest.join(ends, F.col("server_id").eqNullSafe(F.col("_server"))).filter(
        F.col("seen.timer_start") >= F.col("_end") - ttl).drop("_server", "_end")


def sample_text_state(events: DataFrame, ttl: int | None = None) -> DataFrame:
    """ST2: the newest text per server, schema and digest, of those that have not expired."""
    return newest_texts(text_points(events), ttl)


def sample_text_sink(path: str, ttl: int | None = None) -> Callable[[DataFrame, int], None]:
    """ST2 on a stream: expired texts go when parts merge, and are never read."""
    return running_sink(path, lambda rows: newest_texts(rows, ttl), text_points)


def task_state(reports: DataFrame) -> DataFrame:
    """ST6: the newest state of each task; its final report wins over the started one of the same time.

    Merging results gives the result of all their reports.
    """
    final = (F.col("task_status") != STARTED).cast("int")
    return reports.groupBy("task_id").agg(
        F.max_by(F.struct("task_type_id", "task_status", "task_exit_code"), F.struct("reported_at", final, "task_status", "task_exit_code")).alias("_state"),
        F.max("reported_at").alias("reported_at")).select("task_id", "_state.*", "reported_at")


def topology_state(discoveries: DataFrame, topology: Column, keys: Sequence[str] = ("server_id",),
                   order: Sequence[str] = ("at", "event_id")) -> DataFrame:
    """ST5: the topology used for each report: its own if discovery worked, else the newest good one before it."""
    good = F.when(F.col("ok"), topology)
    return (carry_last(discoveries, keys, order, good, "topology_used")
            .withColumn("source", F.when(F.col("ok"), "live").when(F.col("topology_used").isNotNull(), "cache").otherwise("none")))


TOPOLOGY_SEEN = "server_id BIGINT, at BIGINT, event_id BIGINT, ok BOOLEAN, topology STRING"
TOPOLOGY_GOOD = "server_id BIGINT, day STRING, place STRUCT<at: BIGINT, event_id: BIGINT>, topology STRING"
TOPOLOGY_USED = "server_id BIGINT, at BIGINT, event_id BIGINT, topology_used STRING, source STRING, version BIGINT"


def newest_good(rows: DataFrame) -> DataFrame:
    """ST5: the newest good topology of each server and day; merging results gives that of all."""
    return rows.groupBy("server_id", "day").agg(F.max("place").alias("place"), F.max_by("topology", "place").alias("topology"))


def newest_use(rows: DataFrame) -> DataFrame:
    """ST5: what each report used by its last correction."""
    last = F.max_by(F.struct("topology_used", "source"), "version").alias("_last")
    return rows.groupBy("server_id", "at", "event_id").agg(last, F.max("version").alias("version")).select("server_id", "at", "event_id", "_last.*", "version")


def topology_stores(spark: SparkSession, path: str) -> tuple[Store, Store, Store]:
    """ST5: all discoveries by day, the newest good one of each server and day, and what each report used."""
    kind = lambda text: spark.createDataFrame([], text).schema
    return (Store(spark, f"{path}/seen", kind(TOPOLOGY_SEEN), days=True), Store(spark, f"{path}/good", kind(TOPOLOGY_GOOD), newest_good),
            Store(spark, f"{path}/used", kind(TOPOLOGY_USED), newest_use))


def topology_sink(path: str) -> Callable[[DataFrame, int], None]:
    """ST5 on a stream: late discoveries correct what later reports used.

    A batch is stored with the discoveries of its days. Its servers are then walked again from the first day the batch has of them, behind
    the newest good topology of the days before, up to the first good discovery behind the batch's last: nothing behind that
    one can change. A discovery is its server, time in microseconds and id; the last of repeated ones counts. Without a time it comes first.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = current_run(spark)
        seen, good, used = topology_stores(spark, path)
        before = used.current()
        if used.written(run, number, before):
            return
        place, key = F.struct("at", "event_id"), F.col("server_id").eqNullSafe(F.col("_server"))
        day = F.coalesce(F.date_format(F.timestamp_micros("at"), DAYS), F.lit("0000"))
        rows = pinned(batch.select("server_id", "at", "event_id", "ok", "topology").withColumn("day", day))
        for store, new in ((seen, rows), (good, newest_good(rows.filter("ok").withColumn("place", place).select("server_id", "day", "place", "topology")))):
            version = store.current()
            if not store.written(run, number, version):
                store.append(new, run, number, version)
        touched = pinned(rows.groupBy(F.col("server_id").alias("_server")).agg(F.min("day").alias("_from"), F.max(place).alias("_last")))
        first = touched.agg(F.min("_from")).first()[0] or "9999"
        again = seen.rows([p for p in seen.current().parts if p.day >= first]).dropDuplicates(["server_id", "at", "event_id"])
        again = again.join(touched, key).filter(F.col("day") >= F.col("_from"))
        ends = again.filter(F.col("ok") & (place > F.col("_last"))).groupBy(F.col("server_id").alias("_of")).agg(F.min(place).alias("_until"))
        again = again.join(ends, F.col("server_id").eqNullSafe(F.col("_of")), "left").filter(F.col("_until").isNull() | (place <= F.col("_until")))
        held = good.read().join(touched, key).filter(F.col("day") < F.col("_from")).groupBy("server_id").agg(
            F.max("place").alias("place"), F.max_by("topology", "place").alias("topology"))
        start = held.select("server_id", "place.at", "place.event_id", F.lit(True).alias("ok"), "topology", F.lit(True).alias("held"))
        all_rows = again.select("server_id", "at", "event_id", "ok", "topology", F.lit(False).alias("held")).unionByName(start)
        found = topology_state(all_rows, F.col("topology")).filter(~F.col("held"))
        result = found.select("server_id", "at", "event_id", "topology_used", "source", F.lit(before.number + 1).cast("bigint").alias("version"))
        used.append(result, run, number, before)
    return write


def topology_uses(spark: SparkSession, path: str) -> DataFrame:
    """ST5: the results that ``topology_sink`` has stored."""
    return topology_stores(spark, path)[2].read().drop("version")


def snapshot_peek(log: DataFrame, value: Column, keys: Sequence[str] = ("server_id",),
                  order: Sequence[str] = ("at", "id")) -> DataFrame:
    """ST3: the last complete snapshot at each moment, also after its expiry; failed refreshes leave it as it is."""
    return carry_last(log, keys, order, F.when(F.col("ok"), value), "served")


def period_buckets(reports: DataFrame, at: Column) -> DataFrame:
    """ST7: reports per server, kind and period of that kind; more than one is a duplicate."""
    periods = F.create_map(*[F.lit(x) for pair in REPORT_PERIODS.items() for x in pair])
    period = periods[F.col("report_type")].cast("bigint")
    return (reports.withColumn("period_start", F.floor(at / period) * period).filter(F.col("period_start").isNotNull())
            .groupBy("server_id", "report_type", "period_start").agg(F.count(F.lit(1)).alias("reports")))


def period_gaps(buckets: DataFrame) -> DataFrame:
    """ST7: periods with reports, periods without any between the first and the last, and surplus reports."""
    periods = F.create_map(*[F.lit(x) for pair in REPORT_PERIODS.items() for x in pair])
    length = periods[F.col("report_type")].cast("bigint")
    return buckets.groupBy("server_id", "report_type").agg(
        F.count(F.lit(1)).alias("periods"), F.sum(F.col("reports") - 1).alias("duplicates"),
        F.min("period_start").alias("_first"), F.max("period_start").alias("_last")).select(
        "server_id", "report_type", "periods", "duplicates",
        (F.floor((F.col("_last") - F.col("_first")) / length) + 1 - F.col("periods")).alias("gaps"))


def counter_rate(counters: DataFrame, keys: Sequence[str] = ("server_id", "name"),
                 order: Sequence[str] = ("at", "id")) -> DataFrame:
    """Change per second since the snapshot before; missing after a restart or a reset of the statistics."""
    now = F.struct("at", "value", "uptime", "reset_at")
    before = carry_last(counters, keys, order, now, "_before", include_current=False)
    seconds = F.col("at") - F.col("_before.at")
    valid = ((F.col("uptime") >= F.col("_before.uptime")) & F.col("reset_at").eqNullSafe(F.col("_before.reset_at"))
             & (F.col("value") >= F.col("_before.value")) & (seconds > 0))
    return before.withColumn("rate", F.when(valid, (F.col("value") - F.col("_before.value")) / seconds)).drop("_before")


def is_large(ram: int, tables: int, size: int, threshold: int, factor: int) -> bool:
    """ST4 for a single snapshot."""
    limit = ram * factor
    return ram > 0 and threshold >= 0 and factor >= 0 and tables > threshold and limit <= MAX_UNSIGNED and size > limit


SNAPSHOT_OUTPUT = "server_id BIGINT, at BIGINT, id BIGINT, state STRING, taken_at BIGINT, large BOOLEAN, expires_at BIGINT, size DECIMAL(20,0)"


def snapshot_walk(threshold: int, factor: int, ttl: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """ST3 over rows in the order of server, then what it holds from before (``held``), then calls by time and id.

    A refresh is due when there is no snapshot, when it expired, or when the server changed its size class. A failed
    refresh serves the old snapshot without extending it. A call that is not newer than the last handled one is ``late``: it
    is served what is held and changes nothing. Batches are read one after the other; from one to the next go only the numbers of the server
    at hand.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        server, known = None, False
        taken = expires = size = large = last = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not known or row["server_id"] != server:
                    server, known = row["server_id"], True
                    taken = expires = size = large = last = None
                place = (row["at"], row["id"])
                if row["held"]:
                    taken, expires, size, large, last = row["taken_at"], row["expires_at"], row["size"], row["large"], place
                    continue
                if last is not None and place <= last:
                    out.append((server, *place, "late", taken, large, expires, size))
                    continue
                last, state = place, "reused"
                count, ram = int(row["tables"]), int(row["ram"])
                if taken is None or row["at"] >= expires or is_large(ram, count, int(size), threshold, factor) != large:
                    if row["ok"]:
                        state, taken, size = "refreshed", place[0], row["size"]
                        large = is_large(ram, count, int(size), threshold, factor)
                        expires = place[0] + (ttl if large else ORDINARY_TTL)
                    else:
                        state = "error" if taken is None else "stale"
                out.append((server, *place, state, taken, large, expires, size))
            columns = zip(*out) if out else [()] * len(WALKED)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, WALKED.types)], schema=WALKED)
    return walk


WALKED = pa.schema([("server_id", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("state", pa.string()), ("taken_at", pa.int64()),
                    ("large", pa.bool_()), ("expires_at", pa.int64()), ("size", pa.decimal128(20, 0))])


def snapshot_steps(calls: DataFrame, held: DataFrame | None = None, threshold: int = LARGE_TABLES, factor: int = LARGE_RAM_FACTOR,
                   ttl: int = LARGE_TTL) -> DataFrame:
    """ST3: which snapshot each call is served, and what its server then holds, after what is ``held`` from before.

    Calls of one server depend on each other. They come sorted to one task, which reads them batch by batch.
    """
    size = F.col("size").cast("decimal(20,0)").alias("size")
    rows = calls.select("server_id", "at", "id", F.lit(False).alias("held"), F.col("ok"), "tables", "ram", size)
    if held is not None:
        mine = held.join(calls.select(F.col("server_id").alias("_server")).distinct(), F.col("server_id").eqNullSafe(F.col("_server")), "left_semi")
        rows = rows.unionByName(mine.select("server_id", "at", "id", F.lit(True).alias("held"), "taken_at", "expires_at", "large", size), allowMissingColumns=True)
    else:
        rows = rows.withColumns({"taken_at": F.lit(None).cast("bigint"), "expires_at": F.lit(None).cast("bigint"), "large": F.lit(None).cast("boolean")})
    ordered = rows.repartition("server_id").sortWithinPartitions("server_id", F.col("held").desc(), "at", "id")
    return ordered.mapInArrow(snapshot_walk(threshold, factor, ttl), SNAPSHOT_OUTPUT)


def newest_held(steps: DataFrame) -> DataFrame:
    """ST3: what each server holds after its last call that was not late; merging results gives that of all."""
    fields = ["at", "id", "taken_at", "large", "expires_at", "size"]
    return steps.groupBy("server_id").agg(F.max_by(F.struct(*fields), F.struct("at", "id")).alias("_last")).select("server_id", "_last.*")


def snapshot_sink(path: str, threshold: int = LARGE_TABLES, factor: int = LARGE_RAM_FACTOR, ttl: int = LARGE_TTL) -> Callable[[DataFrame, int], None]:
    """ST3 on a stream: the calls' outcomes below ``calls``, what servers hold below ``held``.

    Outcomes are committed first; a batch that is repeated in between starts from the same held rows and commits the rest.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = current_run(spark)
        held = Store(spark, f"{path}/held", newest_held(spark.createDataFrame([], SNAPSHOT_OUTPUT)).schema, newest_held)
        before = held.current()
        if held.written(run, number, before):
            return
        steps = pinned(snapshot_steps(batch, held.read(), threshold, factor, ttl))
        calls = Store(spark, f"{path}/calls", steps.schema)
        now = calls.current()
        if not calls.written(run, number, now):
            calls.append(steps, run, number, now)
        held.append(newest_held(steps.filter("state <> 'late'")), run, number, before)
    return write


def snapshot_calls(spark: SparkSession, path: str) -> DataFrame:
    """ST3: the outcomes that ``snapshot_sink`` has stored."""
    schema = spark.createDataFrame([], SNAPSHOT_OUTPUT).schema
    return Store(spark, f"{path}/calls", schema).read().select("server_id", "at", "id", "state", "taken_at", "large")


def run_to_end(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over everything that has landed, batch by batch into ``sink``."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").foreachBatch(sink).start().awaitTermination()
