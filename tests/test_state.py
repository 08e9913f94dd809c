"""Stateful jobs: the rules of snapshot reuse, and streams against tables."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.streaming import state, store
from fleetlens.streaming.store import Store

HOUR = 3600
LOG = "server_id bigint, at bigint, id bigint, ok boolean, tables decimal(20,0), size decimal(20,0), ram decimal(20,0)"


def walk(log, threshold, factor, ttl):
    """Brute force over the calls of one server in order."""
    held, out = None, []
    for at, number, ok, tables, size, ram in sorted(log):
        if held and at < held["expires"] and state.is_large(ram, tables, held["size"], threshold, factor) == held["large"]:
            out.append((at, number, "reused", held["at"]))
        elif ok:
            large = state.is_large(ram, tables, size, threshold, factor)
            held = {"at": at, "size": size, "large": large, "expires": at + (ttl if large else state.ORDINARY_TTL)}
            out.append((at, number, "refreshed", at))
        else:
            out.append((at, number, "stale" if held else "error", held["at"] if held else None))
    return out


def run_log(spark, tmp_path, parts, **options):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        state.run_to_end(spark.readStream.schema(LOG).parquet(source), str(tmp_path / "checkpoint"), state.snapshot_sink(sink, **options))
    return sorted((r["server_id"], r["at"], r["id"], r["state"], r["taken_at"]) for r in state.snapshot_calls(spark, sink).collect())


def test_snapshot_rules(spark, tmp_path):
    def call(at, ok, tables=10, size=5, ram=1):
        return (1, at, at, ok, tables, size, ram)
    parts = [[call(0, False), call(HOUR, True), call(2 * HOUR, True), call(HOUR + 42899, True)], [call(HOUR + 42900, False), call(HOUR + 42901, True), call(5, True)],
             [call(20 * HOUR, True, tables=2000, size=10**6), call(20 * HOUR + 1, True, tables=2000, size=10**6)]]
    parts = [[(a, b, c, d, __import__("decimal").Decimal(e), __import__("decimal").Decimal(f), __import__("decimal").Decimal(g)) for a, b, c, d, e, f, g in p] for p in parts]
    got = run_log(spark, tmp_path, parts, threshold=1000, factor=4)
    assert [(at, kind, taken) for _, at, _, kind, taken in got] == [
        (0, "error", None), (5, "late", HOUR), (HOUR, "refreshed", HOUR), (2 * HOUR, "reused", HOUR), (HOUR + 42899, "reused", HOUR), (HOUR + 42900, "stale", HOUR), (HOUR + 42901, "refreshed", HOUR + 42901),
        (20 * HOUR, "refreshed", 20 * HOUR), (20 * HOUR + 1, "reused", 20 * HOUR)]


def test_snapshot_stream_equals_brute_force(spark, tmp_path):
    from decimal import Decimal

    generator = random.Random(3)
    rows = [(s, i * 5 * HOUR + generator.randrange(HOUR), i, generator.random() < 0.7, Decimal(generator.randrange(500, 1500)), Decimal(generator.randrange(10)), Decimal(1))
            for s in (1, 2, 3) for i in range(60)]
    cut = 150 * HOUR
    got = run_log(spark, tmp_path, [[r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]], threshold=1000, factor=4, ttl=100 * HOUR)
    want = []
    for s in (1, 2, 3):
        want += [(s, *r) for r in walk([(r[1], r[2], r[3], int(r[4]), int(r[5]), int(r[6])) for r in rows if r[0] == s], 1000, 4, 100 * HOUR)]
    assert got == sorted(want)


def test_snapshots_are_walked_in_small_batches(spark, tmp_path, monkeypatch):
    """One server's calls go through many Arrow batches, in any order of rows."""
    from decimal import Decimal

    generator = random.Random(8)
    rows = [(generator.choice((1, 1, 1, 2, None)), i * 5 * HOUR, i, generator.random() < 0.7, Decimal(generator.randrange(500, 1500)), Decimal(generator.randrange(10)), Decimal(1)) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = state.snapshot_steps(spark.createDataFrame(generator.sample(rows, len(rows)), LOG), threshold=1000, factor=4, ttl=100 * HOUR).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for s in (1, 2, None):
        want += [(s, *r) for r in walk([(r[1], r[2], r[3], int(r[4]), int(r[5]), int(r[6])) for r in rows if r[0] == s], 1000, 4, 100 * HOUR)]
    order = lambda r: (str(r[0]), *r[1:3])
    assert sorted(((r.server_id, r.at, r.id, r.state, r.taken_at) for r in got), key=order) == sorted(want, key=order)


def test_a_repeated_snapshot_batch_changes_nothing(spark, tmp_path):
    """Killed between the two commits, and repeated as a whole."""
    from decimal import Decimal

    calls = spark.createDataFrame([(1, 10, 1, True, Decimal(1), Decimal(1), Decimal(1)), (1, 20, 2, False, Decimal(1), Decimal(1), Decimal(1))], LOG)
    sink, path = state.snapshot_sink(str(tmp_path)), str(tmp_path)
    append, done = Store.append, []

    def dies(self, *rest):
        if self.path.endswith("held") and not done:
            done.append(1)
            raise RuntimeError("killed")
        return append(self, *rest)
    Store.append = dies
    try:
        with pytest.raises(RuntimeError):
            sink(calls, 0)
        sink(calls, 0)
        sink(calls, 0)
    finally:
        Store.append = append
    assert [tuple(r)[:4] for r in state.snapshot_calls(spark, path).orderBy("at").collect()] == [(1, 10, 1, "refreshed"), (1, 20, 2, "reused")]


def reports(spark, *rows):
    return spark.createDataFrame(rows, "server_id bigint, report_type string, day_text string").select(
        "server_id", "report_type", F.to_timestamp("day_text").alias("collected_at"))


def test_late_reports_pass_once(spark, tmp_path):
    """A server offline for days is not left out, and repeats go whether they come in one batch, later, without a time or by another checkpoint."""
    from fleetlens.sources import read

    def line(server, at):
        return f'{{"server_id": {server}, "report_type": "Metrics", "collected_at": {at}, "document": "{{}}"}}'

    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    new, late, none = '"2024-05-10T00:00:00Z"', '"2024-05-07T00:00:00Z"', "null"
    for number, lines in enumerate([[(1, new), (1, new), (3, none)], [(2, late), (1, new), (2, late), (3, none)], [(2, late), (4, new)]]):
        (source / f"{number}.json").write_text("\n".join(line(*x) for x in lines))
        stream = read.read_snapshot_stream(spark, str(source))
        state.run_to_end(stream, str(tmp_path / "checkpoint"), state.report_sink(sink))
    state.run_to_end(read.read_snapshot_stream(spark, str(source)), str(tmp_path / "another"), state.report_sink(sink))
    got = sorted((r["server_id"], str(r["collected_at"]), r["day"]) for r in state.report_store(spark, sink, stream.schema).read().collect())
    assert got == [(1, "2024-05-10 00:00:00", "2024-05-10"), (2, "2024-05-07 00:00:00", "2024-05-07"), (3, "None", "none"), (4, "2024-05-10 00:00:00", "2024-05-10")]


def test_a_late_report_reads_its_own_day(spark, tmp_path, monkeypatch):
    path, sink, read = str(tmp_path), state.report_sink(str(tmp_path)), []
    for number, day in enumerate(["2022-03-01", "2023-03-01", "2024-03-01", "2024-03-02"]):
        sink(reports(spark, *[(s, "Metrics", day) for s in range(20)]), number)
    rows = Store.rows
    monkeypatch.setattr(Store, "rows", lambda self, parts, columns=None: read.append(sorted(p.day for p in parts)) or rows(self, parts, columns))
    sink(reports(spark, (5, "Metrics", "2022-03-01"), (5, "Queries", "2022-03-01"), (5, "Metrics", "2024-03-05")), 4)
    assert read == [["2022-03-01"]]
    # Nothing that the filters let through: no stored key is read.
    read.clear()
    sink(reports(spark, (10**9, "Other", "2023-03-01")), 5)
    assert read == []
    monkeypatch.undo()
    stored = state.report_store(spark, path, reports(spark, (1, "", "")).schema)
    assert stored.read().count() == 83 and stored.read(["2022-03-01"]).count() == 21


def test_a_batch_killed_before_its_commit_is_no_part(spark, tmp_path, monkeypatch):
    path, sink = str(tmp_path), state.report_sink(str(tmp_path))
    sink(reports(spark, (1, "Metrics", "2024-03-01")), 0)
    commit = Store._commit
    monkeypatch.setattr(Store, "_commit", lambda *rest: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        sink(reports(spark, (2, "Metrics", "2024-03-01"), (1, "Metrics", "2024-03-01")), 1)
    stored = state.report_store(spark, path, reports(spark, (1, "", "")).schema)
    assert [r.server_id for r in stored.read().collect()] == [1]
    monkeypatch.setattr(Store, "_commit", commit)
    for _ in range(2):
        sink(reports(spark, (2, "Metrics", "2024-03-01"), (1, "Metrics", "2024-03-01")), 1)
    assert sorted(r.server_id for r in stored.read().collect()) == [1, 2]


TASK = "task_id bigint, task_type_id int, task_status int, task_exit_code int, reported_at bigint"


def test_running_results_merge_and_stay_bounded(spark, tmp_path, monkeypatch):
    """Batches out of order; parts merge, old ones go, and a reader that has begun sees its version to the end."""
    monkeypatch.setattr(store, "FAN", 3)
    generator = random.Random(2)
    rows = [(generator.randrange(5), 0, generator.choice((1, 3, 4)), generator.randrange(3), generator.randrange(20)) for _ in range(60)]
    sink = state.running_sink(str(tmp_path), state.task_state)
    stored = Store(spark, str(tmp_path), spark.createDataFrame([], TASK).schema, state.task_state)
    begun = None
    for number in range(15):
        sink(spark.createDataFrame(rows[number * 4:number * 4 + 4], TASK), number)
        if number == 12:
            begun = (stored.read(), sorted(map(tuple, stored.read().collect())))
    assert sorted(map(tuple, begun[0].collect())) == begun[1]
    want = sorted(map(tuple, state.task_state(spark.createDataFrame(rows, TASK)).collect()))
    assert sorted(map(tuple, stored.read().collect())) == want
    sink(spark.createDataFrame(rows, TASK), 14)
    assert sorted(map(tuple, stored.read().collect())) == want
    assert len(stored.current().parts) <= 6 and len(list((tmp_path / "versions").glob("0*"))) == store.KEPT_VERSIONS
    assert len(list((tmp_path / "parts").iterdir())) <= 6 + 2 * store.FAN


def test_a_thousand_batches_leave_few_parts(monkeypatch):
    """The list of parts alone, without their rows."""
    monkeypatch.setattr(Store, "_write", lambda self, rows, folder: [None])
    monkeypatch.setattr(Store, "rows", lambda self, parts, columns=None: parts)
    kept, most = Store(None, "x", None), 0
    parts = []
    for number in range(1, 1001):
        parts = kept._merged([*parts, store.Part(f"parts/{number}", None, 0)], number)
        most = max(most, len(parts))
    assert most <= 4 * (store.FAN - 1)


EVENT = "server_id bigint, schema_name string, digest string, sql_text string, timer_start bigint, event_id bigint"


def test_texts_expire(spark, tmp_path, monkeypatch):
    """A table and a stream in any order of batches agree, expired texts go from the stored parts too, and null keys are keys."""
    monkeypatch.setattr(store, "FAN", 2)
    generator = random.Random(4)
    rows = [(generator.choice((1, 2, None)), "s", f"d{i // 3}", f"text {i}", i * 10 + generator.randrange(40), i) for i in range(120)]
    rows += [(1, None, "d", "x", 10**6, 1000), (1, "s", "d", None, 10**6, 1001)]
    want = sorted(map(str, state.sample_text_state(spark.createDataFrame(rows, EVENT), 200).collect()))
    sink = state.sample_text_sink(str(tmp_path), 200)
    mixed = generator.sample(rows, len(rows))
    for number in range(8):
        sink(spark.createDataFrame(mixed[number::8], EVENT), number)
    schema = state.sample_text_state(spark.createDataFrame(rows, EVENT)).schema
    stored = Store(spark, str(tmp_path), schema, lambda r: state.newest_texts(r, 200))
    assert sorted(map(str, stored.read().collect())) == want
    assert len(want) < 40 and stored.rows(stored.current().parts).count() == len(want)


def test_late_discoveries_correct_later_reports(spark, tmp_path):
    """Batches in any order, each repeated, give what the whole table gives; a null server and a missing time are keys as any."""
    generator = random.Random(12)
    day = 86400 * 10**6
    rows = [(generator.choice((1, 1, 2, None)), None if generator.random() < 0.03 else generator.randrange(6) * day + generator.randrange(50) * 10**6, i, generator.random() < 0.4, f"t{i}")
            for i in range(150)]
    schema = "server_id bigint, at bigint, event_id bigint, ok boolean, topology string"
    want = state.topology_state(spark.createDataFrame(rows, schema), F.col("topology")).select("server_id", "at", "event_id", "topology_used", "source")
    sink = state.topology_sink(str(tmp_path))
    mixed = generator.sample(rows, len(rows))
    for number in range(5):
        for _ in range(2 if number == 3 else 1):
            sink(spark.createDataFrame(mixed[number::5], schema), number)
    assert sorted(map(str, state.topology_uses(spark, str(tmp_path)).collect())) == sorted(map(str, want.collect()))


def test_the_routed_stream_counts_a_repeated_batch_once(spark, tmp_path):
    """Killed in the middle of the second batch, after its files were written, and run again."""
    from fleetlens.sources import write

    schema = "server_id bigint, collected_at timestamp, mode string, report_type string"
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.range(60).select(F.col("id").alias("server_id"), F.to_timestamp(F.lit("2024-03-01")).alias("collected_at"),
                                   F.when(F.col("id") % 2 == 0, "Metrics").otherwise("Event").alias("mode"), F.lit("Queries").alias("report_type"))
    for part in range(3):
        frame.filter(F.col("server_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)

    def start():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        write.write_routed_stream(stream, path, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    start()
    # As after a kill between the files of the last batch and its entry in the two logs.
    for log in (tmp_path / "out" / "_spark_metadata", tmp_path / "checkpoint" / "commits"):
        for name in ("2", ".2.crc"):
            if (log / name).exists():
                (log / name).rename(tmp_path / f"{log.name}-{name}")
    assert spark.read.parquet(path).count() == 40
    for _ in range(2):
        start()
    got = spark.read.parquet(path)
    assert sorted(r.server_id for r in got.collect()) == list(range(60))
    assert {r.route for r in got.select("route").distinct().collect()} == {"db_metrics_queries", "events_Queries"}


def test_rates_skip_restarts(spark):
    counters = spark.createDataFrame([(1, "c", 0, 1, 10, 100, None), (1, "c", 10, 2, 30, 110, None), (1, "c", 20, 3, 40, 5, None), (1, "c", 30, 4, 60, 15, None), (1, "c", 40, 5, 70, 25, "r")],
                                     "server_id int, name string, at bigint, id int, value bigint, uptime bigint, reset_at string")
    got = [r["rate"] for r in state.counter_rate(counters).orderBy("id").collect()]
    assert got == [None, 2.0, None, 2.0, None]


@pytest.mark.parametrize("ram,tables,size,want", [(2**63, 2000, 2**64 - 1, False), (0, 2000, 10, False), (1, 1001, 5, True), (1, 1000, 5, False)])
def test_is_large(ram, tables, size, want):
    assert state.is_large(ram, tables, size, 1000, 4) is want
