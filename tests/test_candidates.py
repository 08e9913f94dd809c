"""The chain from statements to plans: sharing, quota per ranking, copying."""

import random

from pyspark.sql import functions as F

from fleetlens.operators import ranking


def statement(number, total, mean, query=None, database="db", calls=1, native=None):
    return (1, f"q{number:04d}", database, number if native is None else native, query or f"select {number}", total, mean, calls)


SCHEMA = ("server_id int, queryid string, datname string, pg_queryid bigint, query string, total_exec_time_us double, "
          "mean_exec_time_us double, calls int")


def test_two_quotas_over_shared_plans(spark):
    rows = [statement(i, 1000.0 - i, float(i)) for i in range(210)]
    rows += [(1, f"r{i:04d}", "db", i, f"select {i}", 0.5, 0.5, 1) for i in range(0, 210, 10)]  # other roles' rows of the same plans
    rows += [statement(900 + i, 5000.0, 5000.0, calls=0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.queryid: r for r in ranking.plan_candidates(df, F.col("calls") > 0, F.lit(True), quota=100).collect()}
    assert len(got) == 231 and not any(q.startswith("q09") for q in got)
    by_total = {f"q{i:04d}" for i in range(100)}
    by_mean = {f"q{i:04d}" for i in range(110, 210)}
    assert {q for q, r in got.items() if r.ranking == "total_exec_time_us" and q[0] == "q"} == by_total
    assert {q for q, r in got.items() if r.ranking == "mean_exec_time_us" and q[0] == "q"} == by_mean
    assert all(got[f"q{i:04d}"].ranking is None for i in range(100, 110))
    assert all((got[f"r{i:04d}"].attempt, got[f"r{i:04d}"].ranking) == (f"q{i:04d}", got[f"q{i:04d}"].ranking) for i in range(0, 210, 10))


def test_failed_attempts_do_not_use_up_the_quota(spark):
    df = spark.createDataFrame([statement(i, 100.0 - i, 1.0) for i in range(9)], SCHEMA)
    got = ranking.plan_candidates(df, F.lit(True), F.right("queryid", F.lit(1)).cast("int") % 2 == 1, quota=2).collect()
    assert sorted(r.queryid for r in got if r.ranking == "total_exec_time_us") == ["q0000", "q0001", "q0002", "q0003"]
    assert {r.queryid: r.planned for r in got if r.ranking == "total_exec_time_us"} == {"q0000": False, "q0001": True, "q0002": False, "q0003": True}


def test_same_text_in_another_database_is_another_plan(spark):
    df = spark.createDataFrame([statement(1, 3.0, 1.0, "select x", "a", native=5), statement(2, 2.0, 1.0, "select x", "b", native=5),
                                statement(3, 1.0, 1.0, "select x", "a", native=5)], SCHEMA)
    got = {r.queryid: r.attempt for r in ranking.plan_candidates(df, F.lit(True), F.lit(True)).collect()}
    assert got == {"q0001": "q0001", "q0002": "q0002", "q0003": "q0001"}


def walk(rows, quota):
    """Both passes step by step: (id, database, one, two, ok, fails, reason) per candidate."""
    dead, seen = {}, {}
    for ranking_name, field in (("total_exec_time_us", 2), ("mean_exec_time_us", 3)):
        done = 0
        for row in sorted((r for r in rows if r[0] not in seen), key=lambda r: (-r[field], r[0])):
            if done >= quota:
                break
            if row[1] in dead:
                seen[row[0]] = (ranking_name, "skipped", dead[row[1]])
            elif row[5]:
                dead[row[1]] = "connection_failed: " + (row[6] or "connection failed")
                seen[row[0]] = (ranking_name, "connection-failed", dead[row[1]])
            else:
                done += row[4]
                seen[row[0]] = (ranking_name, "planned" if row[4] else "no-plan", None)
    return {r[0]: seen.get(r[0], (None, None, None)) for r in rows}


def test_failed_databases_within_both_quotas(spark):
    generator = random.Random(11)
    rows, want = [], {}
    for server in range(12):
        fails = generator.choice((0, 0.02, 0.2))
        mine = [(f"q{i:03d}", f"db{generator.randrange(4)}", float(generator.randrange(40)), float(generator.randrange(40)), generator.random() < 0.5, generator.random() < fails,
                 generator.choice(("", None, "refused"))) for i in range(generator.choice((0, 5, 60)))]
        rows += [(server, *r) for r in mine]
        want |= {(server, k): v for k, v in walk(mine, 9).items()}
    df = spark.createDataFrame(rows, "server_id int, queryid string, datname string, total_exec_time_us double, mean_exec_time_us double, ok boolean, bad boolean, why string")
    got = ranking.plan_outcomes(df, F.lit(True), F.col("queryid"), F.col("datname"), F.col("ok"), F.col("bad"), F.col("why"), quota=9).collect()
    assert {(r.server_id, r.queryid): (r.ranking, r.outcome, r.explain_error) for r in got} == want
    assert {r.outcome for r in got} == {None, "planned", "no-plan", "skipped", "connection-failed"}
