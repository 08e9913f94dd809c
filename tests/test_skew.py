"""The building blocks give the plain result, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators import ranking, rollups, skew


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows belong to one server, and a third have the same value."""
    generator = random.Random(7)
    data = [(1 if i % 3 else i % 7 + 2, 0 if i % 3 == 1 else generator.randrange(500), f"{generator.randrange(10**9):012d}{i:05d}", i) for i in range(6000)]
    return spark.createDataFrame(data, "server_id int, value int, tie string, id int").repartition(6)


@pytest.mark.parametrize("tie", ["tie", "id"])
def test_rank_within_equals_window(hot, tie):
    got = skew.rank_within(hot, ["server_id"], "value", tie)
    window = Window.partitionBy("server_id").orderBy(F.col("value").desc(), tie)
    both = got.select("id", "rank").join(hot.select("id", F.row_number().over(window).alias("want")), "id")
    assert both.count() == hot.count()
    assert both.filter("rank <> want").count() == 0


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_large_group_is_ranked_in_several_partitions(hot, uncoalesced):
    ranged = hot.repartitionByRange(F.col("server_id"), F.col("value").desc(), F.col("tie")).withColumn("p", F.spark_partition_id())
    assert ranged.filter("server_id = 1").select("p").distinct().count() > 1
    test_rank_within_equals_window(hot, "id")


def test_rank_within_keeps_missing_values(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (1, 7, "c")], "server_id int, value int, tie string")
    got = {r["tie"]: r["rank"] for r in skew.rank_within(df, ["server_id"], "value", "tie").collect()}
    assert got == {"c": 1, "a": 2, "b": 3}


def test_top_k_equals_window(hot):
    got = skew.top_k(hot, ["server_id"], [F.col("value").desc(), F.col("tie")], 50)
    window = Window.partitionBy("server_id").orderBy(F.col("value").desc(), "tie")
    want = hot.withColumn("rank", F.row_number().over(window)).filter("rank <= 50")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_lookup_equals_join(spark, hot, how):
    names = spark.createDataFrame([(i, f"s{i}") for i in (1, 3, 5)], "server_id int, name string")
    got = skew.lookup(hot, names, ["server_id"], how)
    want = hot.join(names, "server_id", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_slices_spread_the_hot_key(hot):
    slices = hot.filter("server_id = 1").withColumn("s", skew.slice_of(["id"])).groupBy("s").count()
    assert slices.count() > 2


@pytest.mark.parametrize("current", [True, False])
def test_carry_last_equals_window(hot, current):
    rows = hot.withColumn("good", F.when(F.col("id") % 11 == 0, F.col("id")))
    got = skew.carry_last(rows, ["server_id"], ["id"], F.col("good"), "last", current)
    window = Window.partitionBy("server_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    want = rows.select("id", F.last("good", ignorenulls=True).over(window).alias("want"))
    both = got.join(want, "id")
    assert both.count() == hot.count()
    assert both.filter("NOT (last <=> want)").count() == 0


def test_latency_share_equals_cume_dist(hot):
    got = {r[0]: r[1] for r in rollups.latency_share(hot, "value").collect()}
    window = Window.partitionBy("server_id").orderBy("value")
    want = hot.withColumn("share", F.cume_dist().over(window)).filter("share > 0.95").groupBy("server_id").agg(F.min("value"))
    assert got == {r[0]: r[1] for r in want.collect()}


@pytest.mark.parametrize("job", ["lookup", "top_k", "plan_quota", "rollup"])
def test_a_filter_on_the_server_reaches_the_scan(spark, tmp_path, hot, job):
    hot.withColumn("dbid", F.col("id") % 3).withColumn("queryid", F.col("id")).withColumn("toplevel", F.lit(True)).withColumn(
        "calls", F.lit(1)).withColumn("total_exec_time", F.col("value").cast("double")).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    names = facts.select("server_id", F.col("dbid").alias("oid"), "tie").distinct().withColumnRenamed("tie", "datname")
    made = {"lookup": lambda: skew.lookup(facts, names.groupBy("server_id").agg(F.min("datname").alias("n")), ["server_id"]),
            "top_k": lambda: skew.top_k(facts, ["server_id"], [F.col("value").desc(), F.col("tie")], 5),
            "plan_quota": lambda: ranking.plan_quota(facts, "value", F.col("id") % 2 == 0, 5, tie="tie"),
            "rollup": lambda: rollups.statement_rollup(facts, names)}[job]()
    plan = made.filter("server_id = 3")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("EqualTo(server_id,3)" in line for line in scans)
