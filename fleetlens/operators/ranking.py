"""Ranking, quotas and stop rules over statements, batches and tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalize_query_id
from ..session import pinned, stored
from .rollups import snapshot_keys, statement_rollup_full, with_texts
from .skew import lookup, meet, rank_within, top_k

# Successful plans per ranking, and parameters per batch.
PLAN_QUOTA = 100
BATCH_SIZE = 20


def rank_statements(statements: DataFrame, field: str, keys: Sequence[str] = ("server_id",), tie: str = "queryid") -> DataFrame:
    """Place of each statement in its server by ``field``, largest first."""
    return rank_within(statements, keys, field, tie)


def top_k_statements(statements: DataFrame, field: str, k: int = PLAN_QUOTA, keys: Sequence[str] = ("server_id",),
                     tie: str = "queryid") -> DataFrame:
    """The first ``k`` statements of each server."""
    return top_k(statements, keys, [F.col(field).desc(), F.col(tie).asc()], k, spread=[tie])


def top_k_with_texts(stats: DataFrame, databases: DataFrame, field: str, k: int = PLAN_QUOTA, **options) -> DataFrame:
    """T3 from the raw statistics: numbers are rolled up and ranked without texts, which are read for the winners alone.

    ``options`` are those of the rollup.
    """
    rolled = statement_rollup_full(stats, databases, with_text=False, **options)
    keys = snapshot_keys(stats, options.get("keys"))
    # The winners are written once: their number is bounded by ``k`` per server, and both joins read them.
    winners = pinned(top_k_statements(rolled, field, k, keys))
    return with_texts(winners, stats, options.get("has_toplevel", True), keys)


def plan_quota(candidates: DataFrame, field: str, success: Column, quota: int = PLAN_QUOTA,
               keys: Sequence[str] = ("server_id",), tie: str = "queryid") -> DataFrame:
    """The candidates attempted before ``quota`` successes, in rank order.

    A candidate is attempted exactly when it does not rank behind the last success that fits the quota. That
    success is found by a top-k over successes only, so no running sum walks a whole server. These places, at most one per
    group, are written, so that Spark knows how few they are before it decides whether the candidates have to move.
    """
    order = [F.col(field).desc(), F.col(tie).asc()]
    last = stored(top_k(candidates.filter(success).select(*keys, field, tie), keys, order, quota, "_rank", [tie])
            .filter(F.col("_rank") == quota)
            .select(*keys, F.col(field).alias("_field"), F.col(tie).alias("_tie")))
    within = (F.col("_field").isNull() | (F.col(field) > F.col("_field"))
              | ((F.col(field) == F.col("_field")) & (F.col(tie) <= F.col("_tie"))))
    return lookup(candidates, last, keys).filter(within).drop("_field", "_tie")


def two_rankings(candidates: DataFrame, first: str, second: str, success: Column, quota: int = PLAN_QUOTA,
                 keys: Sequence[str] = ("server_id",), tie: str = "queryid") -> DataFrame:
    """A quota pass by ``first``, then one by ``second`` over what the first pass did not attempt.

    The candidates are read several times, so their key, the two fields and the outcome are written once.
    """
    candidates = pinned(candidates.select(*keys, tie, first, second, success.alias("_success")))
    success = F.col("_success")
    one = plan_quota(candidates, first, success, quota, keys, tie).withColumn("ranking", F.lit(first))
    rest = candidates.join(one.select(*keys, tie), [*keys, tie], "left_anti")
    two = plan_quota(rest, second, success, quota, keys, tie).withColumn("ranking", F.lit(second))
    return one.unionByName(two).drop("_success")


def plan_key(database: Column, query_id: Column, text: Column) -> Column:
    """The parts that decide whether two statements share a plan."""
    return F.struct(database.alias("datname"), normalize_query_id(query_id).alias("native_id"), text.alias("query"))


def plan_sharing(statements: DataFrame, outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The outcome of a key copied to all of its statements, also to those never attempted."""
    return lookup(statements, outcomes, keys)


def plan_candidates(statements: DataFrame, eligible: Column, success: Column, first: str = "total_exec_time_us",
                    second: str = "mean_exec_time_us", quota: int = PLAN_QUOTA, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """F6/F7, W3 and W4 end to end: which statements get a plan, by which ranking, and through which attempt.

    Statements that are not ``eligible`` are left out before anything is counted. Those that share a plan are one candidate with
    their largest times and their smallest ``queryid``, of which ``success`` tells whether the attempt gives a plan; a quota pass
    per ranking chooses the attempts, and every sharing statement, attempted or not, gets the outcome of its key. Texts are
    compared by their SHA-256, so they stay out of rankings and joins.
    """
    keys = list(keys)
    shared = plan_key(F.col("datname"), F.col("pg_queryid"), F.sha2("query", 256))
    rows = statements.filter(eligible).select(*keys, "queryid", first, second, shared.alias("_plan"))
    groups = rows.groupBy(*keys, "_plan").agg(F.min("queryid").alias("attempt"), F.max(first).alias(first), F.max(second).alias(second))
    members = rows.select(*keys, "queryid", "_plan").join(groups.select(*keys, "_plan", "attempt"), [*keys, "_plan"]).drop("_plan")
    candidates = groups.select(*keys, F.col("attempt").alias("queryid"), first, second)
    chosen = two_rankings(candidates, first, second, success, quota, keys).select(
        *keys, F.col("queryid").alias("attempt"), "ranking", success.alias("planned"))
    return members.join(chosen, [*keys, "attempt"], "left")


def attempt_dedupe(attempts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first attempt of each key."""
    rest = [c for c in attempts.columns if c not in keys]
    first = attempts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*")


def failed_database_skip(attempts: DataFrame, rank: str, failed: Column, reason: str, keys: Sequence[str]) -> DataFrame:
    """After the first connection failure of a database every later candidate carries its reason."""
    text = F.concat(F.lit("connection_failed: "), F.coalesce(F.nullif(F.col(reason), F.lit("")), F.lit("connection failed")))
    first = attempts.filter(failed).groupBy(*keys).agg(
        F.min(rank).alias("_at"), F.min_by(text, rank).alias("_text"))
    skipped = F.col(rank) >= F.col("_at")
    return (lookup(attempts, first, keys)
            .withColumn("skipped", F.coalesce(F.col(rank) > F.col("_at"), F.lit(False)))
            .withColumn("explain_error", F.when(skipped, F.col("_text"))).drop("_at", "_text"))


def _ranks_behind(field: str, tie: str) -> Column:
    """Whether a row ranks behind ``_field`` and ``_tie`` in descending order of ``field``, where missing values come last."""
    same = F.col(field).eqNullSafe(F.col("_field")) & (F.col(tie) > F.col("_tie"))
    return F.coalesce(F.col(field) < F.col("_field"), F.col(field).isNull() & F.col("_field").isNotNull(), F.lit(False)) | same


def _failing_pass(candidates: DataFrame, field: str, quota: int, keys: list[str], tie: str) -> DataFrame:
    """The candidates that one ranking comes to, with ``outcome`` and ``explain_error``.

    A database fails at its first failing candidate in rank order, for if the pass does not come that far, it comes to
    nothing behind it either. Successes behind that place do not happen, so the rest is a plain quota.
    """
    order = [F.col(field).desc(), F.col(tie).asc()]
    text = F.concat(F.lit("connection_failed: "), F.coalesce(F.nullif("_reason", F.lit("")), F.lit("connection failed")))
    # Of a database's failing candidates the first is kept per slice before they meet.
    first = stored(top_k(candidates.filter(F.col("_fails") & F.col("_known").isNull()).select(*keys, "_database", field, tie, text.alias("_text")), [*keys, "_database"], order, 1, "_rank", [tie])
             .select(*keys, "_database", F.col(field).alias("_field"), F.col(tie).alias("_tie"), "_text"))
    marked = lookup(candidates, first, [*keys, "_database"])
    skipped = F.col("_known").isNotNull() | (F.col("_tie").isNotNull() & _ranks_behind(field, tie))
    marked = marked.withColumn("_skipped", skipped).withColumn("_error", F.coalesce("_known", F.when(F.col("_skipped") | F.col("_fails"), F.col("_text"))))
    marked = stored(marked.select(*keys, "_database", tie, field, "_success", "_fails", "_skipped", "_error"))
    met = plan_quota(marked, field, F.col("_success") & ~F.col("_fails") & ~F.col("_skipped"), quota, keys, tie)
    outcome = (F.when(F.col("_skipped"), "skipped").when(F.col("_fails"), "connection-failed").when(F.col("_success"), "planned").otherwise("no-plan"))
    return met.withColumn("outcome", outcome).withColumn("explain_error", F.col("_error"))


def plan_outcomes(statements: DataFrame, eligible: Column, shared: Column, database: Column, success: Column, fails: Column, reason: Column,
                  first: str = "total_exec_time_us", second: str = "mean_exec_time_us", quota: int = PLAN_QUOTA,
                  keys: Sequence[str] = ("server_id",), tie: str = "queryid") -> DataFrame:
    """F6/F7, W6, W3 and W4 end to end: what becomes of every eligible statement.

    Statements that are not ``eligible`` are left out first. Those with the same ``shared`` key are one candidate with their
    largest times and their smallest ``tie``; ``success``, ``fails`` (its database cannot be reached) and ``reason`` are read at
    that statement. A pass by ``first`` comes to candidates until ``quota`` plans; once a database fails, its later candidates are
    skipped with its reason and use up nothing. The pass by ``second`` goes over the rest and knows the databases that failed
    before. Every statement has the ``attempt`` of its key, the ranking that came to it, its outcome and its error; without a
    ranking the quotas were used up before.
    """
    keys = list(keys)
    # The statements, with their texts behind them, and the candidates are each made once; both are read again for the members.
    rows = stored(statements.filter(eligible).select(
        *keys, tie, first, second, shared.alias("_plan"), database.alias("_database"),
        success.alias("_success"), fails.alias("_fails"), reason.alias("_reason")))
    at = F.when(F.col(tie).isNotNull(), F.struct(tie, "_success", "_fails", "_reason"))
    groups = stored(rows.groupBy(*keys, "_plan", "_database").agg(F.max(first).alias(first), F.max(second).alias(second), F.min(at).alias("_at")))
    members = meet(rows.select(*keys, tie, "_plan", "_database"), groups.select(*keys, "_plan", "_database", F.col(f"_at.{tie}").alias("attempt")), [*keys, "_plan", "_database"])
    candidates = groups.select(*keys, "_database", "_at.*", first, second, F.lit(None).cast("string").alias("_known"))
    one = stored(_failing_pass(candidates, first, quota, keys, tie))
    failed = stored(one.filter("outcome = 'connection-failed'").select(*keys, "_database", F.col("explain_error").alias("_known")).distinct())
    rest = lookup(candidates.join(one.select(*keys, tie), [*keys, tie], "left_anti").drop("_known"), failed, [*keys, "_database"])
    two = stored(_failing_pass(rest, second, quota, keys, tie))
    result = lambda rows, ranking: rows.select(*keys, F.col(tie).alias("attempt"), F.lit(ranking).alias("ranking"), "outcome", "explain_error")
    chosen = result(one, first).unionByName(result(two, second))
    return members.drop("_plan", "_database").join(chosen, [*keys, "attempt"], "left")


def batches(planned: DataFrame, keys: Sequence[str] = ("server_id",), size: int = BATCH_SIZE) -> DataFrame:
    """Planned parameters in name order, cut into batches per scope.

    The window is bounded: a scope has at most one row per parameter the provider knows.
    """
    place = F.row_number().over(Window.partitionBy(*keys, "scope").orderBy("name"))
    return planned.withColumn("batch", (F.floor((place - 1) / size) + 1).cast("bigint"))


def batch_outcomes(batched: DataFrame, failed: Column, keys: Sequence[str] = ("server_id",)) -> DataFrame:
    """Applied, failed or not-run per parameter; a failed batch stops its scope, a failed instance the cluster.

    The window is bounded in the same way.
    """
    server = Window.partitionBy(*keys)

    def stop(scope: str) -> Column:
        return F.min(F.when(F.col("_failed") & (F.col("scope") == scope), F.col("batch"))).over(server)
    marked = batched.withColumn("_failed", failed).withColumn("_instance", stop("instance")).withColumn("_cluster", stop("cluster"))
    limit = F.when(F.col("scope") == "instance", F.col("_instance")).otherwise(F.col("_cluster"))
    blocked = (F.col("scope") == "cluster") & F.col("_instance").isNotNull()
    outcome = (F.when(blocked, "not-run").when(limit.isNull() | (F.col("batch") < limit), "applied")
               .when(F.col("batch") == limit, "failed").otherwise("not-run"))
    return marked.withColumn("outcome", outcome).drop("_failed", "_instance", "_cluster")


def first_failure_stops(steps: DataFrame, order: str, failed: Column, keys: Sequence[str]) -> DataFrame:
    """Statements of a task in order; after the first failure none is run."""
    first = steps.filter(failed).groupBy(*keys).agg(F.min(order).alias("_stop"))
    return (lookup(steps, first, keys)
            .withColumn("run", F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop"))
