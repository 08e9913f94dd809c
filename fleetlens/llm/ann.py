"""Nearest neighbours by inner product through multiprobe cross-polytope tables with exact reranking.

Every vector is in one cell of each table, that of its nearest signed axis; a query looks into the cells of its ``probes``
nearest axes. Cells are cut into slices of bounded size on both sides, and each pair of slices keeps only the best ``k`` of
every query, so what is shuffled grows with the queries and not with the pairs looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .crosspolytope import matrix
from .vectors import takes_part, with_cells

TABLES = 2

PROBES = 60
"""Cells that a query looks into per table. Vectors without any structure, as in the test tables, need nearly half of the 128
cells for a recall well over 0.9; near neighbours proper need a few."""

SLICE = 4096
"""Vectors, or queries, of a cell that one task compares."""

QUERY_ROWS = 256


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, the same whatever rows stand beside them; sums that overflow to both sides rank last."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((a * b).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def best(queries: pa.Table, base: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest vectors of a slice for each query of a slice, ties to the smaller id."""
    out: list[tuple] = []
    if queries.num_rows and base.num_rows:
        width = int(queries.column("width")[0].as_py())
        ids, vectors = base.column("vec_id").to_numpy(), matrix(base.column("embedding").combine_chunks(), width)
        asked, points = queries.column("vec_id").to_numpy(), matrix(queries.column("embedding").combine_chunks(), width)
        with np.errstate(over="ignore"):
            longest = np.sqrt((vectors * vectors).sum(axis=1)).max()
        for at in range(0, len(asked), QUERY_ROWS):
            part, mine = asked[at:at + QUERY_ROWS], points[at:at + QUERY_ROWS]
            other = part[:, None] != ids[None, :]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.where(other, mine @ vectors.T, -np.inf)
                # How far a product may be off, by the lengths; where that is no number, all products are taken again.
                slack = 1e-15 * width * np.sqrt((mine * mine).sum(axis=1)) * longest
                sure = np.isfinite(slack) & np.isfinite(np.where(other, scores, 0)).all(axis=1)
                if len(ids) > k:
                    least = np.where(sure, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] - slack, -np.inf)
                else:
                    least = np.full(len(part), -np.inf)
            for row in range(len(part)):
                near = np.flatnonzero(other[row] & ((scores[row] >= least[row]) | ~sure[row]))
                true = exact(vectors[near], points[at + row][None, :])
                for place in np.lexsort((ids[near], -true))[:k]:
                    out.append((part[row], ids[near[place]], true[place]))
    asked_ids, found_ids, found_scores = zip(*out) if out else ((), (), ())
    return pa.table({"query_id": pa.array(asked_ids, pa.int64()), "vec_id": pa.array(found_ids, pa.int64()),
                     "score": pa.array(found_scores, pa.float64())})


def looked_up(base: DataFrame, queries: DataFrame, k: int, tables: int, probes: int) -> DataFrame:
    """The best ``k`` rows that each pair of slices found; a vector may be found in several tables."""

    def dealt(df: DataFrame, probes: int) -> DataFrame:
        rows = with_cells(df.withColumn("width", F.size("embedding")), tables, 1, probes)
        per_table = F.least(F.lit(probes), F.size("cells") / tables).cast("int")
        return rows.withColumn("per_table", per_table).select(
            "vec_id", "embedding", "width", "per_table", F.posexplode("cells").alias("at", "cell")).select(
            "vec_id", "embedding", "width", F.floor(F.col("at") / F.col("per_table")).cast("int").alias("table"), "cell")

    held, asked = dealt(base, 1), dealt(queries, probes)
    key = ["width", "table", "cell"]
    # One row per cell: bounded by tables and axes.
    cuts = held.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("cuts")).join(
        asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("query_cuts")), key)
    mine = F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int")
    query_mine = F.pmod(F.xxhash64("vec_id"), F.col("query_cuts")).cast("int")
    held = held.join(cuts, key).withColumn("slice", mine).withColumn(
        "query_slice", F.explode(F.sequence(F.lit(0), F.col("query_cuts") - 1))).drop("cuts", "query_cuts")
    asked = asked.join(cuts, key).withColumn("query_slice", query_mine).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts", "query_cuts")
    key += ["slice", "query_slice"]
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(
        lambda left, right: best(left, right, k), "query_id bigint, vec_id bigint, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query; a query has at most ``k`` rows from each pair of slices here."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(base: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` (inner product in doubles) of the ``k`` nearest vectors found.

    Both sides have ``vec_id`` and ``embedding``; other columns are not read. Rows with a null id, and vectors that are null,
    empty, zero or hold a null or non-finite component, take no part; vectors of another width are no candidates; of rows that
    repeat an id the smallest vector counts, once. Products too large for a double are infinite. A query does not find its own id. Ties go to the smaller id. A query that found fewer than ``k``
    looks into all cells, so it gets all candidates if there are fewer than ``k``. Empty tables give no row.
    """
    shared_dir(base.sparkSession)
    base, queries = (x.select(F.col("vec_id").cast("bigint"), "embedding").filter(F.col("vec_id").isNotNull() & takes_part())
                     .groupBy("vec_id").agg(F.min("embedding").alias("embedding")) for x in (base, queries))
    first = ranked(looked_up(base, queries, k, tables, probes), k).checkpoint()
    enough = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = queries.join(enough, "vec_id", "left_anti").checkpoint()
    if short.isEmpty():
        return first
    all_cells = 2 << 20
    rest = ranked(looked_up(base, short, k, 1, all_cells), k)
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
