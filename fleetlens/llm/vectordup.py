"""Near-duplicate vectors of one label by cross-polytope hashing with multiprobe buckets and verified pairs.

Equal vectors are one class. Each class is in several cells of every table; the classes of a cell are cut into blocks of
bounded size, and each pair of blocks is compared exactly. A linked pair counts only in the first cell that both share, so
the number of links needs no table of pairs, and a pair of blocks returns no more links than hang its classes together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .components import connected_components
from .crosspolytope import matrix, scaled
from .vectors import takes_part, with_cells

COSINE = 0.93

TABLES = 6
AXES = 2
PROBES = 2
"""Tables, hashes per table and nearest axes per hash. At the threshold itself a pair shares no cell with a chance of 1.2e-4
(64 components), at a cosine of 0.96 of 2e-6."""

PAIR = ("label", "width", "table", "cell", "low", "high")
"""What tells one pair of blocks from another."""

BLOCK = 512
"""Classes of a cell that one side of a comparison holds."""


def linked(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with a cosine of at least ``least``; close calls are decided by a sum that does not depend on the block."""
    a, b = scaled(a), scaled(b)
    norms_a, norms_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    cosine = (a @ b.T) / norms_a[:, None] / norms_b[None, :]
    left, right = np.nonzero(cosine >= least - 1e-9)
    close = np.flatnonzero(cosine[left, right] < least + 1e-9)
    keep = np.ones(len(left), bool)
    x, y = left[close], right[close]
    keep[close] = (a[x] * b[y]).sum(axis=1) / (norms_a[x] * norms_b[y]) >= least
    return left[keep], right[keep]


def compared(batches: Iterator[pa.RecordBatch], least: float, per_table: int) -> Iterator[pa.RecordBatch]:
    """Links of all pairs of blocks of a task, whose rows come one pair after the other; a pair may begin in one batch and end in the next."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*rest, batch]).combine_chunks()
        if rows.num_rows:
            *whole, last = blocks(rows.to_batches()[0])
            yield from found_links(whole, least, per_table)
            rest = [last]
    yield from found_links(rest, least, per_table)


def blocks(rows: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The rows cut where any column of ``PAIR`` changes."""
    n = rows.num_rows
    change = np.zeros(n - 1, bool)
    for name in PAIR:
        column = rows.column(name)
        change |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.flatnonzero(change) + 1, [n]]).tolist()
    return [rows.slice(start, end - start) for start, end in zip(edges, edges[1:])]


def found_links(pairs: list[pa.RecordBatch], least: float, per_table: int) -> Iterator[pa.RecordBatch]:
    found = [links for links in (compare(rows, least, per_table) for rows in pairs) if links is not None]
    if found:
        yield from pa.concat_tables(found).combine_chunks().to_batches()


def compare(rows: pa.RecordBatch, least: float, per_table: int) -> pa.Table | None:
    """Counted links per class (``b`` null) and links that hang the classes together (``links`` null), of one pair of blocks."""
    width, table, cell, low, high = (rows.column(name)[0].as_py() for name in PAIR[1:])
    own, vectors = rows.column("own").to_numpy(), matrix(rows.column("embedding"), width)
    if low == high:
        left = right = np.arange(len(own))
    else:
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    x, y = linked(vectors[left], vectors[right], least)
    x, y = left[x], right[y]
    if low == high:
        x, y = x[x < y], y[x < y]
    if not len(x):
        return None
    marks, weight = rows.column("mark").to_numpy(), rows.column("copies").to_numpy()
    cells = np.asarray(rows.column("cells").flatten().to_numpy()).reshape(len(marks), -1)
    fresh = np.ones(len(x), bool)
    for at in range(table + 1):
        mine, other = cells[x, at * per_table:(at + 1) * per_table], cells[y, at * per_table:(at + 1) * per_table]
        same = mine[:, :, None] == other[:, None, :]
        if at == table:
            same &= mine[:, :, None] < cell
        fresh &= ~same.any(axis=(1, 2))
    x, y = x[fresh], y[fresh]
    counts = np.bincount(x, weight[y], len(marks)) + np.bincount(y, weight[x], len(marks))
    seen = np.flatnonzero(counts)
    parent = list(range(len(marks)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for i, j in zip(x.tolist(), y.tolist()):
        ri, rj = root(i), root(j)
        if ri != rj:
            parent[rj] = ri
            a.append(marks[i])
            b.append(marks[j])
    n = len(seen)
    return pa.table({"a": pa.array([*marks[seen].tolist(), *a], pa.int64()), "b": pa.array([None] * n + b, pa.int64()),
                     "links": pa.array([*counts[seen].astype(int).tolist(), *[None] * len(a)], pa.int64())})


def near_duplicate_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """One row per row: ``vec_id``, ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept``.

    Rows link when their labels are equal and not null and the cosine of their vectors, in doubles, is at least ``least``.
    Vectors that are null, empty, zero or hold a null or non-finite component, rows with a null label, and vectors of
    different width link with nothing. Repeated rows link with each other. A null ``vec_id`` stays null, with a null
    component and ``kept`` true, and still counts as a link of others. Other columns are not read; an empty table gives no row.
    """
    shared_dir(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint"), "embedding", "label")
    rows = rows.withColumn("mark", F.when(takes_part() & F.col("label").isNotNull(), F.xxhash64("label", "embedding")))
    classes = rows.filter("mark IS NOT NULL").groupBy("label", "mark").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("embedding").alias("embedding"))
    per_table = PROBES ** AXES
    hashed = with_cells(classes.withColumn("width", F.size("embedding")), TABLES, AXES, PROBES).checkpoint()
    placed = hashed.select("label", "width", "mark", "copies", "embedding", "cells", F.posexplode("cells").alias("at", "cell")).withColumn(
        "table", F.floor(F.col("at") / per_table).cast("int")).drop("at")
    key = ["label", "width", "table", "cell"]
    sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select(*key, F.ceil(F.col("held") / BLOCK).alias("cuts"))
    paired = placed.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("mark"), "cuts")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("low", F.least("own", "other")).withColumn(
        "high", F.greatest("own", "other")).drop("other", "cuts")
    # Most cells are small: a task walks through many of them, each bounded by two blocks.
    found = paired.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(
        lambda batches: compared(batches, least, per_table), "a bigint, b bigint, links bigint").checkpoint()
    parts = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("mark")).agg(F.sum("links").alias("links"))
    kinds = hashed.select("mark", "first_id", "copies")
    named = parts.join(kinds.withColumnRenamed("mark", "node"), "node").groupBy("component").agg(F.min("first_id").alias("least_id"))
    labels = parts.join(named, "component").select(F.col("node").alias("mark"), "least_id")
    table = kinds.join(counts, "mark", "left").join(labels, "mark", "left").select(
        "mark", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least_id", "first_id").alias("component_id"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.join(table, "mark", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
