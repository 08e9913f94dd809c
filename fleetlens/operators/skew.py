"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..session import pinned

SLICES = 64
"""Slices that a group's rows are cut into before they meet."""


def slice_of(columns: Sequence[str], slices: int = SLICES) -> Column:
    """A slice number from the row's own columns: the same on every retry, and filters pass below it."""
    return F.pmod(F.xxhash64(*columns), F.lit(slices)).cast("int")


def lookup(facts: DataFrame, keyed: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join facts to a table with at most one row per key.

    A plain join: Spark broadcasts the keyed side by its measured size, filters on the key reach both scans, and adaptive
    execution splits the partition of a hot key, for which ``build_session`` has the settings.
    """
    return facts.join(keyed, list(on), how)


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the fleet, on fine keys.

    Both sides are sorted by the key. Spark's estimate of a side is that of the files it is read from: it knows nothing of rows that
    an ``explode`` adds, nor of the width of texts, and would broadcast millions of rows by it. The partition of a hot key is
    split at run time.
    """
    return left.join(right.hint("merge"), list(on), how)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", spread: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows of every group with their rank, cut per slice before the groups meet in one task.

    ``spread`` names the columns that deal rows to slices, the id of a row at best; by default all others that can be hashed.
    """
    group = list(group)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    spread = list(spread) or [c for c in df.columns if c not in group and not isinstance(kinds[c], (MapType, VariantType))]
    sliced = df.withColumn("_slice", slice_of(spread or group))
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (sliced.withColumn(rank, F.row_number().over(local)).filter(F.col(rank) <= k).drop("_slice", rank)
            .withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column], amount: Column, out: str) -> DataFrame:
    """The sum of ``amount`` over the rows of the group up to each row, in ``order``, which must tell all rows apart.

    Rows are dealt by ranges of group and order, so a large group lies in many partitions, whatever the types of the order;
    each partition is summed on its own and shifted by the sums of those before it. The ranges are written once, since both
    must see the same ones. Pass narrow rows and join the rest by key.
    """
    group = list(group)
    ranged = pinned(df.withColumn("_amount", amount).repartitionByRange(*[F.col(g) for g in group], *order)
                    .withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per group and partition.
    sums = ranged.groupBy(*group, "_part").agg(F.sum("_amount").alias("_in"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).select(
        *[F.col(c).alias(f"_of_{c}") for c in (*group, "_part")], "_before")
    same = F.lit(True)
    for c in (*group, "_part"):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return (ranged.withColumn("_inside", F.sum("_amount").over(inside)).join(offsets, same)
            .withColumn(out, (F.col("_inside") + F.col("_before")).cast("bigint"))
            .drop("_amount", "_part", "_inside", "_before", *[f"_of_{c}" for c in (*group, "_part")]))


def rank_within(df: DataFrame, group: Sequence[str], value: str, tie: str, rank: str = "rank") -> DataFrame:
    """Exact position of each row in its group by ``value`` descending, then by ``tie`` in the order of its type."""
    return running_total(df, group, [F.col(value).desc(), F.col(tie).asc()], F.lit(1), rank)


def carry_last(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str, include_current: bool = True) -> DataFrame:
    """The latest non-null ``value`` of the group at or before each row (before it, without ``include_current``), in ``order``.

    "The last of two" is associative, so rows are dealt by ranges of group and order as in ``running_total``: each partition is
    walked on its own and gets the last value of those before it. A hot group spreads over as many partitions as its rows
    need. Equal places in ``order`` lie in one partition.
    """
    group = list(group)
    ranged = pinned(df.withColumn("_value", value).repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    across = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per group and partition.
    ends = ranged.groupBy(*group, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"))
    carried = ends.select(*[F.col(c).alias(f"_of_{c}") for c in (*group, "_part")], F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    same = F.lit(True)
    for c in (*group, "_part"):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return (ranged.withColumn("_local", F.last("_value", ignorenulls=True).over(inside)).join(carried, same)
            .withColumn(out, F.coalesce("_local", "_carried"))
            .drop("_value", "_part", "_local", "_carried", *[f"_of_{c}" for c in (*group, "_part")]))
