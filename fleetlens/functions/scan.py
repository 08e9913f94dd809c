"""Walking an array in order with a small state, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
"""Items whose outputs are put together before they join those of the blocks before."""


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str = "string", block: int = BLOCK) -> Column:
    """``state`` after all items, and the ``out`` that each step left in its state, in order.

    ``step`` takes a state, a struct with a field ``out`` of ``kind``, and an item to the next state. An array that grows item by
    item is copied at every one of them; here a block's outputs grow on their own, so the copies stay near the number of
    items. A step's output is taken up by the step after it, so that ``step`` stands in the expression once.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(held: Column, item: Column) -> Column:
        return F.struct(step(held["state"], item).alias("state"), F.concat(held["outs"], F.array(held["state"]["out"])).alias("outs"))

    def outer(held: Column, items: Column) -> Column:
        part = F.aggregate(items, F.struct(held["state"].alias("state"), none.alias("outs")), inner)
        return bound(part, lambda p: F.struct(p["state"].alias("state"), F.concat(held["outs"], F.array(p["outs"])).alias("outs")))

    def ended(found: Column) -> Column:
        outs = F.flatten(found["outs"])
        last = F.when(F.size(found["outs"]) > 0, F.array(found["state"]["out"])).otherwise(none)
        return F.struct(found["state"].alias("state"), F.concat(F.slice(outs, F.lit(2), F.greatest(F.size(outs), F.lit(0))), last).alias("outs"))

    def cut(all_items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_items) + (block - 1)) / block).cast("int"))
        blocks = F.transform(F.slice(numbers, F.lit(1), F.size(numbers) - 1), lambda n: F.slice(all_items, n * block + 1, F.lit(block)))
        start_at = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
        return F.aggregate(blocks, start_at, outer)
    return bound(bound(items, cut), ended)
