"""Merging of key/value data: status rows, map columns and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay_rows(rows: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    """One value per key, taken from the row with the highest priority."""
    return rows.groupBy(*keys).agg(F.max_by(value, priority).alias(value))


def overlay_maps(left: Column, right: Column) -> Column:
    """Both maps in one; the right side wins."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def _sorted(values: Column) -> Column:
    keys = F.array_sort(F.map_keys(values))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(values, k)))


def _kind(text: Column) -> Column:
    return F.substring(F.ltrim(text), 1, 1)


def _merged_object(left: Column, right: Column, right_document: Column, key: str | None) -> Column:
    if key is None:
        return _sorted(overlay_maps(left, right))
    return _sorted(overlay_maps(left, F.create_map(F.lit(key), right_document)))


def merge_json(left: Column, right: Column, key: str | None = None) -> Column:
    """Merge two JSON texts; null when one of them is not JSON.

    Two objects are merged (or the right one is put under ``key``), two arrays are joined, an object is merged into
    every object of an array, any other pair becomes an array of both; an empty side gives the other.
    """
    a, b = F.try_parse_json(left), F.try_parse_json(right)
    fields = "map<string,variant>"
    left_map, right_map = F.from_json(left, fields), F.from_json(right, fields)
    left_list, right_list = F.from_json(left, "array<variant>"), F.from_json(right, "array<variant>")

    def element(item: Column) -> Column:
        whole = F.to_json(item)
        return F.when(F.startswith(whole, F.lit("{")), F.to_json(
            _merged_object(F.from_json(whole, fields), right_map, b, key))).otherwise(whole)

    elements = F.concat(F.lit("["), F.array_join(F.transform(left_list, element), ","), F.lit("]"))
    both = F.concat(F.lit("["), F.to_json(a), F.lit(","), F.to_json(b), F.lit("]"))
    lk, rk = _kind(left), _kind(right)
    return (F.when(F.coalesce(left, F.lit("")) == "", right)
            .when(F.coalesce(right, F.lit("")) == "", left)
            .when(a.isNull() | b.isNull(), None)
            .when((lk == "{") & (rk == "{"), F.to_json(_merged_object(left_map, right_map, b, key)))
            .when((lk == "[") & (rk == "["), F.to_json(F.concat(left_list, right_list)))
            .when((lk == "[") & (rk == "{"), elements)
            .otherwise(both))
