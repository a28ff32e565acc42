"""Set, array, map and string helpers with fixed null and order rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_of(array: Column) -> Column:
    """Distinct elements in order."""
    return F.array_sort(F.array_distinct(array))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_equal(a: Column, b: Column) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def chomp(text: Column) -> Column:
    return F.regexp_replace(text, r"\n$", "")


def trim_character(text: Column, character: str) -> Column:
    return F.btrim(text, F.lit(character))


def file_name(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def folder_name(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def joined_names(names: Column) -> Column:
    """Distinct names of a group, sorted, with slashes between."""
    return F.array_join(F.array_sort(F.collect_set(names)), "/")


# -- arrays; places count from 0 --


def append(array: Column, value: Column) -> Column:
    return F.array_append(array, value)


def find(array: Column, value: Column) -> Column:
    """The place of the first element that equals the value, or null."""
    at = F.array_position(array, value)
    return F.when(at > 0, (at - 1).cast("int"))


def remove(array: Column, value: Column) -> Column:
    """The array without the first element that equals the value."""
    at = F.array_position(array, value).cast("int")
    return F.when(at > 0, remove_index(array, at - 1)).otherwise(array)


def remove_index(array: Column, place: Column) -> Column:
    """The array without the element at the place; an array without that place stays as it is."""
    return F.filter(array, lambda x, k: k != place)


# -- maps --


def map_keys(entries: Column) -> Column:
    return F.array_sort(F.map_keys(entries))


def map_values(entries: Column) -> Column:
    """The values in the order of their keys."""
    return F.transform(map_keys(entries), lambda k: F.try_element_at(entries, k))


def map_contains(entries: Column, key: Column) -> Column:
    return F.map_contains_key(entries, key)


def map_insert(entries: Column, key: Column, value: Column) -> Column:
    """The map with the entry, which takes the place of one of the same key."""
    return F.map_concat(map_remove(entries, key), F.create_map(key, value))


def map_remove(entries: Column, key: Column) -> Column:
    return F.map_filter(entries, lambda k, _: k != key)


def map_filter(entries: Column, keep: Callable[[Column, Column], Column]) -> Column:
    return F.map_filter(entries, keep)
