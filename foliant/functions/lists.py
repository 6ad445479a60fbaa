"""List operations on array columns: removal, replacement, insertion, splits, merged counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_first(a: Column, b: Column) -> Column:
    """Multiset difference: each value of b takes its first places out of a."""
    nth = F.transform(a, lambda x, i: F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y == x)))
    paired = F.arrays_zip(a.alias("v"), nth.alias("n"))
    keep = F.filter(paired, lambda p: p["n"] > F.size(F.filter(b, lambda y: y == p["v"])))
    return F.transform(keep, lambda p: p["v"])


def partition(a: Column, test) -> Column:
    """(kept, removed) by a predicate."""
    return F.struct(F.filter(a, lambda x: ~test(x)).alias("kept"), F.filter(a, test).alias("removed"))


def replace_all(a: Column, old: Column, new: Column) -> Column:
    """Take all values of ``old`` out and put ``new`` where the last of them stood; unchanged without one."""
    places = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.array_contains(old, F.get(a, (i - 1).cast("int"))))
    at = F.array_max(places)
    head = F.filter(F.slice(a, F.lit(1), at), lambda x: ~F.array_contains(old, x))
    tail = F.filter(F.slice(a, at + 1, F.size(a) - at), lambda x: ~F.array_contains(old, x))
    return F.when((F.size(a) == 0) | at.isNull(), a).otherwise(F.concat(head, new, tail))


def insert_at(a: Column, i: int, values: Column) -> Column:
    return F.concat(F.slice(a, 1, i), values, F.slice(a, F.lit(i + 1), F.size(a)))


def without_places(a: Column, places: Sequence[int]) -> Column:
    return F.filter(a, lambda x, i: ~i.isin(*places))


def chunks(a: Column, size: int) -> Column:
    """Pieces of a fixed size; the last may be shorter."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(a, s, F.lit(size)))


def balanced_chunks(a: Column, parts: int) -> Column:
    """So many pieces whose sizes differ by one at most, longer ones first."""
    n, numbers = F.size(a), F.sequence(F.lit(0), F.lit(parts - 1))
    small, more = F.floor(n / parts).cast("int"), n % parts
    start = lambda i: i * small + F.least(i, more)
    return F.transform(numbers, lambda i: F.slice(a, start(i) + 1, start(i + 1) - start(i)))


def merge_counts(a: Column, b: Column) -> Column:
    """Two maps of counts as one of sums."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
