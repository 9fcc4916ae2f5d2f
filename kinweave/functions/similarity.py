"""Similarities of two strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, a row of the table at a time."""
    n, m = F.length(a), F.length(b)

    def cell(i: Column, above: Column):
        up = lambda j: F.when(j == 0, 0).otherwise(F.get(above, j - 1))
        left = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
        same = lambda j: F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1))
        return lambda acc, j: F.concat(acc, F.array(F.when(same(j), up(j - 1) + 1).otherwise(F.greatest(up(j), left(acc)))))

    empty = F.array().cast("array<int>")
    table = F.aggregate(F.sequence(F.lit(1), n), F.array_repeat(F.lit(0), m), lambda above, i: F.aggregate(F.sequence(F.lit(1), m), empty, cell(i, above)))
    return F.when((n == 0) | (m == 0), 0).otherwise(F.element_at(table, -1))


def ratio(a: Column, b: Column) -> Column:
    """2 LCS / (length a + length b); two empty strings are alike."""
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * lcs(a, b) / (F.length(a) + F.length(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(text, " "), ""))
