"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import written


#: Edges that are thinned in one task.
PART = 200_000


def top(up, x: int) -> int:
    """The root of ``x`` in a forest of parents, which it flattens."""
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def thinned(edges: DataFrame) -> DataFrame:
    """A part of ``edges`` (a, b) with the same components: of each PART or so of them, what joins trees of that part."""
    e = written(edges.select("a", "b"), "edges")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        for b in batches:
            keep = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s, t = top(up, up.setdefault(x, x)), top(up, up.setdefault(y, y))
                keep.append(s != t)
                up[s] = t
            yield b.filter(pa.array(keep, pa.bool_()))
            if len(up) > 4 * PART:
                up.clear()

    return e.repartition(max(1, -(-e.count() // PART))).mapInArrow(forest, "a long, b long")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (a, b: long) but the roots themselves; the root is the least node reachable.

    Each round hangs a node's larger neighbours, then its smaller ones, on its least neighbour; rounds grow with the
    logarithm of the longest chain. Rounds are written tables, so that nothing grows on the driver or in the plan.
    Loops and repeated edges are harmless; no edges give no rows.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
