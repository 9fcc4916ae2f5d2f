"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import written

#: Weights of the sources in code-point order (null last), repeating; share of all words that the mix takes.
WEIGHTS, SHARE = (3, 1, 2), 1.5
#: A source gives at most so many passes over its documents.
PASSES = 2
#: Documents of one source that are summed in one task, and bins of the virtual time.
BUCKET_ROWS, BINS = 20_000, 65_536
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size in words (null text: 0), the shuffle key of each document, and the columns of ``keep``."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")
    return docs.select("doc_id", "source", size, F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("shuffle"), *keep)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, source_size, target of each source.

    sizes: one row a source. Each gets ``weight / all weights`` of ``share`` of all words, at most PASSES times its
    size; what is over goes to the rest by weight. That is a water level: with the sources in order of cap / weight,
    the level is the largest of (budget - caps below) / (weights from here).
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.cast("double").alias("w"), (F.col("source_size") * PASSES).cast("double").alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.select("*", ((F.sum("source_size").over(everything) * F.lit(share) - below) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("level"))
    return s.select("source", "source_size", F.least("cap", F.max("level").over(everything) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, times (passes that take it) of every document; ``keep`` names further columns.

    Documents of a source are shuffled by a seeded hash and pass up to PASSES times; one's virtual finish time is the
    source's words up to and with it, over the source's target. The mix is the stream of all sources by that time, cut
    where the next document would pass the total budget; ``taken`` is the words of a document in it, 0 to PASSES times
    its size. Null texts have size 0 and take 0; null sources are one source, the last; a null doc_id has a place in the
    shuffle like any other; repeated rows each count. An empty table gives an empty result. Reruns agree.

    Prefix sums run in two levels: a source's documents fall in hash buckets of about BUCKET_ROWS, the sums of buckets
    are added up, and only inside a bucket are rows sorted; so is the virtual time, in BINS a unit. No task holds a source.
    """
    d = written(sized(docs, seed, keep), "sized")
    n, total = d.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = max(0, math.ceil(math.log(max(1, n / BUCKET_ROWS), 16)))
    d = d.withColumn("bucket", F.substring("shuffle", 1, digits)) if digits else d.withColumn("bucket", F.lit(""))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    t = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    t = sums.join(t, sums["source"].eqNullSafe(t["source"])).select(sums["source"].alias("_s"), F.col("bucket").alias("_b"), "before", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.sum("size").over(inside))
    d = d.join(t, d["source"].eqNullSafe(t["_s"]) & (d["bucket"] == t["_b"])).withColumn("_cum", F.col("before") + F.col("_in"))
    finish = lambda p: F.when(F.col("target") > 0, (F.col("_cum") + p * F.col("source_size")) / F.col("target"))
    d = d.select("doc_id", "source", "shuffle", "size", "source_size", "target", *keep, *[finish(p).alias(f"_v{p}") for p in range(PASSES)])
    budget = math.floor(total * share)
    bin_of = lambda v: F.least(F.floor(v * BINS), F.lit(4 * BINS)).cast("long")
    both = F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"_v{p}").alias("v")) for p in range(PASSES)])).alias("e")
    binned = d.select("size", both).where("e.v is not null").groupBy(bin_of(F.col("e.v")).alias("bin")).agg(F.sum("size").alias("sum"))
    upto = binned.select("bin", F.sum("sum").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "sum")
    cut = upto.where(F.col("upto") > budget).orderBy("bin").limit(1).first()
    if cut is None:  # everything fits
        end = None
    else:
        left = budget - (cut["upto"] - cut["sum"])
        one = d.select("doc_id", "source", "shuffle", "size", both).where(bin_of(F.col("e.v")) == cut["bin"])
        order = Window.orderBy("e.v", F.col("source").isNull(), "source", "shuffle", "doc_id", "size", "e.pass").rowsBetween(Window.unboundedPreceding, 0)
        end = one.select("e.v", F.col("e.pass").alias("pass"), F.col("source").isNull().alias("no_source"), "source", "shuffle", F.sum("size").over(order).alias("upto")).where(F.col("upto") <= left).orderBy(F.desc("upto"), F.desc("v"), F.desc("no_source"), F.desc("source"), F.desc("shuffle"), F.desc("pass")).first()
    times = F.lit(0).cast("long")
    for p in range(PASSES):
        v = F.col(f"_v{p}")
        if cut is None:
            inside = v.isNotNull()
        else:
            inside = bin_of(v) < cut["bin"]
            if end is not None:
                place = F.struct(v, F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("shuffle"), F.lit(p))
                last = F.struct(F.lit(end["v"]), F.lit(end["no_source"]), F.lit(end["source"] or ""), F.lit(end["shuffle"]), F.lit(end["pass"]))
                inside = inside | ((bin_of(v) == cut["bin"]) & (place <= last))
        times = times + F.coalesce(inside, F.lit(False)).cast("long")
    return d.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), *keep)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42-' || coalesce(doc_id::VARCHAR, 'null')) AS shuffle FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[3, 1, 2])[((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
s1 AS (SELECT *, (source_size * 2)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s1),
t AS (SELECT source, source_size, least(cap, max(lev) OVER () * w) AS target FROM s2),
c AS (SELECT d.*, t.source_size, t.target, (sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, p, CASE WHEN target > 0 THEN (cum + p * source_size)::DOUBLE / target END AS v FROM c, (VALUES (0), (1)) x(p)),
r AS (SELECT *, (sum(size) OVER (ORDER BY v, source IS NULL, source, shuffle, doc_id, size, p ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM e WHERE v IS NOT NULL)
SELECT c.doc_id, any_value(c.size) AS size, any_value(c.source_size)::BIGINT AS source_size, any_value(c.target) AS target,
 coalesce(sum(r.size) FILTER (WHERE r.upto <= (SELECT floor(sum(size) * 1.5::DOUBLE) FROM d)), 0)::BIGINT AS taken
FROM c LEFT JOIN r ON c.doc_id = r.doc_id GROUP BY c.doc_id
"""
