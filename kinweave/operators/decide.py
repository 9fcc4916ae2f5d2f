"""Choice of matches from scored pairs, and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import decision
from kinweave.operators import pairs


def by_threshold(p: DataFrame, score: str, least: float) -> DataFrame:
    return p.where(F.col(score) >= least)


def threshold_curve(p: DataFrame, score: str, truth: DataFrame, s1: DataFrame, beta: float = 0.5) -> DataFrame:
    """tau, macro_f for thresholds 0.05, 0.06, ... 0.95 over all records of ``s1``.

    A reference record's candidates meet in one row, so the thresholds multiply records and not pairs, and their means are
    pre-aggregated. Candidates a record are bounded by the pruning before.
    """
    hit = truth.select("s1_id", "tgt_id").distinct().withColumn("_hit", F.lit(1))
    per = p.join(hit, ["s1_id", "tgt_id"], "left").groupBy("s1_id").agg(F.collect_list(F.struct(F.col(score).alias("p"), F.coalesce("_hit", F.lit(0)).alias("y"))).alias("c"))
    n = hit.groupBy("s1_id").agg(F.count("*").alias("n"))
    none = F.array().cast("array<struct<p:double,y:int>>")
    x = s1.select("s1_id").distinct().join(per, "s1_id", "left").join(n, "s1_id", "left").select(F.coalesce("c", none).alias("c"), F.coalesce("n", F.lit(0)).alias("n"))
    x = x.select("c", "n", F.explode(F.sequence(F.lit(5), F.lit(95))).alias("i")).select("n", (F.col("i") / 100).alias("tau"), "c")
    kept = F.filter("c", lambda s: s["p"] >= F.col("tau"))
    x = x.select("n", "tau", F.size(kept).alias("k"), F.size(F.filter(kept, lambda s: s["y"] == 1)).alias("tp"))
    b2 = beta * beta
    f = F.when(F.col("k") + F.col("n") == 0, 1.0).when(F.col("tp") == 0, 0.0).otherwise((1 + b2) * F.col("tp") / (b2 * F.col("n") + F.col("k")))
    return x.groupBy("tau").agg(F.round(F.avg(f), 6).alias("macro_f"))


def tune_threshold(p: DataFrame, score: str, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """One row: the best threshold of the curve, the least of equals."""
    return threshold_curve(p, score, truth, s1).orderBy(F.desc("macro_f"), "tau").limit(1)


def expected_f_select(p: DataFrame, score: str, most: int = 12) -> DataFrame:
    """Each reference record's best pairs, as many of its first ``most`` as have the greatest expected F; ties by tgt_id."""
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(score), "tgt_id"))
    top = p.select("s1_id", "tgt_id", F.col(score).alias("p"), rank.alias("rk")).where(F.col("rk") <= most)
    g = top.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("rk", "tgt_id", "p"))).alias("c"))
    k = decision.best_k(F.transform("c", lambda s: s["p"]))
    return g.withColumn("k", k.cast("int")).where("k > 0").select("s1_id", F.explode(F.slice("c", 1, F.col("k"))).alias("s")).select("s1_id", "s.tgt_id", "s.p")


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def logit_context(p: DataFrame, z: str, alone: float = 10.0) -> DataFrame:
    """s1_id, tgt_id, rank in the reference record and distance from the best other one; ``alone`` where there is none."""
    s = Window.partitionBy("s1_id")
    p = p.select("s1_id", "tgt_id", F.col(z).alias("z"), F.row_number().over(s.orderBy(F.desc(z), "tgt_id")).cast("long").alias("rk"))
    other = F.when(F.col("rk") == 1, F.max(F.when(F.col("rk") == 2, F.col("z"))).over(s)).otherwise(F.max("z").over(s))
    return p.select("s1_id", "tgt_id", "rk", F.coalesce(F.round(F.col("z") - other, 6), F.lit(alone)).alias("margin"))


def ceiling(candidates: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """country, n_true, n_found, recall: of the true pairs of the records of ``s1`` (s1_id, country), those that are candidates."""
    t = truth.select("s1_id", "tgt_id").distinct().join(s1.select("s1_id", "country"), "s1_id")
    c = candidates.select("s1_id", "tgt_id").distinct().withColumn("_c", F.lit(1))
    g = t.join(c, ["s1_id", "tgt_id"], "left").groupBy("country").agg(F.count("*").alias("n_true"), F.count("_c").alias("n_found"))
    return g.withColumn("recall", F.round(F.col("n_found") / F.col("n_true"), 6))


def country_report(p: DataFrame, score: str, least: float, s1: DataFrame) -> DataFrame:
    """country, n, matched, mean_matches, median_best, without: shares of the records of ``s1`` with a match and without candidates."""
    g = p.groupBy("s1_id").agg(F.count_if(F.col(score) >= least).alias("k"), F.max(score).alias("best"))
    x = s1.select("s1_id", "country").join(g, "s1_id", "left")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    k = F.coalesce("k", F.lit(0))
    return x.groupBy("country").agg(F.count("*").alias("n"), share(k > 0).alias("matched"), share(k).alias("mean_matches"), F.round(F.percentile("best", 0.5), 6).alias("median_best"), share(F.col("best").isNull()).alias("without"))


def decide(p: DataFrame, score: str, how: dict) -> DataFrame:
    """Accepted pairs: each target's best claimant alone if ``many_to_one``, then the threshold ``tau`` or the greatest expected F."""
    if how.get("many_to_one"):
        p = pairs.many_to_one(p, score)
    if how["type"] == "threshold":
        return by_threshold(p, score, how["tau"]).select("s1_id", "tgt_id")
    return expected_f_select(p, score, how.get("most", 12)).select("s1_id", "tgt_id")


def perfect_matcher(candidates: DataFrame, truth: DataFrame, s1: DataFrame, beta: float = 0.5) -> DataFrame:
    """per_entity of a matcher that accepts exactly the true candidates: the ceiling of F."""
    return pairs.per_entity(candidates.select("s1_id", "tgt_id").join(truth, ["s1_id", "tgt_id"], "left_semi"), truth, s1, beta)


def error_report(accepted: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """country, n_true (6 stands for more), n, macro_f, false_positives, false_negatives of the records of ``s1`` (s1_id, country)."""
    per = pairs.per_entity(accepted, truth, s1).join(s1.select("s1_id", "country").distinct(), "s1_id")
    g = per.groupBy("country", F.least("n_true", F.lit(6)).alias("n_true"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("macro_f"), F.sum(F.col("n_pred") - F.col("tp")).alias("false_positives"), F.sum(F.col("n_true") - F.col("tp")).alias("false_negatives"))


def stressed(p: DataFrame, share: float = 0.2) -> DataFrame:
    """Scored pairs without those of a sample of reference records: their targets become orphans."""
    return p.where(~pairs.orphan(F.col("s1_id"), share))


def mean_scores(a: DataFrame, b: DataFrame, score: str) -> DataFrame:
    """s1_id, tgt_id and the mean of two tables' scores, of pairs that both have."""
    return a.select("s1_id", "tgt_id", F.col(score).alias("_a")).join(b.select("s1_id", "tgt_id", F.col(score).alias("_b")), ["s1_id", "tgt_id"]).select("s1_id", "tgt_id", ((F.col("_a") + F.col("_b")) / 2).alias(score))
