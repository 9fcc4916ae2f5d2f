"""Learned steps on pairs: pruning, cross-fitted stages, stacking. Models are gradient-boosted trees; folds go by the reference record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.decide import logit
from kinweave.operators.pairs import fold, prune

SEED = 42
#: Stands for a missing value: trees split it off.
MISSING = -1e9


def _assembled(p: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_x").transform(p.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(f"_{c}") for c in features])).drop(*[f"_{c}" for c in features])


def train(p: DataFrame, features: Sequence[str], rounds: int = 40, depth: int = 5, rate: float = 0.1, seed: int = SEED) -> GBTClassificationModel:
    """A model of label (0 or 1) by ``features``; of every 20 reference records one is held out to stop early."""
    x = _assembled(p, features).select("s1_id", "_x", F.col("label").cast("double").alias("label")).withColumn("_valid", held_out(F.col("s1_id")))
    return GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, validationIndicatorCol="_valid", subsamplingRate=0.8).fit(x)


def held_out(s1_id: Column) -> Column:
    return F.substring(s1_id, 4, 20).cast("long") % 20 == 0


def sampled(p: DataFrame, rate: float, seed: int = 3) -> DataFrame:
    """All true pairs, and of the others a share by a hash of both ids."""
    h = F.pmod(F.xxhash64("s1_id", "tgt_id", F.lit(seed)), F.lit(10_000))
    return p.where((F.col("label") == 1) | (h < rate * 10_000))


def predict(p: DataFrame, model: GBTClassificationModel, features: Sequence[str], score: str) -> DataFrame:
    """``p`` with ``score``, the chance of label 1."""
    x = model.transform(_assembled(p, features))
    return x.withColumn(score, F.get(vector_to_array("probability"), F.lit(1))).drop("_x", "rawPrediction", "probability", "prediction")


def cross_fit(p: DataFrame, features: Sequence[str], rate: float = 1.0, **how) -> dict[str, GBTClassificationModel]:
    """A model of fold A and one of fold B, each learned on its own fold."""
    p = p.withColumn("fold", fold(F.col("s1_id")))
    return {f: train(sampled(p.where(F.col("fold") == f), rate), features, **how) for f in ("A", "B")}


def cross_predict(p: DataFrame, models: dict[str, GBTClassificationModel], features: Sequence[str], score: str, unseen: bool = False) -> DataFrame:
    """``p`` with ``score``: of fold A by B's model, of fold B by A's, of others the mean of both, so that none is scored by what learned it.
    ``unseen``: no model learned from these records, whatever their fold."""
    x = predict(predict(p, models["A"], features, "_a"), models["B"], features, "_b")
    f = F.lit("H") if unseen else fold(F.col("s1_id"))
    return x.withColumn(score, F.when(f == "A", F.col("_b")).when(f == "B", F.col("_a")).otherwise((F.col("_a") + F.col("_b")) / 2)).drop("_a", "_b")


#: What pruning looks at: the views' scores, ranks and gaps, the searches that found the pair, the sizes of both groups.
PRUNING = (
    "via", *(f"cos_{v}" for v in ("n", "a", "na")), *(f"{w}_{v}" for v in ("n", "a", "na") for w in ("rk1", "gap1", "rkt", "gapt")), "n_s1", "n_tgt",
)
FLOOR, CAP = 0.002, 12


def pruned(p: DataFrame, models: dict[str, GBTClassificationModel], floor: float = FLOOR, cap: int = CAP, unseen: bool = False) -> DataFrame:
    """Pairs with p_pre of ``floor`` or more that are among their reference record's ``cap`` best of one source."""
    x = cross_predict(p, models, PRUNING, "p_pre", unseen)
    best = F.row_number().over(Window.partitionBy("s1_id", "tgt_src").orderBy(F.desc("p_pre"), "tgt_id"))
    return x.withColumn("rk", best).where((F.col("rk") <= cap) & (F.col("p_pre") >= floor)).drop("rk") if "tgt_src" in x.columns else prune(x, "p_pre", floor, cap)


def reference_stats(train: DataFrame, test: DataFrame) -> DataFrame:
    """Word statistics (as ``pairs.token_stats`` has them) for a test set: the training set's in its countries, its own in others. A test set with
    more unmatched records would shift them under models that learned from the training set."""
    return train.unionByName(test.join(train.select("country").distinct(), "country", "left_anti"))


def auc(p: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row, auc: the chance that a true pair scores above another; ties count half. Equal scores are one row before they are ordered."""
    g = p.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("t"), F.sum((1 - F.col(label)).cast("long")).alias("f"))
    totals = g.agg(F.sum("t").alias("nt"), F.sum("f").alias("nf"))
    bucket = F.floor(F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)) * 1000)
    below = g.groupBy(bucket.alias("b")).agg(F.sum("f").alias("bf"))
    below = below.select("b", (F.sum("bf").over(Window.orderBy("b")) - F.col("bf")).alias("before"))  # 1001 rows at most
    inside = F.sum("f").over(Window.partitionBy("b").orderBy("s")) - F.col("f")
    r = g.withColumn("b", bucket).withColumn("inside", inside).join(F.broadcast(below), "b").agg(F.sum(F.col("t") * (F.col("before") + F.col("inside") + F.col("f") / 2)).alias("u"))
    return r.select(F.round(F.col("u") / (totals.select("nt").scalar() * totals.select("nf").scalar()), 6).alias("auc"))


# ---- stacking


def encoded(p: DataFrame, values: dict[str, Sequence[str]]) -> DataFrame:
    """``p`` with each column of ``values`` as the place of its value in the list; -1 if it isn't there."""
    return p.withColumns({c: F.coalesce(F.array_position(F.array(*map(F.lit, v)), F.col(c)).cast("int"), F.lit(0)) - 1 for c, v in values.items()})


def stack_rows(base: DataFrame, types: DataFrame, values: dict[str, Sequence[str]], *groups: DataFrame) -> DataFrame:
    """Pairs (s1_id, tgt_id, p) with z (log odds of p), their encoded types and the columns of ``groups``."""
    x = encoded(base.join(types, ["s1_id", "tgt_id"], "left"), values).withColumn("z", logit(F.col("p")))
    for g in groups:
        x = x.join(g, ["s1_id", "tgt_id"], "left")
    return x


def half(s1_id: Column) -> Column:
    """0 or 1: the half of the reference records that one belongs to."""
    return F.pmod(F.xxhash64(s1_id, F.lit(7)), F.lit(2)).cast("int")


def stacked_out_of_fold(p: DataFrame, features: Sequence[str], **how) -> DataFrame:
    """``p`` with p2: each half scored by the model of the other."""
    x = p.withColumn("_half", half(F.col("s1_id")))
    parts = [predict(x.where(F.col("_half") == k), train(x.where(F.col("_half") != k), features, **how), features, "p2") for k in (0, 1)]
    return parts[0].unionByName(parts[1]).drop("_half")


def stacked(base: DataFrame, rows: DataFrame, seen: Sequence[str], full, full_features, plain, plain_features) -> DataFrame:
    """s1_id, tgt_id, p2: the full model's score in countries it has seen, the plain one's in others, p where a pair has no row."""
    a = predict(rows, full, full_features, "_full").select("s1_id", "tgt_id", "country", "_full")
    b = predict(rows, plain, plain_features, "_plain").select("s1_id", "tgt_id", "_plain")
    x = base.select("s1_id", "tgt_id", "p").join(a, ["s1_id", "tgt_id"], "left").join(b, ["s1_id", "tgt_id"], "left")
    return x.select("s1_id", "tgt_id", F.coalesce(F.when(F.col("country").isin(*seen), F.col("_full")).otherwise(F.col("_plain")), F.col("p")).alias("p2"))
