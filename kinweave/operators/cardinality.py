"""How many targets a reference record has: a prior over counts, learned from the scores' own distribution, and the choice under it."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.decision import poisson_binomial
from kinweave.operators.pairs import many_to_one, source

#: Candidates of a record that are considered, and classes of counts: 0 to MOST.
MOST = 12


def assigned(scores: DataFrame, types: DataFrame, score: str = "p") -> DataFrame:
    """Each target's best claimant alone, with types (s1_id, tgt_id, ar, nr), a record's first MOST by score; rk counts from 1. Ties by tgt_id."""
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(score), "tgt_id"))
    one = many_to_one(scores, score).join(types.select("s1_id", "tgt_id", "ar", "nr"), ["s1_id", "tgt_id"], "left")
    return one.withColumn("rk", rank).where(F.col("rk") <= MOST)


def counts(ps: Column) -> Column:
    """Chances of 0 to MOST true labels among scores in falling order, padded with zeros."""
    d = poisson_binomial(F.slice(ps, 1, MOST))
    return F.transform(F.sequence(F.lit(0), F.lit(MOST)), lambda k: F.coalesce(F.get(d, k), F.lit(0.0)))


#: What a record's candidates and the record itself say of its count.
PROFILE = ("n", "psum", "n05", "n09", "n02", "n_noaddr", "p_noaddr", "n_exact", "p_exact", "n_s2", "name_len", "name_tok", "is_us", "addr_empty")


def design(a: DataFrame, s1: DataFrame, score: str = "p") -> DataFrame:
    """s1_id, ps (scores in falling order), pb (``counts``, of sum 1), PROFILE and, with labels, k_true of each record of ``a`` (as ``assigned`` has it).

    s1: s1_id, country, name, addr_empty. A name's words are what spaces part, empty ones too.
    """
    p = F.col(score)
    of = lambda where, value=F.lit(1): F.sum(F.when(where, value).otherwise(0))
    noaddr, exact = F.col("ar") == "noaddr", F.col("nr") == "exact"
    label = [F.sum("label").alias("k_true")] if "label" in a.columns else []
    g = a.groupBy("s1_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", p.alias("p")))), lambda c: c["p"]).alias("ps"), F.count("*").alias("n"), F.round(F.sum(p), 6).alias("psum"),
        of(p > 0.5).alias("n05"), of(p > 0.9).alias("n09"), of(p > 0.2).alias("n02"), of(noaddr).alias("n_noaddr"), F.round(of(noaddr, p), 6).alias("p_noaddr"),
        of(exact).alias("n_exact"), F.round(of(exact, p), 6).alias("p_exact"), of(source() == 2).alias("n_s2"), *label,
    )
    g = g.join(s1.select("s1_id", "country", F.length("name").alias("name_len"), F.size(F.split("name", " ")).alias("name_tok"), (F.col("country") == "US").cast("int").alias("is_us"), F.col("addr_empty").cast("int").alias("addr_empty")), "s1_id", "left")
    total = lambda d: F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
    return g.withColumn("pb", F.transform(F.array(counts(F.col("ps"))), lambda d: F.transform(d, lambda x: x / total(d)))[0])


def choose(ps: Column, prior: Column, beta2: float = 0.25) -> Column:
    """How many scores, in falling order, to accept for the greatest expected F under a prior over counts; the least such number.

    The prior is cut at the number of scores and made to sum to 1; of a count, true labels fall on the first k as the scores say. A
    prior without mass accepts nothing. With the scores' own distribution this is ``decision.best_k``.
    """
    sum_ = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def value(q: Column, n: Column, k: Column) -> Column:
        top, rest = poisson_binomial(F.slice(ps, 1, k)), poisson_binomial(F.slice(ps, k + 1, F.size(ps)))

        def of_count(c: Column) -> Column:
            weights = F.transform(top, lambda t, a: t * F.coalesce(F.when(c >= a, F.get(rest, c - a)), F.lit(0.0)))
            gain = F.transform(weights, lambda w, a: w * (1 + beta2) * a / (beta2 * c + k))
            return F.when(sum_(weights) > 0, F.get(q, c) * sum_(gain) / sum_(weights)).otherwise(0.0)

        return F.when(k == 0, F.get(q, F.lit(0))).otherwise(sum_(F.transform(F.sequence(F.lit(1), n), of_count)))

    n = F.least(F.size(ps), F.lit(MOST))
    cut = F.slice(prior, 1, n + 1)
    best = lambda q: F.transform(F.array(F.transform(F.sequence(F.lit(0), n), lambda k: F.round(value(q, n, k), 12))), lambda v: F.array_position(v, F.array_max(v)) - 1)[0]
    scaled = F.transform(F.array(cut), lambda q: F.transform(q, lambda x: x / sum_(q)))
    return F.when((sum_(cut) > 0) & (n > 0), F.transform(scaled, best)[0]).otherwise(0).cast("int")


def prior_select(a: DataFrame, priors: DataFrame) -> DataFrame:
    """s1_id, tgt_id of ``a`` that are accepted under each record's prior (s1_id, ps, prior)."""
    k = priors.select("s1_id", choose(F.col("ps"), F.col("prior")).alias("k"))
    return a.join(k, "s1_id").where(F.col("rk") <= F.col("k")).select("s1_id", "tgt_id")


def _inputs(d: DataFrame) -> DataFrame:
    profile = [F.coalesce(F.get("ps", F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(MOST)]
    logs = [F.ln(F.greatest(F.get("pb", F.lit(i)), F.lit(1e-6))).alias(f"l{i}") for i in range(MOST + 1)]
    x = d.select("*", *profile, *logs, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f_{c}") for c in PROFILE])
    columns = [f"p{i}" for i in range(MOST)] + [f"l{i}" for i in range(MOST + 1)] + [f"f_{c}" for c in PROFILE]
    return VectorAssembler(inputCols=columns, outputCol="x").transform(x)


def fit(d: DataFrame, iterations: int = 50) -> LogisticRegressionModel:
    """A multinomial model of k_true on the profile and on the logarithms of the scores' own distribution."""
    y = _inputs(d).select("x", F.least("k_true", F.lit(MOST)).cast("double").alias("y"))
    return LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", maxIter=iterations, regParam=0.01).fit(y)


def select_iterations(d: DataFrame, choices=(10, 20, 50)) -> int:
    """The mean, over two halves of the records, of the choice with the least log loss on a twentieth of the half that its model hasn't learned from.
    The least choice where a half has none held out."""
    half = F.pmod(F.xxhash64("s1_id", F.lit(3)), F.lit(2))
    kept = F.pmod(F.xxhash64("s1_id", F.lit(4)), F.lit(20)) == 0
    truth = F.greatest(F.coalesce(F.get(vector_to_array("probability"), F.least("k_true", F.lit(MOST)).cast("int")), F.lit(0.0)), F.lit(1e-12))
    best = []
    for k in (0, 1):
        part = d.where(half == k)
        losses = [fit(part.where(~kept), n).transform(_inputs(part.where(kept))).agg(F.avg(-F.ln(truth))).first()[0] for n in choices]
        best.append(choices[min(range(len(choices)), key=lambda i: losses[i] if losses[i] is not None else 0.0)])
    return round(sum(best) / 2)


def learned_priors(d: DataFrame, model: LogisticRegressionModel, seen: list[str]) -> DataFrame:
    """s1_id, ps, prior: the model's for records of countries that it has seen, the scores' own distribution for others."""
    m = model.transform(_inputs(d)).withColumn("m", vector_to_array("probability"))
    own = F.transform(F.sequence(F.lit(0), F.lit(MOST)), lambda k: F.coalesce(F.get("m", k), F.lit(0.0)))
    return m.select("s1_id", "ps", F.when(F.col("country").isin(*seen), own).otherwise(F.col("pb")).alias("prior"))
