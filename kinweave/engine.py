"""The whole linkage as steps, each of which reads tables that earlier ones wrote and writes its own: records of a training and a test set to match lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.operators import cardinality, decide, features, learn, pairs, rawform, retrieval, rules, spelling
from kinweave.sources import entities as src
from kinweave.sources import work

KEYS = ["s1_id", "tgt_id"]
TRAIN, TEST = "train", "test"
SOURCES = (1, 2, 3)


@dataclass(frozen=True)
class Settings:
    """Where records are, where tables and results go (folders that all executors share), and what the steps do.

    ``data`` has train/train_source1.tsv to 3, train/train_ground_truth.tsv and test/test_source1.tsv to 3. ``rule`` is threshold (tuned on
    fold H) or expected_f; ``generator`` applies the word rules, ``gate`` (full, narrow or open) the number gate; ``prior`` decides by learned counts.
    """

    data: str
    work: str
    output: str
    blocking: retrieval.Blocking = field(default_factory=retrieval.Blocking)
    rounds: int = 40
    depth: int = 5
    negatives: float = 1.0
    rule: str = "expected_f"
    generator: bool = True
    gate: str = "full"
    prior: bool = False
    min_share: float = 0.001
    max_f: float = 0.3

    def at(self, *parts: str) -> str:
        return "/".join((self.work.rstrip("/"), *parts))


def _kept(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def records(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    """entity_id, name, address, country, k of the three sources of a split."""
    return reduce(DataFrame.unionByName, [src.read_source(spark, f"{s.data}/{split}/{split}_source{k}.tsv").withColumn("k", F.lit(k)) for k in SOURCES])


def truth(spark: SparkSession, s: Settings) -> DataFrame:
    return src.read_truth(spark, f"{s.data}/{TRAIN}/{TRAIN}_ground_truth.tsv")


def _sides(known: DataFrame, e: DataFrame, *columns: str) -> DataFrame:
    """Pairs with columns of both records as a_ and b_, and the reference record's country."""
    side = lambda i, m: e.select(F.col("entity_id").alias(i), *([F.col("country")] if m == "a" else []), *[F.col(c).alias(f"{m}_{c}") for c in columns])
    return known.select(*KEYS).join(side("s1_id", "a"), "s1_id").join(side("tgt_id", "b"), "tgt_id")


def learn_spellings(spark: SparkSession, s: Settings) -> None:
    """Tables of Latin spellings of Indic words and parts, from the true pairs of the training set."""
    x = _sides(truth(spark, s), records(spark, s, TRAIN), "name", "address").where(F.col("b_name").rlike(spelling.INDIC) | F.col("b_address").rlike(spelling.INDIC))
    spelling.word_spellings(x).write.mode("overwrite").parquet(s.at("spelling", "words"))
    spelling.part_spellings(x).write.mode("overwrite").parquet(s.at("spelling", "parts"))


def prepare(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    """Normal records of a split, with the raw name and address; the training set is prepared first, as spellings are learned from it."""
    if split == TRAIN:
        learn_spellings(spark, s)
    e = records(spark, s, split)
    e = spelling.with_spellings(e, spark.read.parquet(s.at("spelling", "words")), spark.read.parquet(s.at("spelling", "parts")))
    n = features.normal_records(e, spelt=spelling.spelt_part, spelt_word=spelling.spelt_word, keep=("name", "address"))
    return _kept(spark, n, s.at(split, "records"))


def normal(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    return spark.read.parquet(s.at(split, "records"))


def block(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    """Candidates of a split: country, tgt_src, s1_id, tgt_id, via and three cosines."""
    e = normal(spark, s, split)
    views = {v: _kept(spark, retrieval.unit_vectors(e, retrieval.term_counts(e, v)), s.at(split, f"vectors_{v}")) for v in ("n", "a")}
    views["na"] = retrieval.combined(views["n"], views["a"])
    return _kept(spark, retrieval.candidates(e.select("country", "k", "entity_id", F.col("core").alias("name")), views, s.blocking), s.at(split, "candidates"))


def block_report(spark: SparkSession, s: Settings) -> DataFrame:
    """Recall of the training candidates by country."""
    return decide.ceiling(spark.read.parquet(s.at(TRAIN, "candidates")), truth(spark, s), traits(spark, s, TRAIN))


def traits(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    """s1_id, country, name, addr_empty of the reference records."""
    return normal(spark, s, split).where("k = 1").select(F.col("entity_id").alias("s1_id"), "country", "name", "addr_empty")


def _learned(s: Settings, name: str, x: DataFrame, columns) -> dict[str, GBTClassificationModel]:
    models = learn.cross_fit(x, columns, s.negatives, rounds=s.rounds, depth=s.depth)
    for f, m in models.items():
        m.write().overwrite().save(s.at("models", f"{name}_{f}"))
    return models


def _loaded(s: Settings, name: str) -> dict[str, GBTClassificationModel]:
    return {f: GBTClassificationModel.load(s.at("models", f"{name}_{f}")) for f in ("A", "B")}


def prune(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    """Candidates that a learned ranking keeps; on the training set it is learned first."""
    x = pairs.rank_gaps(spark.read.parquet(s.at(split, "candidates")))
    if split == TRAIN:
        x = features.labelled(x, truth(spark, s))
        models = _learned(s, "prune", x, learn.PRUNING)
    else:
        models = _loaded(s, "prune")
    return _kept(spark, learn.pruned(x, models, unseen=split == TEST), s.at(split, "pruned"))


def word_statistics(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    """Word statistics of a split; of the test set the training set's where that has the country."""
    of = lambda e: pairs.token_stats(e.where("k = 1").select("country", F.col("core").alias("name")), e.where("k > 1").select("country", F.col("core").alias("name")), s.min_share, s.max_f)
    return of(normal(spark, s, split)) if split == TRAIN else learn.reference_stats(of(normal(spark, s, TRAIN)), of(normal(spark, s, TEST)))


def pair_table(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    """Pruned candidates with all features of a pair on its own."""
    e, p = normal(spark, s, split), spark.read.parquet(s.at(split, "pruned"))
    x = features.pair_features(features.paired(p.drop("country"), e))
    x = features.frequencies(x, e)
    x = x.join(features.idf_overlap(x, features.name_idf(e)), KEYS, "left").join(features.changed_words(x, word_statistics(spark, s, split)), KEYS)
    return _kept(spark, x, s.at(split, "pairs"))


def numeric(x: DataFrame) -> list[str]:
    """The columns that a model may see: all numbers but labels."""
    return sorted(f.name for f in x.schema if isinstance(f.dataType, T.NumericType) and f.name != "label")


def _score(spark: SparkSession, s: Settings, split: str, x: DataFrame, name: str, score: str) -> DataFrame:
    columns = [c for c in numeric(x) if c != score]
    models = _learned(s, name, x, columns) if split == TRAIN else _loaded(s, name)
    return _kept(spark, learn.cross_predict(x, models, columns, score, unseen=split == TEST), s.at(split, name))


def stage1(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    """p1 of every pair by its own features."""
    return _score(spark, s, split, spark.read.parquet(s.at(split, "pairs")), "stage1", "p1")


def stage2(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    """p2 by the context too: the pairs of the same reference record, source and target, siblings, raw names and the shape of the scores."""
    x, e = spark.read.parquet(s.at(split, "stage1")), normal(spark, s, split)
    raw = e.select("entity_id", "name")
    named = x.select(*KEYS).join(raw.toDF("s1_id", "na"), "s1_id").join(raw.toDF("tgt_id", "nb"), "tgt_id")
    context = [
        pairs.group_features(x, "p1"),
        pairs.sibling_features(x, e.where("k > 1").select("entity_id", "core", "compact", "addr", "first"), "p1"),
        pairs.score_shape(x, "p1"),
        rawform.raw_features(named),
    ]
    for c in context:
        x = x.join(c.drop(*[n for n in c.columns if n in x.columns and n not in KEYS]), KEYS, "left")
    return _score(spark, s, split, x, "stage2", "p2")


#: What the word and number rules, and the types of pairs, read.
RULED = (
    *KEYS, "country", "p", "na", "nb", "fa", "fb", "a_sim", "a_tset", "nf_eq", "num_overlap", "num_jacc", "legal_conflict", "n_ua", "n_ub",
    "addr_empty_a", "addr_empty_b", "name_exact", "acro", "n_tset", "tc_n_ua", "tc_n_ub",
)


def rule_view(x: DataFrame) -> DataFrame:
    """Scored pairs by the names that the word and number rules use."""
    v = x.withColumns({"a_sim": F.col("a_tset"), "n_ua": F.col("tc_n_ua"), "n_ub": F.col("tc_n_ub"), "p": F.col("p2")})
    return v.withColumnsRenamed({"a_core": "na", "b_core": "nb", "a_first": "fa", "b_first": "fb"})


def exclusions(v: DataFrame, learned: DataFrame, stats: DataFrame, gate: str) -> DataFrame:
    """Pairs that no score may accept: swapped category words, decoy words and vocabulary (of the labelled pairs ``learned``), gated numbers."""
    gated = rules.number_gate(v, rules.gated_countries(v))
    gated = gated if gate == "full" else rules.still_gated(gated, v, gate)
    found = [rules.category_swaps(v, stats), rules.decoy_word_pairs(v), rules.vocabulary_pairs(v, rules.decoy_vocabulary(learned)), gated]
    return reduce(DataFrame.unionByName, [p.select(*KEYS) for p in found]).distinct()


def held_out(spark: SparkSession, s: Settings) -> DataFrame:
    """Scored training pairs of fold H, from which no model learned."""
    return spark.read.parquet(s.at(TRAIN, "stage2")).where(pairs.fold(F.col("s1_id")) == "H")


def decision(spark: SparkSession, s: Settings) -> dict:
    """How pairs are accepted; a threshold is the best on fold H."""
    if s.rule != "threshold":
        return {"type": s.rule, "many_to_one": True}
    s1 = traits(spark, s, TRAIN).where(pairs.fold(F.col("s1_id")) == "H").select("s1_id", "country")
    known = truth(spark, s).join(s1, "s1_id", "left_semi")
    tau = decide.tune_threshold(pairs.many_to_one(held_out(spark, s), "p2"), "p2", known, s1).first()["tau"]
    return {"type": "threshold", "tau": float(tau), "many_to_one": True}


def _prior(spark: SparkSession, s: Settings, v: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The last decision by a prior over counts, learned on fold H, for the countries of the training set."""
    h = held_out(spark, s).withColumnRenamed("p2", "p")
    a = cardinality.assigned(h.select(*KEYS, "p", "label"), rawform.pair_types(h, "p"))
    d = _kept(spark, cardinality.design(a, traits(spark, s, TRAIN)), s.at(TRAIN, "counts"))
    model = cardinality.fit(d, cardinality.select_iterations(d))
    model.write().overwrite().save(s.at("models", "counts"))
    seen = [r[0] for r in traits(spark, s, TRAIN).select("country").distinct().collect()]  # countries
    types = rawform.pair_types(v, "p")

    def last(scores: DataFrame) -> DataFrame:
        one = _kept(spark, cardinality.assigned(scores, types), s.at(TEST, "assigned"))
        d = _kept(spark, cardinality.design(one, traits(spark, s, TEST)), s.at(TEST, "counts"))
        priors = _kept(spark, cardinality.learned_priors(d, model, seen), s.at(TEST, "priors"))
        return cardinality.prior_select(one, priors)

    return last


def matches(spark: SparkSession, s: Settings, split: str = TEST) -> DataFrame:
    """s1_id, tgt_id: what is accepted of a split, before recovery."""
    x = spark.read.parquet(s.at(split, "stage2"))
    how = decision(spark, s)
    passes = count(1)

    def choose(p: DataFrame) -> DataFrame:
        return _kept(spark, decide.decide(p, "p", how), s.at(split, f"accepted_{next(passes)}"))

    if not s.generator:
        return choose(x.select(*KEYS, F.col("p2").alias("p")))
    v = _kept(spark, rule_view(x).select(*RULED), s.at(split, "ruled"))
    learned = rule_view(spark.read.parquet(s.at(TRAIN, "stage2"))).select(*RULED, "label")
    out = _kept(spark, exclusions(v, learned, word_statistics(spark, s, split), s.gate), s.at(split, "excluded"))
    suffixes = _kept(spark, rules.noise_suffixes(v), s.at(split, "suffixes"))
    return rules.chain(
        v, v, out, rules.noise_addition_pairs(v), lambda a: rules.dual_use_pairs(v, a), lambda a: rules.abbreviation_pairs(v, a),
        lambda a: rules.suffix_swaps(v, a, suffixes), choose, _prior(spark, s, v) if s.prior and split == TEST else None,
    )


def finish(spark: SparkSession, s: Settings) -> list[str]:
    """Writes the lists of matches and candidates of the test set, recovered pairs of equal names and addresses included; says what is wrong with them."""
    e, c = normal(spark, s, TEST), spark.read.parquet(s.at(TEST, "candidates")).select(*KEYS)
    accepted = _kept(spark, matches(spark, s), s.at(TEST, "accepted"))
    sides = e.select("country", "k", "entity_id", F.col("core").alias("name"), "addr", F.col("first").alias("number"))
    more = _kept(spark, rules.recovered(rules.same_address_pairs(sides.where("k = 1"), sides.where("k > 1"), c), accepted), s.at(TEST, "recovered"))
    s1 = traits(spark, s, TEST).select("s1_id")
    found = _kept(spark, accepted.unionByName(more).distinct(), s.at(TEST, "matches"))
    work.write_outputs(s1, found, c.unionByName(more).distinct(), s.output)
    return work.validate(src.id_lists(s1, found), s1, e.where("k > 1").select(F.col("entity_id").alias("tgt_id")))


def diagnose(spark: SparkSession, s: Settings) -> DataFrame:
    """Errors on fold H by country and number of true targets."""
    s1 = traits(spark, s, TRAIN).where(pairs.fold(F.col("s1_id")) == "H").select("s1_id", "country")
    known = truth(spark, s).join(s1, "s1_id", "left_semi")
    accepted = decide.decide(held_out(spark, s).select(*KEYS, F.col("p2").alias("p")), "p", decision(spark, s))
    return decide.error_report(accepted, known, s1)


#: The steps of a split, in order.
STEPS = {"prepare": prepare, "block": block, "prune": prune, "pairs": pair_table, "stage1": stage1, "stage2": stage2}


def run(spark: SparkSession, s: Settings) -> list[str]:
    """All steps of both splits, and the result; returns what is wrong with it, nothing if all is well."""
    for split in (TRAIN, TEST):
        for step in STEPS.values():
            step(spark, s, split)
    return finish(spark, s)
