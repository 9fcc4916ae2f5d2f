import math

import pytest
from pyspark.sql import functions as F

from kinweave.functions import words
from kinweave.operators import decide, rules

PAIR = "s1_id string, tgt_id string, country string, na string, nb string, a_sim double, nf_eq int, label int"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a,b,rel", [("123", "1234", "indel"), ("123", "124", "sub"), ("123", "132", "transpose"), ("120", "117", "near<=4"), ("120", "140", "sub"), ("120", "135", "near<=20"), ("120", "480", "far"), ("", "12", "na"), ("7", "7", "eq"), (None, "1", "na"), ("1" * 50, "2" * 50, "far")])
def test_number_relation(spark, a, b, rel):
    assert one(spark, words.number_relation(F.col("a").cast("string"), F.col("b")), a=a, b=b) == rel


@pytest.mark.parametrize("a,b,yes", [("cie", "compagnie", True), ("compagnie", "cie", False), ("ice", "compagnie", False), ("compag", "compagnie", False), ("", "x", False)])
def test_abbreviation(spark, a, b, yes):
    assert one(spark, words.is_abbreviation(F.col("a"), F.col("b")), a=a, b=b) == yes


def test_order_and_prefix(spark):
    split = lambda c: F.array_remove(F.split(c, " "), "")
    order = words.order_fraction(split("a"), split("b"))
    assert one(spark, order, a="x y z", b="x z y") == 0.5
    assert one(spark, order, a="x y", b="x") is None and one(spark, order, a="", b="") is None
    assert one(spark, words.common_prefix(F.col("a"), F.col("b")), a="abcd", b="abx") == pytest.approx(2 / 3)
    assert one(spark, words.common_prefix(F.col("a"), F.col("b")), a="", b="abx") is None
    assert one(spark, order, a="x x y", b="y x") == 0.0  # repeats count, by the last place


def pairs(spark):
    rows = [(f"n{i}", f"t{i}", "c", "acme", "acme west", 0.9, 0, 0) for i in range(12)]
    rows += [(f"s{i}", f"u{i}", "c", "acme", "acme west", 1.0, 1, 1) for i in range(2)]
    rows += [(f"g{i}", f"v{i}", "c", "acme", "acme group", 1.0, 1, 1) for i in range(15)]
    rows += [("g99", "v99", "c", "acme", "acme group", 0.9, 0, 0), ("e", "e", "c", "", "", None, None, None)]
    rows += [(f"w{i}", f"x{i}", "c", "bolt works", "bolt group", 1.0, 1, 0) for i in range(3)] + [(f"y{i}", f"z{i}", "c", "bolt group", "bolt works", 1.0, 1, 1) for i in range(3)]
    return spark.createDataFrame(rows, PAIR)


def ids(df):
    return {r["s1_id"] for r in df.collect()}


def test_words_of_pairs(spark):
    x = pairs(spark)
    counts = {r["w"]: (r["d"], r["s"], r["llr"]) for r in rules.addition_counts(x).collect()}
    assert counts == {"west": (12, 2, round(math.log(13 / 3), 6)), "group": (1, 15, round(math.log(2 / 16), 6))}
    assert ids(rules.decoy_word_pairs(x, 10, 1.0)) == {f"n{i}" for i in range(12)}
    assert ids(rules.noise_addition_pairs(x, 10, -1.0)) == {f"g{i}" for i in range(15)}
    assert {r["w"]: r["ns"] for r in rules.noise_share(x, 1).collect()}["group"] == round(1 - (2 / 12 + 15) / 2 / 15, 6)
    vocabulary = rules.decoy_vocabulary(x, 10, 0.2)
    assert [(r["w"], r["n"]) for r in vocabulary.collect()] == [("west", 14)]
    assert len(ids(rules.vocabulary_pairs(x, vocabulary))) == 14
    assert ids(rules.refined_swaps(x, 5, 2.0)) == {f"y{i}" for i in range(3)}
    assert rules.addition_counts(x.where("false")).count() == 0


def test_token_map(spark):
    p = spark.createDataFrame([("a b", "x y"), ("a c", "x z"), ("d c", "x z"), ("a", "x y"), ("", "")], "na string, nb string")
    assert {(r["tok"], r["best"], r["n"]) for r in rules.token_map(p, 2, 0.5).collect()} == {("x", "a", 2), ("z", "c", 2)}


def test_recovery(spark):
    rec = "country string, entity_id string, name string, addr string, number string"
    s1 = spark.createDataFrame([("c", "a", "n", "1 x", "1"), ("c", "b", "n", "1 x", "1"), ("c", "d", "m", "2 y", "2")], rec)
    tg = spark.createDataFrame([("c", "t", "n", "1 x", "1"), ("c", "u", "m", "2 y", "2"), ("c", "v", "m", "", "2"), ("c", "w", "m", "2 y", "2")], rec)
    pair = lambda rows: spark.createDataFrame(rows, "s1_id string, tgt_id string")
    x = rules.same_address_pairs(s1, tg, pair([("d", "w")]))
    assert {(r["s1_id"], r["tgt_id"]) for r in x.collect()} == {("a", "t"), ("b", "t"), ("d", "u")}
    assert {(r["s1_id"], r["tgt_id"]) for r in rules.recovered(x, pair([("z", "q")])).collect()} == {("d", "u")}
    assert rules.recovered(x, pair([("z", "u")])).count() == 0 and rules.same_address_pairs(s1, tg, pair([]), most=1).count() == 2


def test_decisions(spark):
    p = spark.createDataFrame([("a", "t", 0.9), ("a", "u", 0.3), ("b", "v", 0.4)], "s1_id string, tgt_id string, p double")
    truth = spark.createDataFrame([("a", "t")], "s1_id string, tgt_id string")
    s1 = spark.createDataFrame([("a", "c"), ("b", "c"), ("d", "c")], "s1_id string, country string")
    best = decide.tune_threshold(p, "p", truth, s1).first()
    assert (best["tau"], best["macro_f"]) == (0.41, 1.0)
    p2 = spark.createDataFrame([("a", "x", 0.95), ("a", "y", 0.9), ("a", "z", 0.05), ("b", "x", 0.1)], "s1_id string, tgt_id string, p double")
    assert {(r["s1_id"], r["tgt_id"]) for r in decide.expected_f_select(p2, "p").collect()} == {("a", "x"), ("a", "y")}
    z = spark.createDataFrame([("a", "1", 3.0), ("a", "2", 1.0), ("a", "3", -2.0), ("b", "1", 0.5)], "s1_id string, tgt_id string, z double")
    assert {(r["s1_id"], r["tgt_id"], r["rk"], r["margin"]) for r in decide.logit_context(z, "z").collect()} == {("a", "1", 1, 2.0), ("a", "2", 2, -2.0), ("a", "3", 3, -5.0), ("b", "1", 1, 10.0)}
    r = decide.country_report(p, "p", 0.5, s1).first()
    assert (r["n"], r["matched"], r["without"]) == (3, 0.333333, 0.333333)
    assert decide.ceiling(p, truth, s1).first()["recall"] == 1.0


def frame(spark, names, rows):
    kinds = {str: "string", float: "double", int: "int"}
    sample = [next((r[i] for r in rows if r[i] is not None), "") for i in range(len(names.split()))]
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names.split(), sample)))


def test_number_gate(spark):
    rows = [(f"a{i}", f"b{i}", "c", 0.9, 0, "120", "121", 0, 0, 0, 0.0, i % 2) for i in range(6)]
    rows += [("e", "f", "c", 0.9, 0, "120", "480", 0, 0, 0, 0.0, 0), ("g", "h", "d", 0.9, 0, "12", "129", 0, 0, 0, 0.0, 0), ("k", "l", "c", 0.9, 0, "7", "8", 0, 0, 0, None, 0)]
    x = frame(spark, "s1_id tgt_id country a_sim nf_eq fa fb n_ua n_ub num_overlap num_jacc legal_conflict", rows)
    assert [r["country"] for r in rules.gated_countries(x).collect()] == ["c"]  # d has no neighbours
    gated = rules.number_gate(x, rules.gated_countries(x))
    assert ids(gated) == {*(f"a{i}" for i in range(6)), "e"}
    assert ids(rules.still_gated(gated, x)) == {f"a{i}" for i in range(6)} and ids(rules.still_gated(gated, x, "open")) == {"a1", "a3", "a5"}


@pytest.mark.parametrize(("na", "nb", "yes"), [("acme club", "acme union", True), ("acme club", "acme clubs", False), ("club", "union", False), ("acme club", "acme rare", False), ("acme clu", "acme club", False), ("acme unit", "acme union", False)])
def test_category_swap(spark, na, nb, yes):
    stats = frame(spark, "country t df1 f", [("c", "club", 600, 0.0), ("c", "union", 900, 0.1), ("c", "rare", 3, 0.0), ("c", "clubs", 800, 0.0), ("c", "unit", 800, 0.0)])
    x = frame(spark, "s1_id tgt_id country na nb", [("a", "b", "c", na, nb)])
    assert rules.category_swaps(x, stats).count() == int(yes)


def test_chain_never_lifts_the_excluded(spark):
    p = frame(spark, "s1_id tgt_id p", [("a", "t", 0.2), ("b", "u", 0.3), ("c", "v", 0.9)])
    x = p.where("p < 0")
    some = lambda *i: p.where(p.s1_id.isin(*i)).select("s1_id", "tgt_id")
    got = rules.chain(p, x, some("a", "c"), some("a", "b"), lambda a: some("a"), lambda a: some(), lambda a: some("c"), lambda q: decide.by_threshold(q, "p", 0.5))
    assert ids(got) == {"b"}
