import shutil

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinweave.functions.text import normal_name
from kinweave.functions.translit import romanised, spellings
from kinweave.operators import characters, features, learn, spelling
from kinweave.operators.pairs import fold
from kinweave.plans import features as plans

WORDS = "s1_id string, tgt_id string, country string, a_name string, b_name string, a_address string, b_address string"


def pair(i, a_name, b_name, a_address="", b_address="", country="India"):
    return (f"S1-{i}", f"S2-{i}", country, a_name, b_name, a_address, b_address)


def test_romanised(spark):
    rows = spark.createDataFrame([("कमल",), ("किताब",), ("राम्",), ("२०",), ("abc",), ("",)], "w string")
    assert [r[0] for r in rows.select(romanised(F.col("w"))).collect()] == ["kamala", "kitaaba", "raam", "20", "abc", ""]
    assert all(x.isascii() for x in spellings().values())


def test_learned_words(spark):
    true = [pair(i, "Kamal Traders Private", "कमल ट्रेडर्स प्राइवेट") for i in range(3)]
    other = [pair(8, "Komal Traders", "कमल ट्रेडर्स"), pair(9, "One Two", "एक"), pair(10, "अ", "अ")]
    got = {r["tok"]: (r["best"], r["n"]) for r in spelling.word_spellings(spark.createDataFrame(true + other, WORDS)).collect()}
    assert got["कमल"] == ("kamal", 3) and got["प्राइवेट"][0] == "pvt" and "एक" not in got and "अ" not in got


def test_learned_parts(spark):
    rows = [pair(i, "", "", "1 Hill, Pune, Maharashtra", "1 Hill, महाराष्ट्र") for i in range(2)]
    rows += [pair(5, "", "", "Goa, Kerala", "गोवा"), pair(6, "", "", "Goa", "गोवा")]
    got = [(r["tok"], r["best"], r["n"]) for r in spelling.part_spellings(spark.createDataFrame(rows, WORDS)).collect()]
    assert got == [("महाराष्ट्र", "maharashtra", 2)]


def test_records_are_spelt(spark):
    e = spark.createDataFrame([("S2-1", "कमल राम", "5 Hill, महाराष्ट्र", "India", 2), ("S2-2", "Plain", None, "India", 2), ("S2-3", None, "", "US", 2)], "entity_id string, name string, address string, country string, k int")
    words = spark.createDataFrame([("कमल", "kamal", 2)], "tok string, best string, n long")
    parts = spark.createDataFrame([("महाराष्ट्र", "maharashtra", 2)], "tok string, best string, n long")
    x = spelling.with_spellings(e, words, parts)
    got = {r["entity_id"]: r for r in features.normal_records(x, spelt=spelling.spelt_part, spelt_word=spelling.spelt_word).collect()}
    assert got["S2-1"]["core"] == "kamal raama" and got["S2-1"]["indic"] and got["S2-1"]["state"] != ""
    assert got["S2-2"]["core"] == "plain" and got["S2-2"]["addr_empty"] and got["S2-3"]["core"] == ""


def test_a_name_without_spelling_keeps_its_words(spark):
    row = spark.createDataFrame([("कमल Ltd",)], "w string").select(normal_name(F.col("w")).alias("n")).first()["n"]
    assert row["core"] == "कमल" and row["legal"] == "ltd"


def test_characters(spark):
    rec = spark.createDataFrame([("S1-1", "aab", "b"), ("S2-1", "aax", None), ("S2-2", "", "")], "entity_id string, name string, address string")
    vocabulary = characters.vocabulary(rec, 2)
    assert [(r["c"], r["n"], r["code"]) for r in vocabulary.orderBy("code").collect()] == [("a", 4, 4), ("b", 2, 5)]
    codes = characters.encoded(rec, vocabulary)
    got = {r["entity_id"]: r["codes"] for r in codes.collect()}
    assert all(len(v) == characters.WIDTH for v in got.values())
    assert got["S1-1"][:4] == [4, 4, 5, 0] and got["S1-1"][characters.NAME] == 5 and got["S2-1"][:3] == [4, 4, characters.UNKNOWN] and not any(got["S2-2"])
    x = characters.pair_codes(spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, tgt_id string"), codes).first()["x"]
    assert len(x) == 225 and x[0] == characters.START and x[1 : 1 + characters.WIDTH] == got["S1-1"]


def test_characters_learn_equality(spark):
    rec = spark.createDataFrame([(f"S{k}-{i}", ("ab" if i % 2 else "cd") * 3, "x") for k in (1, 2) for i in range(40)], "entity_id string, name string, address string")
    vocabulary = characters.vocabulary(rec, 5)
    codes = characters.encoded(rec, vocabulary)
    p = spark.createDataFrame([(f"S1-{i}", f"S2-{j}", int(i % 2 == j % 2), i > 30) for i in range(40) for j in range(4)], "s1_id string, tgt_id string, label int, held_out boolean")
    x = characters.pair_codes(p, codes)
    z = characters.score(x, [characters.train(x, 5, seed=s) for s in (1, 2)], 5)
    assert learn.auc(z.join(p.where("held_out"), ["s1_id", "tgt_id"]).select(F.expr("1 / (1 + exp(-z))").alias("z"), "label"), "z").first()["auc"] == 1.0


def test_characters_train_without_keeping_rows(spark):
    """All training rows are used, and none of their differences are kept by Spark: gradients against finite differences, nothing persisted."""
    rng = np.random.default_rng(1)
    rows = [([characters.START, *map(int, rng.integers(0, 9, 2 * characters.WIDTH))], int(i % 3 == 0), i % 7 == 0) for i in range(60)]
    p = spark.createDataFrame(rows, "x array<int>, label int, held_out boolean").repartition(3)
    f = np.concatenate(list(characters._differences(pa.array([r[0] for r in rows], pa.list_(pa.int32())), 5)))
    plain = [[abs(r[0][1 + s : 1 + s + w].count(c) - r[0][1 + characters.WIDTH + s : 1 + characters.WIDTH + s + w].count(c)) / w for s, w in ((0, 40), (40, 72)) for c in range(1, 9)] for r in rows]
    assert np.allclose(f, plain)
    y, kept = np.array([r[1] for r in rows], float), np.array([not r[2] for r in rows])
    n = f.shape[1]
    w = rng.normal(0, 1, n * characters.HIDDEN + 2 * characters.HIDDEN + 1)
    value, g = characters.Perceptron.of(w).loss(f, y)
    for i in rng.choice(len(w), 20):
        e = np.zeros(len(w))
        e[i] = 1e-5
        assert abs((characters.Perceptron.of(w + e).loss(f, y)[0] - characters.Perceptron.of(w - e).loss(f, y)[0]) / 2e-5 - g[i]) < 1e-5
    seen = []
    real, characters.minimum = characters.minimum, lambda loss, start, rounds: seen.append((start, loss(start))) or real(loss, start, rounds)
    persisted = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    try:
        m = characters.train(p, 5, rounds=4)
    finally:
        characters.minimum = real
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == persisted
    (start, (value, g)), = seen
    whole = characters.Perceptron.of(start).loss(f[kept], y[kept])
    assert abs(value - whole[0] / kept.sum()) < 1e-9 and np.allclose(g, whole[1] / kept.sum())
    assert m.loss(f[kept], y[kept])[0] < whole[0]


def test_reference_statistics(spark):
    of = lambda rows: spark.createDataFrame(rows, "country string, t string, df1 long")
    got = learn.reference_stats(of([("US", "a", 1)]), of([("US", "a", 9), ("US", "b", 2), ("FR", "c", 3)]))
    assert sorted(map(tuple, got.collect())) == [("FR", "c", 3), ("US", "a", 1)]


def test_characters_trained_side_by_side(spark):
    rng = np.random.default_rng(2)
    rows = [([characters.START, *map(int, rng.integers(0, 9, 2 * characters.WIDTH))], int(i % 3 == 0), i % 7 == 0) for i in range(60)]
    p = spark.createDataFrame(rows, "x array<int>, label int, held_out boolean").repartition(3).cache()
    both = characters.train_all(p, (1, 2), 5, rounds=3)
    for seed, m in zip((1, 2), both, strict=True):
        one = characters.train(p, 5, rounds=3, seed=seed)
        assert np.allclose(m.hidden, one.hidden) and np.allclose(m.out, one.out) and abs(m.last - one.last) < 1e-9
    p.unpersist()


def test_pair_scores_have_all_rounds_and_pairs(spark, tmp_path, monkeypatch):
    """The models behind nn_pair_scores get as many rounds and as deep trees as the operators have, and learn from every pair of folds A and B."""
    asked = []

    def trees(p, columns, rounds=learn.train.__defaults__[0], depth=learn.train.__defaults__[1], **how):
        asked.append((rounds, depth))
        return real(p, columns, rounds=2, depth=2, **how)

    def few(loss, starts, rounds):
        asked.append(rounds)
        return all_rounds(loss, starts, 1)

    real, all_rounds = learn.train, characters.minima
    monkeypatch.setattr(learn, "train", trees)
    monkeypatch.setattr(characters, "minima", few)
    d = str(tmp_path)
    shutil.copy("/root/testdata/sf0.001/documents.parquet", d)
    n = plans.QUERIES["nn_pair_scores"](spark, d).count()
    assert asked == [(40, 5)] * 4 + [60]
    pairs_ = plans._stage(spark, d)
    assert n == pairs_.count()
    known = pairs_.where(fold(F.col("s1_id")) != "H").select("s1_id", "tgt_id")
    learned = plans.work.once(spark, "nn_training", d, lambda: None).select("s1_id", "tgt_id")
    assert known.exceptAll(learned).isEmpty() and learned.exceptAll(known).isEmpty()
    # also those that no earlier model is in doubt of
    p = spark.createDataFrame([(f"S1-{i}", "S2-1", 0.001) for i in range(50)], "s1_id string, tgt_id string, p double")
    assert characters.training_pairs(p, "p", easy=1.0).count() == p.where(fold(F.col("s1_id")) != "H").count()
