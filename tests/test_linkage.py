import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinweave.functions import decision, similarity, text
from kinweave.operators import pairs, retrieval
from kinweave.plans import registry
from kinweave.sources import entities


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("v")).first()["v"]


def test_fold(spark):
    assert one(spark, text.fold(F.col("a")), a="Ĉœur Łódź d’Ýs") == "coeur lodz d'ys"


def test_numbers(spark):
    assert one(spark, text.numbers(F.col("a")), a="0081 hill 5 b 5 000") == ["81", "5", "0"]


def test_lcs(spark):
    assert one(spark, similarity.lcs(F.col("a"), F.col("b")), a="kitten", b="sitting") == 4
    assert one(spark, similarity.ratio(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, similarity.lcs(F.col("a"), F.col("b")), a="", b="x") == 0


@pytest.mark.parametrize("p,k", [([0.95, 0.9, 0.05], 2), ([0.1, 0.05], 0), ([0.6], 1)])
def test_best_k(spark, p, k):
    assert one(spark, decision.best_k(F.col("a")), a=p) == k


def test_best_k_against_enumeration(spark):
    rng = random.Random(1)
    groups = [(i, sorted((round(rng.random(), 3) for _ in range(rng.randint(1, 6))), reverse=True)) for i in range(30)]

    def best(p):
        values = []
        for k in range(len(p) + 1):
            v = 0.0
            for truth in itertools.product((0, 1), repeat=len(p)):
                w = 1.0
                for x, y in zip(p, truth):
                    w *= x if y else 1 - x
                tp, n = sum(truth[:k]), sum(truth)
                v += w * (1.0 if k == 0 and n == 0 else 0.0 if tp == 0 else 1.25 * tp / (0.25 * n + k))
            values.append(round(v, 12))
        return values.index(max(values))

    got = {r["i"]: r["k"] for r in spark.createDataFrame(groups, "i int, p array<double>").select("i", decision.best_k(F.col("p")).alias("k")).collect()}
    assert got == {i: best(p) for i, p in groups}


def test_poisson_binomial(spark):
    assert one(spark, decision.poisson_binomial(F.col("a")), a=[0.5, 0.5]) == [0.25, 0.5, 0.25]


def test_evaluation(spark):
    s = lambda rows: spark.createDataFrame(rows, "s1_id string, tgt_id string")
    ids = spark.createDataFrame([("A",), ("B",), ("C",)], "s1_id string")
    f = {r["s1_id"]: r["f"] for r in pairs.per_entity(s([("A", "1"), ("A", "2"), ("A", "3"), ("B", "9")]), s([("A", "1"), ("A", "2")]), ids).collect()}
    assert f == {"A": 0.714286, "B": 0.0, "C": 1.0}


def test_top_k_and_caps(spark):
    w = lambda rows: spark.createDataFrame(rows, "country string, entity_id string, f string, w double")
    q = w([("x", "q", "a", 1.0), ("x", "q", "b", 1.0)])
    t = w([("x", "1", "a", 1.0), ("x", "1", "b", 1.0), ("x", "2", "a", 1.0), ("x", "3", "a", 1.0), ("y", "4", "b", 1.0)])
    got = retrieval.top_k(q, t, 5, share=0.0, least=2).collect()
    assert [(r["tgt_id"], r["score"]) for r in got] == [("1", 1.0)]
    assert retrieval.top_k(q, t, 5, share=1.0, least=2).count() == 3


def test_assignment_and_rules(spark):
    p = spark.createDataFrame([("a", "t", 0.5), ("b", "t", 0.5), ("a", "u", 0.2)], "s1_id string, tgt_id string, p double")
    assert sorted((r["s1_id"], r["tgt_id"]) for r in pairs.many_to_one(p, "p").collect()) == [("a", "t"), ("a", "u")]
    chosen = p.where("tgt_id = 'u'")
    assert {r["p"] for r in pairs.boost(p, chosen, "p").where("tgt_id = 'u'").collect()} == {0.95}
    assert {r["p"] for r in pairs.exclude(p, chosen, "p").where("tgt_id = 'u'").collect()} == {0.0}


def test_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tThe "Red" Door\t\tUS\n')
    assert entities.read_source(spark, str(tmp_path / "s.tsv")).collect() == [("S1-1", 'The "Red" Door', "", "US")]
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-5,S3-7\nS1-2\t\n")
    truth = entities.read_truth(spark, str(tmp_path / "t.tsv"))
    assert truth.collect() == [("S1-1", "S2-5"), ("S1-1", "S3-7")]
    with pytest.raises(ValueError):
        entities.checked(truth, truth.where("tgt_id = 'S2-5'"))


def test_search_and_dots_in_blocks(spark):
    """Blocks of few postings, equal scores, caps and heaviest features against plain sums; products of postings aren't shuffled."""
    rng, e = random.Random(3), {}
    for country, side, n in (("x", "q", 40), ("x", "t", 90), ("y", "q", 20), ("y", "t", 30), ("z", "q", 3)):
        for i in range(n):
            e[country, f"{side}{country}{i % 17 if i % 5 else i}"] = {f"é{rng.randrange(30)}": rng.choice((0.125, 0.25, 0.5)) for _ in range(rng.randrange(1, 9))}
    rows = [(c, i, f, w) for (c, i), fs in e.items() for f, w in fs.items()]
    all_ = spark.createDataFrame(rows, "country string, entity_id string, f string, w double")
    q, t = all_.where("entity_id LIKE 'q%'"), all_.where("entity_id LIKE 't%'")
    found = retrieval.top_k(q, t, 4, share=0.1, max_feats=3, least=6, most=40)
    want = set()
    for (c, i), fs in e.items():
        if i[0] == "q":
            targets = {b: v for (d, b), v in e.items() if d == c and b[0] == "t"}
            df = Counter(f for v in targets.values() for f in v)
            kept = sorted((f for f in fs if 0 < df[f] <= max(6, int(0.1 * len(targets)))), key=lambda f: (-fs[f], f))[:3]
            scores = {b: sum(fs[f] * v[f] for f in kept if f in v) for b, v in targets.items() if set(kept) & set(v)}
            want |= {(i, b, round(s, 6), r) for r, (b, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:4], 1)}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 60
    assert not re.search(r"hashpartitioning\(country#\d+, s1_id#\d+, tgt_id#\d+", found._jdf.queryExecution().toString())
    by = {i: v for (_, i), v in e.items()}
    asked = [(a, b) for a in by for b in by if a[0] == "q" and rng.random() < 0.2] + [("qx0", "none")]
    p = spark.createDataFrame(asked, "s1_id string, tgt_id string")
    got = {(r["s1_id"], r["tgt_id"]): r["dot"] for r in retrieval.pair_dots(p, all_, most=40).collect()}
    assert got == {(a, b): sum(w * by[b].get(f, 0.0) for f, w in by[a].items()) for a, b in asked if b in by}
    assert {r["c"] for r in retrieval.pair_cosine(p.where("tgt_id = 'none'"), all_, "c").collect()} == {0.0}


def test_names_that_share_only_frequent_grams(spark, tmp_path):
    """Targets that over 1000 others are alike to are found: the search of names has no cap on what a gram may have."""
    import duckdb

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfgh") for _ in range(rng.randrange(1, 5)))
    rows = [(i, f"omega {word()} {word()}" if i >= 10 else ("omega" if i < 2 else f"omega {word()}"), "en", "src0" if i < 30 else f"src{1 + i % 2}") for i in range(2300)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    got = {tuple(r) for r in registry.QUERIES["blk_topk_name"](spark, d).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    want = set(c.sql(registry.ORACLE_SQL["blk_topk_name"]).fetchall())
    assert got == want and Counter(a for a, *_ in got) == {f"S1-{i}": 6 for i in range(30)}
