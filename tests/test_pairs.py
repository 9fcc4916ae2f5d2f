"""Raw names, cardinality, siblings, learned steps and work tables on small cases."""

import itertools
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.functions import decision
from kinweave.operators import cardinality, features, learn, pairs, rawform, retrieval
from kinweave.plans import features as plans
from kinweave.plans import registry
from kinweave.sources import work


def test_transformation():
    t = rawform.transformation("Crème Bakery LTD", "Creme Bakery House LIMITED")
    assert t["accent"] == 1 and t["legal"] == "ltd>limited" and t["add"] == ["house"] and t["drop"] == [] and t["first"] == 1.0
    assert rawform.transformation("abcdef", "abbcdef")["dup"] == 1 and rawform.transformation(None, "") ["sub"] == []
    assert rawform.transformation("stone", "stine")["sub"] == ["o>i"] and rawform.transformation("stone", "stine")["kbd"] == 1
    assert rawform.near_keys("a", "s") and not rawform.near_keys("q", "p") and rawform.word_lcs(["a", "b"], ["b", "a", "b"]) == 2


def test_raw_features(spark):
    p = spark.createDataFrame([("a", "b", "Blue Sky (North) Ltd", "BLUE SKY LTD"), ("c", "d", "Sky Blue", "Blue Sky"), ("e", "f", None, "")], "s1_id string, tgt_id string, na string, nb string")
    r = {x["s1_id"]: x for x in rawform.raw_features(p).collect()}
    assert r["a"]["rn_legal_eq"] == 1 and r["a"]["rn_paren_eq"] == 0 and r["a"]["rn_paren_n"] == 1 and r["a"]["rn_case_same"] == 0 and r["a"]["rn_del"] == 6
    assert r["c"]["rn_reordered"] == 1 and r["c"]["rn_order_frac"] == 0.0 and r["e"]["rn_ops"] == 0 and r["e"]["rn_order_frac"] is None


def test_templates(spark):
    rows = [(f"a{i}", "t", i % 2, "tea house", "tea house group" if i % 2 else "tea shop") for i in range(20)]
    t = rawform.transformed(spark.createDataFrame(rows, "s1_id string, tgt_id string, label int, na string, nb string"))
    tables = {(r["kind"], r["key"]): r["llr"] for r in rawform.template_tables(t).collect()}
    assert tables["add", "group"] > 2 and tables["add", "shop"] < -2 and tables["legal", ">"] == 0.0
    got = {r["s1_id"]: r for r in rawform.template_features(t, rawform.template_tables(t)).collect()}
    assert got["a1"]["g8_copy_llr"] > 2 > -2 > got["a0"]["g8_copy_llr"] and got["a1"]["g8_add_min"] == tables["add", "group"]


def brute_choice(p, prior):
    n = len(p)
    q = [x / sum(prior[: n + 1]) for x in prior[: n + 1]]
    values = [q[0]]
    for k in range(1, n + 1):
        v = 0.0
        for c in range(1, n + 1):
            weight, gain = 0.0, 0.0
            for truth in itertools.product((0, 1), repeat=n):
                if sum(truth) == c:
                    w = 1.0
                    for x, y in zip(p, truth):
                        w *= x if y else 1 - x
                    weight += w
                    gain += w * 1.25 * sum(truth[:k]) / (0.25 * c + k)
            v += q[c] * gain / weight if weight else 0
        values.append(v)
    return max(range(n + 1), key=lambda k: (round(values[k], 12), -k))


def test_choice_under_a_prior(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        p = sorted((round(rng.random(), 3) for _ in range(rng.randint(1, 5))), reverse=True)
        rows.append((i, p, [round(rng.random(), 3) for _ in range(13)]))
    d = spark.createDataFrame(rows, "i int, p array<double>, q array<double>")
    got = {r["i"]: r for r in d.select("i", cardinality.choose(F.col("p"), F.col("q")).alias("k"), cardinality.choose(F.col("p"), cardinality.counts(F.col("p"))).alias("own"), decision.best_k(F.col("p")).alias("best")).collect()}
    assert all(got[i]["k"] == brute_choice(p, q) and got[i]["own"] == got[i]["best"] for i, p, q in rows)
    none = d.limit(1).select(cardinality.choose(F.col("p"), F.array_repeat(F.lit(0.0), 13)).alias("k")).first()
    assert none["k"] == 0


def test_siblings(spark):
    p = spark.createDataFrame([("a", "S2-1", 0.9), ("a", "S2-2", 0.5), ("a", "S3-3", 0.2), ("b", "S2-1", 0.005)], "s1_id string, tgt_id string, p double")
    t = spark.createDataFrame([("S2-1", "red fox", "redfox", "1 hill", "1"), ("S2-2", "red fox", "redfox", "1 hill", "1"), ("S3-3", "blue", "blue", "", "")], "entity_id string, core string, compact string, addr string, first string")
    r = {(x["s1_id"], x["tgt_id"]): x for x in pairs.sibling_features(p, t, "p").collect()}
    assert r["a", "S2-1"]["sib_name"] == 0.5 and r["a", "S2-1"]["sib_n"] == 1 and r["a", "S3-3"]["sib_n"] == 2
    assert r["a", "S3-3"]["sib_addr"] is None and r["b", "S2-1"]["sib_n"] is None


def test_pair_features(spark):
    rec = spark.createDataFrame([("US", 1, "S1-1", "Red Fox Inn LLC", "12 Mill Road, Ohio"), ("US", 2, "S2-1", "RFI", "12 Mill Rd, OH"), ("US", 2, "S2-2", "", None)], "country string, k int, entity_id string, name string, address string")
    p = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2")], "s1_id string, tgt_id string")
    r = {x["tgt_id"]: x for x in features.pair_features(features.paired(p, features.normal_records(rec))).collect()}
    assert r["S2-1"]["acro"] == 1 and r["S2-1"]["a_tset"] == 1.0 and r["S2-1"]["state_eq"] == 1 and r["S2-1"]["nf_contain"] == 1 and r["S2-1"]["legal_missing"] == 1
    assert r["S2-2"]["n_ratio"] is None and r["S2-2"]["name_empty_b"] == 1 and r["S2-2"]["addr_empty_b"] == 1 and r["S2-2"]["nf_eq"] is None


def test_cross_fit_and_stack(spark):
    rng = random.Random(3)
    rows = [(f"S1-{i}", f"S2-{i}", int(i % 3 == 0), rng.random() + (i % 3 == 0), rng.random()) for i in range(600)]
    p = spark.createDataFrame(rows, "s1_id string, tgt_id string, label int, good double, noise double")
    x = learn.cross_predict(p, learn.cross_fit(p, ("good", "noise"), rounds=5, depth=2), ("good", "noise"), "p1")
    mean = {r["label"]: r["m"] for r in x.groupBy("label").agg(F.avg("p1").alias("m")).collect()}
    assert mean[1] - mean[0] > 0.4 and x.count() == 600
    assert learn.auc(x, "p1").first()["auc"] > 0.9
    assert learn.stacked_out_of_fold(x, ("p1",), rounds=3, depth=2).count() == 600


def test_learned_steps_read_written_rows(spark):
    """A fit reads its rows several times over: ranks and groups are not computed, and shuffled, for each reading."""
    d = "/root/testdata/sf0.001"
    for rows in (plans._learnable(spark, d), plans._stage_rows(spark, d)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and rows.count() > 0
    # a source at a time, with the same ranks as over both
    x = registry.blk_candidates(spark, d)
    whole = pairs.rank_gaps(x.join(registry.truth(spark, d).distinct().withColumn("label", F.lit(1)), ["s1_id", "tgt_id"], "left").fillna(0, ["label"]))
    got = plans._learnable(spark, d).select(whole.columns)
    assert got.inputFiles() and {re.search(r"learnable(\d)", f).group(1) for f in got.inputFiles()} == {"2", "3"}
    assert whole.exceptAll(got).isEmpty() and got.exceptAll(whole).isEmpty()


def test_written_tables_leave_no_shuffle(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", disk.getAllBlocks().mkString(" ")))
    before, option = held(), spark.conf.get(work.CLEANUP)
    x = spark.range(1000).withColumn("a", F.col("id") % 7).repartition(3, "a").groupBy("a").count()
    assert work.written(x, "x").count() == 7
    for _ in range(50):
        left = set(re.findall(r"shuffle_(\d+)_", " ".join(held() - before)))
        if len(left) < 2:
            break
        time.sleep(0.2)
    assert len(left) < 2  # the count's own
    assert spark.conf.get(work.CLEANUP) == option


def test_work_tables(spark, tmp_path):
    assert work.safe("Côte d'Or/x") == "Côte_d_Or_x"
    work.save_map({"b": "é", "a": "1"}, str(tmp_path / "m.json"))
    assert work.load_map(str(tmp_path / "m.json")) == {"a": "1", "b": "é"}
    df = spark.createDataFrame([("x", 2, 1), ("y", 3, 2)], "country string, tgt_src int, v int")
    work.write_table(df, f"file://{tmp_path}/t")
    assert work.load_table(spark, f"file://{tmp_path}/t", ["v"], "country = 'y'").collect() == [(2,)]
    s1 = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    m, c = (spark.createDataFrame(r, "s1_id string, tgt_id string") for r in ([("a", "t")], [("a", "t"), ("a", "u")]))
    work.write_outputs(s1, m, c, f"file://{tmp_path}/o")
    lists = spark.read.option("sep", "\t").option("header", True).csv(f"file://{tmp_path}/o/matches").fillna("")
    assert sorted(map(tuple, lists.collect())) == [("a", "t"), ("b", "")]
    assert work.validate(lists, s1, c.select("tgt_id")) == [] and work.validate(lists.where("s1_id = 'a'"), s1, c.where("tgt_id = 'u'").select("tgt_id")) == ["records without a row: 1", "unknown targets: 1"]
    with pytest.raises(ValueError):
        work.write_outputs(s1, c, m, f"file://{tmp_path}/p")


def test_rank_gaps_shuffles_once_a_side(spark):
    """Rows with all their columns cross the network once for the reference records' windows and once for the targets'."""
    c = spark.createDataFrame([("US", 2, "S1-1", "S2-1", 0.5, 0.25, 0.375), ("US", 2, "S1-1", "S2-2", 0.5, 0.5, 0.5), ("US", 2, "S1-2", "S2-2", 0.75, 0.0, 0.375)], "country string, tgt_src int, s1_id string, tgt_id string, cos_n double, cos_a double, cos_na double")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = pairs.rank_gaps(c)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange hashpartitioning") == 2
    rows = {(r["s1_id"], r["tgt_id"]): r for r in got.collect()}
    r = rows["S1-1", "S2-2"]
    assert (r["n_s1"], r["n_tgt"], r["rk1_n"], r["gap1_n"], r["rkt_n"], r["gapt_n"], r["rk1_a"], r["rkt_na"]) == (2, 2, 2, 0.0, 2, 0.25, 1, 1)


def test_group_features_shuffle_once_a_side(spark):
    """The windows of a record, also within its sources, take one shuffle, the windows of a target another."""
    p = spark.createDataFrame([("S1-1", "S2-1", 0.75), ("S1-1", "S2-2", 0.5), ("S1-1", "S3-2", 0.625), ("S1-2", "S2-2", 0.75)], "s1_id string, tgt_id string, p double")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = pairs.group_features(p, "p")
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange hashpartitioning") == 2
    r = next(r for r in got.collect() if (r["s1_id"], r["tgt_id"]) == ("S1-1", "S2-2"))
    assert tuple(r)[2:] == (3, 2, 2, 0.75, 0.625, 0.25, 1.875, 2, 0.75, 0.75, 1, 2, -0.25)


def test_search_workers_give_memory_back(spark):
    """Workers outlive the tasks that hold blocks of targets; what those had is free again."""
    feature = lambda i: F.pmod(F.xxhash64("id", i), F.lit(40_000)).cast("string")
    fs = F.transform(F.sequence(F.lit(1), F.lit(40)), feature)
    v = spark.range(60_000).select(F.lit("x").alias("country"), F.col("id").cast("string").alias("entity_id"), fs.alias("fs"), F.transform(fs, lambda f: F.lit(0.1)).alias("ws"))

    def own(batches):
        for _ in batches:
            pass
        with open("/proc/self/smaps_rollup") as f:
            kb = sum(int(x.split()[1]) for x in f if x.startswith(("Pss_Anon", "Pss_Shmem")))
        time.sleep(0.5)  # so that each worker has one of the tasks
        yield pa.RecordBatch.from_arrays([pa.array([kb])], names=["kb"])

    memory = lambda: max(r["kb"] for r in spark.range(0, 4, 1, 4).mapInArrow(own, "kb long").collect())
    searched = lambda n: retrieval.top_k(v.where("entity_id < 100"), v.where(f"entity_id < {n}"), 1).count()
    searched(100)  # what is imported
    before = memory()
    assert searched(60_000) == 100
    assert memory() - before < 20_000, (memory(), before)
