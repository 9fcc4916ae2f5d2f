import random

import pytest

from kinweave import engine
from kinweave.__main__ import main
from kinweave.operators import retrieval

WORDS = "red blue green stone river hill north south bright silver golden cedar maple oak ocean star lion eagle falcon iron copper coral amber pearl".split()
HINDI = {"red": "रेड", "hill": "हिल", "star": "स्टार", "oak": "ओक", "lion": "लायन"}


def split(folder, name, n, seed):
    """Records of which each has a target with the same address, some of them misspelt, abroad or in another script, and strangers."""
    rng = random.Random(seed)
    rows, truth = {1: [], 2: [], 3: []}, []
    for i in range(n):
        country = ("India", "US")[i % 2]
        firm = rng.sample(WORDS, 3)
        where = f"{rng.randint(1, 900)} {rng.choice(WORDS)} {rng.choice(WORDS)} road"
        rows[1].append((f"S1-{i}", " ".join(firm).title() + " Ltd", where, country))
        for k in (2, 3):
            if rng.random() < 0.7:
                said = [HINDI.get(w, w) for w in firm] if country == "India" and k == 3 else firm[: 3 - (i % 7 == 0)]
                rows[k].append((f"S{k}-{i}", " ".join(said) + " Limited", where, country))
                truth.append((f"S1-{i}", f"S{k}-{i}"))
            else:
                rows[k].append((f"S{k}-{i}", " ".join(rng.sample(WORDS, 3)), f"{rng.randint(1, 900)} {rng.choice(WORDS)} lane", country))
    at = folder / name
    at.mkdir(parents=True)
    for k, r in rows.items():
        (at / f"{name}_source{k}.tsv").write_text("\n".join("\t".join(x) for x in [("entity_id", "business_name", "business_address", "country"), *r]) + "\n", encoding="utf-8")
    lists: dict[str, list[str]] = {}
    for a, b in truth:
        lists.setdefault(a, []).append(b)
    lines = ["source1_entity_id\tmatched_entity_ids", *(f"S1-{i}\t{','.join(lists.get(f'S1-{i}', []))}" for i in range(n))]
    (at / f"{name}_ground_truth.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return set(truth)


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("linkage")
    split(folder, "train", 120, 1)
    truth = split(folder, "test", 60, 2)
    s = engine.Settings(
        str(folder), str(folder / "work"), str(folder / "out"), rounds=2, depth=2,
        blocking=retrieval.Blocking(forward={"n": 3, "a": 3}, reverse={"n": 2}, features={}),
    )
    return s, truth, engine.run(spark, s)


def test_run(spark, linked):
    s, truth, wrong = linked
    assert wrong == []
    got = {tuple(r) for r in spark.read.parquet(s.at("test", "matches")).collect()}
    assert len(got & truth) / len(got) > 0.9 and len(got & truth) / len(truth) > 0.8
    lines = spark.read.option("sep", "\t").option("header", True).csv(f"{s.output}/matches").collect()
    assert sorted(r[0] for r in lines) == sorted(f"S1-{i}" for i in range(60))


def test_reports(spark, linked):
    s, _, _ = linked
    assert all(r["recall"] > 0.9 for r in engine.block_report(spark, s).collect())
    assert engine.diagnose(spark, s).agg({"n": "sum"}).first()[0] > 0


def test_learned_spelling(spark, linked):
    s, _, _ = linked
    assert {"रेड": "red"}.items() <= {r["tok"]: r["best"] for r in spark.read.parquet(s.at("spelling", "words")).collect()}.items()


@pytest.mark.parametrize("more", [["--rule", "threshold", "--no-generator"], ["--prior", "--gate", "narrow"]])
def test_command_line(spark, linked, more, tmp_path):
    s, truth, _ = linked
    folders = ["--data", s.data, "--work", s.work, "--output", str(tmp_path / "out")]
    assert main(["finish", *folders, *more]) == 0
    got = {tuple(r) for r in spark.read.parquet(s.at("test", "matches")).collect()}
    assert len(got & truth) / len(truth) > 0.7


def test_a_test_set_needs_a_training_set(spark, linked, tmp_path):
    s, _, _ = linked
    with pytest.raises(Exception, match="spelling"):
        engine.prepare(spark, engine.Settings(s.data, str(tmp_path), str(tmp_path)), "test")
