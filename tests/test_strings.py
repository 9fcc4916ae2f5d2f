"""Kernels against plain versions, and normalisation on cases of our own."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import address, strings, text


def plain_lcs(a, b):
    t = {(i, j): 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return t[len(a), len(b)]


def some(rng, n=9):
    return "".join(rng.choice("abc ") for _ in range(rng.randrange(n)))


def test_lcs_and_scripts():
    rng = random.Random(1)
    for _ in range(400):
        a, b = some(rng), some(rng)
        assert strings.lcs(a, b) == plain_lcs(a, b)
        out, done = [], 0
        script = strings.edit_script(a, b)
        for kind, i, j in script:
            out += a[done:i]
            done = i + (kind != "insert")
            out += b[j] if kind != "delete" else ""
        assert "".join(out + list(a[done:])) == b
        assert len(script) == strings_distance(a, b)
        short, long = sorted((a, b), key=len)
        if short:
            windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
            assert strings.partial_ratio(a, b) == max(strings.ratio(short, w) for w in windows)


def strings_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, row[j] + 1, row[j - 1] + (c != b[j - 1])), initial=i))
    return row[-1]


def test_known_values():
    assert round(strings.jaro_winkler("martha", "marhta"), 4) == 0.9611 and strings.jaro_winkler("", "a") == 0
    assert strings.jaro_winkler("a", "a") == 1 and strings.jaro_winkler("a", "b") == 0  # single letters
    assert strings.token_set_ratio("red fox", "fox red jumps") == 1 and strings.token_set_ratio("", "a") == 0
    assert strings.token_sort_ratio("b a", "a b") == 1 and strings.partial_ratio("abc", "xxabcxx") == 1
    assert strings.unmatched("green garden group", "green gardn union") == (["group"], ["union"])
    assert strings.soft_share("martha x", "marhta") == 0.5 and strings.soft_share("", "a") is None


@pytest.mark.parametrize(
    ("raw", "core", "legal", "parts"),
    [
        ("Blue + Lake  Dairies [LLP]", "blue lake dairies", "llp", ""),
        ("Ĝarden 5upply Ltd", "garden supply", "ltd", ""),
        ("M/s Orchid Private Límited", "orchid", "ltd pvt", ""),
        ("RIVER TOOLS, - 5176446196", "river tools", "", ""),
        ("WWW.HILLTOP-FARM.FR", "hilltop farm", "", ""),
        ("Nova d/b/a House of Tea LLC", "nova house tea", "llc", "nova|house tea"),
        ("Tea Tea Co", "tea", "co", ""),
        ("", "", "", ""),
        (None, "", "", ""),
    ],
)
def test_names(spark, raw, core, legal, parts):
    r = spark.createDataFrame([(raw,)], "raw string").select(text.normal_name(F.col("raw")).alias("n")).first()["n"]
    assert (r["core"], r["legal"], r["parts"]) == (core, legal, parts) and r["compact"] == core.replace(" ", "")


@pytest.mark.parametrize(
    ("raw", "country", "norm", "state", "first", "words"),
    [
        ("0412 Mill Avenue, PMB 7, Salem, OREGON", "US", "412 mill ave salem or", "or", "412", "mill salem"),
        ("Third Street", "US", "3 st", "", "3", ""),
        ("H.NO. ##12, Lake Road, Uttar Pradesh", "India", "12 lake rd up", "up", "12", "lake"),
        ("9 r. Haute, Gironde", "France", "9 rue haute naq", "naq", "9", "haute"),
        ("5 Platz, Bayern", "Germany", "5 platz bayern", "", "5", "platz bayern"),
        ("<NULL>", "US", "", "", "", ""),
        (None, "US", "", "", "", ""),
    ],
)
def test_addresses(spark, raw, country, norm, state, first, words):
    r = spark.createDataFrame([(raw, country)], "raw string, c string").select(address.normal_address(F.col("raw"), F.col("c")).alias("a")).first()["a"]
    assert (r["norm"], r["state"], r["first"], r["words"], r["empty"]) == (norm, state, first, words, not norm)
