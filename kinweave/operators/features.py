"""Features of candidate pairs: normal forms of records, similarities, frequencies, changed words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import address, text
from kinweave.functions import words as W
from kinweave.functions.similarity import jaccard
from kinweave.functions.strings import similarity, token_set_ratio, unmatched_words
from kinweave.operators.pairs import fold

#: Fields of a normal record.
FIELDS = ("core", "compact", "parts", "legal", "initials", "indic", "addr", "words", "nums", "first", "state", "addr_empty")


def normal_records(e: DataFrame, states=None, spelt=None, spelt_word=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """country, k, entity_id, FIELDS and the columns ``keep`` of records (country, k, entity_id, name, address); functions for parts and words in Indic script."""
    n, a = text.normal_name(F.col("name"), spelt_word), address.normal_address(F.col("address"), F.col("country"), states, spelt)
    x = e.select("country", "k", "entity_id", *keep, n.alias("n"), a.alias("a"))
    return x.select("country", "k", "entity_id", *keep, "n.*", F.col("a.norm").alias("addr"), "a.words", "a.nums", "a.first", "a.state", F.col("a.empty").alias("addr_empty"))


def _set(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(c, " "), ""))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def paired(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (s1_id, tgt_id) with both records' fields, named a_* and b_*."""
    side = lambda i, x: records.select(F.col("entity_id").alias(i), *([F.col("country")] if x == "a" else []), *[F.col(f).alias(f"{x}_{f}") for f in FIELDS])
    return pairs.join(side("s1_id", "a"), "s1_id").join(side("tgt_id", "b"), "tgt_id")


def pair_features(p: DataFrame) -> DataFrame:
    """``p`` (as ``paired`` gives it) with the features of names, addresses and numbers; null where a side is missing.

    Sets, counts and flags are expressions; similarities of strings run in Arrow batches, each on the pairs where both sides are there.
    """
    a, b = (lambda f: F.col(f"a_{f}")), (lambda f: F.col(f"b_{f}"))
    named = (a("core") != "") & (b("core") != "")
    placed = (a("addr") != "") & (b("addr") != "")
    said = (a("words") != "") & (b("words") != "")
    on = lambda kind, f, where: F.round(similarity(kind, F.when(where, a(f)), F.when(where, b(f))), 6)
    ta, tb = F.array_remove(F.split(a("core"), " "), ""), F.array_remove(F.split(b("core"), " "), "")
    la, lb = _set(a("legal")), _set(b("legal"))
    na, nb = _set(a("nums")), _set(b("nums"))
    n_common = F.size(F.array_intersect(na, nb))
    short, long = F.least(F.length(a("core")), F.length(b("core"))), F.greatest(F.length(a("core")), F.length(b("core")))
    acronym = lambda x, y: (F.length(x("initials")) >= 2) & (x("initials") == y("compact"))
    both = lambda x: F.size(x) > 0
    f = {
        "n_ratio": on("ratio", "core", named), "n_partial": on("partial", "core", named), "n_tsort": on("tsort", "core", named),
        "n_tset": on("tset", "core", named), "n_jw": on("jw", "core", named), "c_ratio": on("ratio", "compact", named),
        "c_partial": on("partial", "compact", named), "c_jw": on("jw", "compact", named),
        "c_prefix": F.when(named, F.round(W.common_prefix(a("compact"), b("compact")), 6)),
        "tok_jacc": F.round(jaccard(F.array_distinct(ta), F.array_distinct(tb)), 6),
        "tok_soft_a": on("soft_a", "core", named), "tok_soft_b": on("soft_b", "core", named),
        "acro": _flag(acronym(a, b) | acronym(b, a)),
        "contain": _flag((F.least(F.length(a("compact")), F.length(b("compact"))) >= 4) & (a("compact").contains(b("compact")) | b("compact").contains(a("compact")))),
        "parts_best": F.when(named, best_part(a, b)),
        "legal_same": _flag(both(la) & (F.array_sort(la) == F.array_sort(lb))),
        "legal_conflict": _flag(both(la) & both(lb) & ~F.arrays_overlap(la, lb)),
        "legal_missing": _flag(both(la) != both(lb)),
        "n_tok_a": F.size(ta), "n_tok_b": F.size(tb), "len_ratio": F.when(named, F.round(short / long, 6)),
        "name_indic_b": _flag(b("indic")), "first_tok_eq": _flag(F.get(ta, F.lit(0)) == F.get(tb, F.lit(0))),
        "name_exact": _flag(named & (a("core") == b("core"))), "name_empty_b": _flag(b("core") == ""),
        "a_tset": on("tset", "addr", placed), "a_partial": on("partial", "addr", placed), "a_ratio": on("ratio", "addr", placed),
        "w_tset": on("tset", "words", said), "w_jacc": F.round(jaccard(_set(a("words")), _set(b("words"))), 6),
        "num_jacc": F.round(jaccard(na, nb), 6), "num_overlap": n_common, "num_b_in_a": F.when(both(nb), F.round(n_common / F.size(nb), 6)),
        **W.number_features(a("first"), b("first")),
        "state_eq": F.when((a("state") != "") & (b("state") != ""), (a("state") == b("state")).cast("int")),
        "addr_empty_a": _flag(a("addr_empty")), "addr_empty_b": _flag(b("addr_empty")),
        "n_addr_tok_a": F.size(F.array_remove(F.split(a("addr"), " "), "")), "n_addr_tok_b": F.size(F.array_remove(F.split(b("addr"), " "), "")),
    }
    return p.withColumns(f)


def best_part(a, b) -> Column:
    """The best token-set similarity of a name that one firm goes by to one of the other's."""
    best = similarity_of_parts(F.when(a("parts") != "", a("parts")).otherwise(a("core")), F.when(b("parts") != "", b("parts")).otherwise(b("core")))
    return F.round(best, 6)


def similarity_of_parts(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([max(token_set_ratio(s, t) for s in m.split("|") for t in n.split("|")) for m, n in zip(x, y)], dtype="float64")

    return run(a, b)


def idf_overlap(p: DataFrame, idf: DataFrame, default: float = 0.0) -> DataFrame:
    """s1_id, tgt_id, idf_overlap of pairs (with a_core, b_core): the idf of common words over that of all words of the two names."""
    both = p.where("a_core <> '' AND b_core <> ''").select("s1_id", "tgt_id", _set(F.col("a_core")).alias("x"), _set(F.col("b_core")).alias("y"))
    w = both.select("s1_id", "tgt_id", "x", "y", F.explode(F.array_union("x", "y")).alias("t")).join(idf.select("t", "idf"), "t", "left").withColumn("idf", F.coalesce("idf", F.lit(default)))
    common = F.when(F.array_contains("x", F.col("t")) & F.array_contains("y", F.col("t")), F.col("idf"))
    return w.groupBy("s1_id", "tgt_id").agg(F.round(F.coalesce(F.sum(common), F.lit(0.0)) / F.sum("idf"), 6).alias("idf_overlap"))


def name_idf(records: DataFrame) -> DataFrame:
    """t, idf of the words of all names: ln((1 + n) / (1 + records with the word)) + 1."""
    n = records.agg(F.count("*")).scalar()
    df = records.select(F.explode(_set(F.col("core"))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    return df.select("t", F.round(F.ln((1 + n) / (1 + F.col("df"))) + 1, 9).alias("idf"))


def frequencies(p: DataFrame, records: DataFrame) -> DataFrame:
    """``p`` with how many reference records of the country have a's name (s1_freq_a) or b's (s1_freq_b), and how many targets b's (tgt_freq_b)."""
    n = lambda where, core, name: records.where(where).groupBy("country", F.col("core").alias(core)).agg(F.count("*").alias(name))
    for where, core, name in (("k = 1", "a_core", "s1_freq_a"), ("k = 1", "b_core", "s1_freq_b"), ("k > 1", "b_core", "tgt_freq_b")):
        p = p.join(n(where, core, name), ["country", core], "left")
    return p.fillna(0, ["s1_freq_a", "s1_freq_b", "tgt_freq_b"])


def labelled(p: DataFrame, truth: DataFrame) -> DataFrame:
    """``p`` with label (1 for true pairs) and the reference record's fold."""
    t = truth.select("s1_id", "tgt_id").distinct().withColumn("label", F.lit(1))
    return p.join(t, ["s1_id", "tgt_id"], "left").fillna(0, ["label"]).withColumn("fold", fold(F.col("s1_id")))


def changed_words(p: DataFrame, stats: DataFrame) -> DataFrame:
    """s1_id, tgt_id and ten tc_ columns of pairs (country, a_core, b_core): how many words of each side lack a counterpart (tc_n_), how many of them
    are category words (tc_c_), and the least and greatest f and greatest share of them. stats: as ``pairs.token_stats`` has them."""
    u = p.select("s1_id", "tgt_id", "country", unmatched_words(F.col("a_core"), F.col("b_core")).alias("u"))
    out = u.select("s1_id", "tgt_id")
    both = u.select("s1_id", "tgt_id", "country", F.explode(F.array(F.struct(F.lit("ua").alias("side"), F.col("u.a").alias("ws")), F.struct(F.lit("ub").alias("side"), F.col("u.b").alias("ws")))).alias("z"))
    w = both.select("s1_id", "tgt_id", "country", "z.side", F.explode("z.ws").alias("t")).join(stats.select("country", "t", "share1", "f", "cat"), ["country", "t"], "left")
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    aggs = []
    for s in ("ua", "ub"):
        aggs += [F.count_if(F.col("side") == s).alias(f"tc_n_{s}"), F.count_if((F.col("side") == s) & F.coalesce("cat", F.lit(False))).alias(f"tc_c_{s}")]
        aggs += [F.min(of(s, "f")).alias(f"tc_fmin_{s}"), F.max(of(s, "f")).alias(f"tc_fmax_{s}"), F.max(of(s, "share1")).alias(f"tc_share_{s}")]
    g = w.groupBy("s1_id", "tgt_id").agg(*aggs)
    return out.join(g, ["s1_id", "tgt_id"], "left").fillna(0, ["tc_n_ua", "tc_n_ub", "tc_c_ua", "tc_c_ub"])
