"""Word and number rules on candidate pairs (s1_id, tgt_id, country, na, nb, a_sim, nf_eq, ...), every threshold a parameter.

``na`` and ``nb`` are the two names, ``a_sim`` the similarity of the addresses and ``nf_eq`` whether their first numbers
are equal (null: unknown, which counts as neither).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.strings import similarity, unmatched_words
from kinweave.functions.words import is_abbreviation, number_relation, subsequence
from kinweave.operators.pairs import boost, exclude
from kinweave.operators.spelling import most_often

SAME = "a_sim >= 0.95 AND nf_eq = 1"
NEIGHBOUR = "a_sim >= 0.8 AND nf_eq = 0"
SAME_PLACE = "a_sim >= 0.95 AND (nf_eq = 1 OR nf_eq IS NULL)"


def _words(name: str) -> Column:
    return F.array_remove(F.split(name, " "), "")


def edits(x: DataFrame) -> DataFrame:
    """``x`` with ``added`` and ``dropped``: distinct words that only the target's or only the reference's name has."""
    return x.withColumns({"added": F.array_except(_words("nb"), _words("na")), "dropped": F.array_except(_words("na"), _words("nb"))})


def one_word_additions(x: DataFrame) -> DataFrame:
    """Pairs whose names differ by one added word, ``w``."""
    return edits(x).where("size(added) = 1 AND size(dropped) = 0").withColumn("w", F.get("added", F.lit(0)))


def one_word_swaps(x: DataFrame) -> DataFrame:
    """Pairs whose names differ by one word for another, ``w_from`` for ``w_to``."""
    return edits(x).where("size(added) = 1 AND size(dropped) = 1").withColumns({"w_from": F.get("dropped", F.lit(0)), "w_to": F.get("added", F.lit(0))})


def addition_counts(x: DataFrame) -> DataFrame:
    """country, w, d, s, llr of each added word: pairs next door, pairs at one address, and the log of their ratio."""
    counts = one_word_additions(x).groupBy("country", "w").agg(F.count_if(F.expr(NEIGHBOUR)).alias("d"), F.count_if(F.expr(SAME)).alias("s"))
    return counts.withColumn("llr", F.round(F.ln((F.col("d") + 1) / (F.col("s") + 1)), 6))


def _of_words(x: DataFrame, words: DataFrame, at: str) -> DataFrame:
    return one_word_additions(x).where(at).join(words.select("country", "w"), ["country", "w"]).select("s1_id", "tgt_id")


def decoy_word_pairs(x: DataFrame, min_d: int = 1000, min_llr: float = 3.5) -> DataFrame:
    """Pairs with other numbers that differ by a word which mostly tells neighbours apart."""
    return _of_words(x, addition_counts(x).where((F.col("d") >= min_d) & (F.col("llr") >= min_llr)), "nf_eq = 0")


def noise_addition_pairs(x: DataFrame, min_s: int = 1000, max_llr: float = -1.0) -> DataFrame:
    """Pairs at one address that differ by a word which mostly means nothing."""
    return _of_words(x, addition_counts(x).where((F.col("s") >= min_s) & (F.col("llr") <= max_llr)), SAME)


def noise_share(x: DataFrame, min_d: int = 5000) -> DataFrame:
    """country, w, d, s, ns: 1 - r0 d / s, with r0 the country's median of s / d over words of ``min_d`` neighbours or more; null where a country
    has no such word."""
    c = addition_counts(x)
    r0 = c.where(F.col("d") >= min_d).groupBy("country").agg(F.percentile(F.try_divide(F.col("s"), F.col("d")), 0.5).alias("r0"))
    ns = F.when(F.col("s") > 0, F.round(1 - F.col("r0") * F.col("d") / F.col("s"), 6))
    return c.join(r0, "country", "left").select("country", "w", "d", "s", "r0", ns.alias("ns"))


def noise_suffixes(x: DataFrame, min_s: int = 500, min_ns: float = 0.8, min_d: int = 5000) -> DataFrame:
    """country, w, ns of words that are noise: at one address far more often than next door; without a country's r0 every word is."""
    ns = F.when(F.col("s") > 0, F.round(1 - F.coalesce("r0", F.lit(0.0)) * F.col("d") / F.col("s"), 6))
    return noise_share(x, min_d).where(F.col("s") >= min_s).select("country", "w", ns.alias("ns")).where(F.col("ns") >= min_ns)


def _accepted(p: DataFrame, accepted: DataFrame) -> DataFrame:
    """``p`` with ``acc``: 1 if the pair is among the accepted ones."""
    a = accepted.select("s1_id", "tgt_id").distinct().withColumn("acc", F.lit(1))
    return p.join(a, ["s1_id", "tgt_id"], "left").fillna(0, ["acc"])


def dual_use_pairs(x: DataFrame, accepted: DataFrame, min_d: int = 1000, min_ns: float = 0.8, less: float = 0.3, min_share_d: int = 5000) -> DataFrame:
    """Pairs at one address with an added word that tells neighbours apart too, and which are accepted less often than it is noise."""
    at = _accepted(one_word_additions(x).where(SAME), accepted)
    words = noise_share(x, min_share_d).join(at.groupBy("country", "w").agg(F.avg("acc").alias("rate")), ["country", "w"])
    words = words.where((F.col("d") >= min_d) & (F.col("ns") >= min_ns) & (F.col("rate") < F.col("ns") - less))
    return at.join(words.select("country", "w"), ["country", "w"]).select("s1_id", "tgt_id").distinct()


def abbreviation_pairs(x: DataFrame, accepted: DataFrame, max_rate: float = 0.5, min_reverse: float = 0.9, min_n: int = 100) -> DataFrame:
    """Pairs at one address that swap a word for its abbreviation (or back), where that way is seldom accepted and the other mostly is."""
    short = is_abbreviation(F.col("w_from"), F.col("w_to")) | is_abbreviation(F.col("w_to"), F.col("w_from"))
    sw = _accepted(one_word_swaps(x).where(SAME).where(short), accepted)
    g = sw.groupBy("country", "w_from", "w_to").agg(F.count("*").alias("n"), F.avg("acc").alias("r"))
    back = g.select("country", F.col("w_to").alias("w_from"), F.col("w_from").alias("w_to"), F.col("n").alias("n_rev"), F.col("r").alias("r_rev"))
    kept = g.join(back, ["country", "w_from", "w_to"]).where((F.col("r") < max_rate) & (F.col("r_rev") >= min_reverse) & (F.col("n_rev") >= min_n))
    return sw.join(kept.select("country", "w_from", "w_to"), ["country", "w_from", "w_to"]).select("s1_id", "tgt_id")


def suffix_swaps(x: DataFrame, accepted: DataFrame, suffixes: DataFrame, min_n: int = 200, less: float = 0.05) -> DataFrame:
    """Pairs at one place that swap a word for a noise suffix, of suffixes that swaps are accepted less often for than they are noise."""
    sw = _accepted(one_word_swaps(x).where(SAME_PLACE).withColumnRenamed("w_to", "w").join(suffixes, ["country", "w"]), accepted)
    g = sw.groupBy("country", "w").agg(F.count("*").alias("n"), F.avg("acc").alias("rate"), F.first("ns").alias("ns"))
    kept = g.where((F.col("n") >= min_n) & (F.col("rate") < F.col("ns") - less)).select("country", "w")
    return sw.join(kept, ["country", "w"]).select("s1_id", "tgt_id")


def top_claimant(pairs: DataFrame, scores: DataFrame, score: str) -> DataFrame:
    """Pairs whose reference record is its target's best claimant; ties by s1_id."""
    best = F.row_number().over(Window.partitionBy("tgt_id").orderBy(F.desc(score), "s1_id"))
    return pairs.join(scores.withColumn("rk", best).where("rk = 1").select("s1_id", "tgt_id"), ["s1_id", "tgt_id"])


def category_swaps(x: DataFrame, stats: DataFrame, min_df: int = 500, max_f: float = 0.3) -> DataFrame:
    """Pairs of names of two words or more that differ by one word for another, both of them category words of the country: in ``min_df``
    reference records or more, and f below ``max_f``. Words under three letters, of one beginning, or one within the other don't count."""
    u = x.select("s1_id", "tgt_id", "country", "na", "nb", unmatched_words(F.col("na"), F.col("nb")).alias("u"))
    u = u.where((F.size(_words("na")) >= 2) & (F.size(_words("nb")) >= 2) & (F.size("u.a") == 1) & (F.size("u.b") == 1))
    u = u.select("s1_id", "tgt_id", "country", F.get("u.a", F.lit(0)).alias("wa"), F.get("u.b", F.lit(0)).alias("wb"))
    inside = subsequence(F.col("wa"), F.col("wb")) | subsequence(F.col("wb"), F.col("wa"))
    u = u.where((F.length("wa") >= 3) & (F.length("wb") >= 3) & (F.substring("wa", 1, 2) != F.substring("wb", 1, 2)) & ~inside)
    known = stats.where((F.col("df1") >= min_df) & (F.col("f") < max_f)).select("country", "t")
    for w in ("wa", "wb"):
        u = u.join(known.withColumnRenamed("t", w), ["country", w], "left_semi")
    return u.select("s1_id", "tgt_id")


def gated_countries(x: DataFrame, max_ratio: float = 0.05) -> DataFrame:
    """country, typo, neigh of countries whose equal names in one street show hardly any mistyped number: a digit more or less and over 20
    apart, against numbers next door. x: fa, fb (first numbers), and n_ua, n_ub (words without a counterpart)."""
    rel = number_relation(F.col("fa"), F.col("fb"))
    far = F.abs(F.col("fa").try_cast("decimal(38,0)") - F.col("fb").try_cast("decimal(38,0)")) > 20
    y = x.where(f"{NEIGHBOUR} AND n_ua = 0 AND n_ub = 0").select("country", rel.alias("rel"), far.alias("far"))
    g = y.groupBy("country").agg(F.count_if((F.col("rel") == "indel") & F.col("far")).alias("typo"), F.count_if(F.col("rel").isin("sub", "near<=4", "near<=20")).alias("neigh"))
    return g.where(F.try_divide(F.col("typo"), F.col("neigh")) < max_ratio)


def number_gate(x: DataFrame, countries: DataFrame) -> DataFrame:
    """Pairs of gated countries whose addresses share no number. x: num_overlap, num_jacc (null: one has none)."""
    return x.where("nf_eq = 0 AND num_overlap = 0 AND num_jacc IS NOT NULL").join(countries.select("country"), "country", "left_semi").select("s1_id", "tgt_id").distinct()


def still_gated(gated: DataFrame, x: DataFrame, mode: str = "narrow") -> DataFrame:
    """What stays gated: narrow releases unrelated numbers and a digit more or less, open all; conflicting legal forms always stay."""
    y = gated.join(x.select("s1_id", "tgt_id", "fa", "fb", "legal_conflict"), ["s1_id", "tgt_id"])
    stays = F.col("legal_conflict") == 1
    if mode == "narrow":
        stays = stays | ~number_relation(F.col("fa"), F.col("fb")).isin("far", "indel")
    return y.where(stays).select("s1_id", "tgt_id")


def chain(scores: DataFrame, x: DataFrame, exclusions: DataFrame, noise: DataFrame, dual, abbreviated, swapped, decide, last=None) -> DataFrame:
    """s1_id, tgt_id accepted after three passes over scores (s1_id, tgt_id, p).

    Excluded pairs score 0 and no boost lifts them. Noise additions are lifted, and decided; dual uses and abbreviations, judged by what was
    accepted, are lifted too, and decided; then suffix swaps of a target's best claimant by the first scores, judged likewise. ``dual``,
    ``abbreviated`` and ``swapped`` take the accepted pairs, ``decide`` scored pairs; ``last`` is the last decision if another.
    """
    out = exclusions.select("s1_id", "tgt_id").distinct()
    lifted = lambda *parts: reduce(DataFrame.unionByName, [p.select("s1_id", "tgt_id") for p in parts]).distinct().join(out, ["s1_id", "tgt_id"], "left_anti")
    base = exclude(scores.select("s1_id", "tgt_id", "p"), out, "p")
    one = decide(boost(base, lifted(noise), "p"))
    second = lifted(noise, dual(one), abbreviated(one))
    two = decide(boost(base, second, "p"))
    third = lifted(second, top_claimant(swapped(two), scores, "p"))
    return (last or decide)(boost(base, third, "p")).select("s1_id", "tgt_id")


def decoy_vocabulary(x: DataFrame, min_n: int = 300, max_true: float = 0.01) -> DataFrame:
    """country, w, n: words of ``min_n`` additions or more that are true less often than ``max_true`` (``label`` 0 or 1)."""
    g = one_word_additions(x).groupBy("country", "w").agg(F.count("*").alias("n"), F.avg("label").alias("share"))
    return g.where((F.col("n") >= min_n) & (F.col("share") < max_true)).select("country", "w", "n")


def vocabulary_pairs(x: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Pairs that add a word of the vocabulary and drop one word at most."""
    added = edits(x).where("size(dropped) <= 1").select("s1_id", "tgt_id", "country", F.explode("added").alias("w"))
    return added.join(vocabulary.select("country", "w"), ["country", "w"], "left_semi").select("s1_id", "tgt_id").distinct()


def refined_swaps(x: DataFrame, min_added: int = 200, times: float = 5.0) -> DataFrame:
    """One-word swaps without those into words added ``min_added`` times or more and ``times`` as often as dropped."""
    n = lambda c, name: edits(x).select("country", F.explode(c).alias("w_to")).groupBy("country", "w_to").agg(F.count("*").alias(name))
    free = n("added", "na_").join(n("dropped", "nd_"), ["country", "w_to"], "left").fillna(0, ["nd_"]).where((F.col("na_") >= min_added) & (F.col("na_") >= times * F.col("nd_")))
    return one_word_swaps(x).join(free, ["country", "w_to"], "left_anti").select("s1_id", "tgt_id", "w_from", "w_to")


def token_map(pairs: DataFrame, min_count: int = 2, min_share: float = 0.5) -> DataFrame:
    """tok, best, n: for each word of ``nb`` the word that most often stands at its place in ``na``, names of equally many
    words alone; with ``min_count`` cases or more, and ``min_share`` of the word's. Ties by the word."""
    at = pairs.where(F.size(_words("na")) == F.size(_words("nb"))).select(F.explode(F.arrays_zip(_words("nb").alias("tok"), _words("na").alias("best"))).alias("z")).select("z.tok", "z.best")
    return most_often(at, min_count, min_share)


def same_address_pairs(s1: DataFrame, tg: DataFrame, known: DataFrame, most: int = 600) -> DataFrame:
    """s1_id, tgt_id, a_sim of pairs with equal country, name and first number that are not ``known``; groups of (country,
    name) with over ``most`` targets are left out, empty addresses too. Records: country, entity_id, name, addr, number."""
    group = tg.groupBy("country", "name").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("country", "name")
    t = tg.where("addr <> ''").join(group, ["country", "name"]).select("country", "name", "number", F.col("entity_id").alias("tgt_id"), F.col("addr").alias("ab"))
    s = s1.where("addr <> '' AND name <> ''").select("country", "name", "number", F.col("entity_id").alias("s1_id"), F.col("addr").alias("aa"))
    x = s.join(t, ["country", "name", "number"]).join(known.select("s1_id", "tgt_id"), ["s1_id", "tgt_id"], "left_anti")
    return x.select("s1_id", "tgt_id", F.round(similarity("tset", F.col("aa"), F.col("ab")), 6).alias("a_sim"))


def recovered(x: DataFrame, matched: DataFrame, floor: float = 0.999) -> DataFrame:
    """Pairs of ``x`` at ``floor`` or more whose target has this one claimant and is not ``matched``."""
    n = F.count("*").over(Window.partitionBy("tgt_id"))
    alone = x.where(F.col("a_sim") >= floor).withColumn("n", n).where("n = 1")
    return alone.join(matched.select("tgt_id"), "tgt_id", "left_anti").select("s1_id", "tgt_id")
