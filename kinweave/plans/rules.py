"""Registered queries of the word and number rules, thresholds, recovery and the cardinality prior, each with its SQL.

Rules run on the variants of the documents table (``entities.variants``), which have every kind of difference; thresholds are small, as it is.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.functions import words as W
from kinweave.functions.similarity import jaccard
from kinweave.functions.strings import similarity, unmatched_words
from kinweave.operators import cardinality, decide, pairs, rawform, rules
from kinweave.plans import registry
from kinweave.plans.registry import scored, truth
from kinweave.plans.sql import ENTITY, PAIRS, RULES, VARIANTS, WORDS, token_set
from kinweave.sources import entities as src
from kinweave.sources import work

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return put


def _set(c):
    return F.array_distinct(F.array_remove(F.split(c, " "), ""))


def x(spark, d):
    """The variants with what the rules read."""

    def build():
        v = src.variants(spark, d)
        placed = (F.col("a_addr") != "") & (F.col("b_addr") != "")
        na, nb = _set("a_nums"), _set("b_nums")
        u = unmatched_words(F.col("a_core"), F.col("b_core"))
        v = v.withColumns(
            {
                "a_sim": F.round(similarity("tset", F.when(placed, F.col("a_addr")), F.when(placed, F.col("b_addr"))), 6),
                "nf_eq": W.number_features(F.col("a_first"), F.col("b_first"))["nf_eq"],
                "num_overlap": F.size(F.array_intersect(na, nb)),
                "num_jacc": F.round(jaccard(na, nb), 6),
                "legal_conflict": ((F.col("a_legal") != "") & (F.col("b_legal") != "") & ~F.arrays_overlap(_set("a_legal"), _set("b_legal"))).cast("int"),
                "u": u,
            }
        )
        return v.withColumns({"n_ua": F.size("u.a"), "n_ub": F.size("u.b")}).drop("u").withColumnsRenamed({"a_core": "na", "b_core": "nb", "a_first": "fa", "b_first": "fb"})

    return work.once(spark, "rules", d, build)


def _joined(c):
    return F.array_join(F.array_sort(c), " ").alias(c)


# ---- differences

query("rule_edits", f"{RULES} SELECT s1_id, tgt_id, array_to_string(added, ' ') AS added, array_to_string(dropped, ' ') AS dropped FROM x")(lambda s, d: rules.edits(x(s, d)).select("s1_id", "tgt_id", _joined("added"), _joined("dropped")))
query("rule_one_word_additions", f"{RULES} SELECT s1_id, tgt_id, w FROM adds")(lambda s, d: rules.one_word_additions(x(s, d)).select("s1_id", "tgt_id", "w"))
query("rule_one_word_swaps", f"{RULES} SELECT s1_id, tgt_id, w_from, w_to FROM swaps")(lambda s, d: rules.one_word_swaps(x(s, d)).select("s1_id", "tgt_id", "w_from", "w_to"))

_REL = """CASE WHEN {a} = '' OR {b} = '' THEN 'na' WHEN {a} = {b} THEN 'eq' WHEN levenshtein({a}, {b}) = 1 AND length({a}) <> length({b}) THEN 'indel' WHEN levenshtein({a}, {b}) = 1 THEN 'sub'
 WHEN length({a}) = length({b}) AND len(list_filter(range(1, length({a})), lambda i: substr({a}, 1, i - 1) || substr({a}, i + 1, 1) || substr({a}, i, 1) || substr({a}, i + 2) = {b})) > 0 THEN 'transpose'
 WHEN abs(nullif({a}, '')::HUGEINT - nullif({b}, '')::HUGEINT) <= 4 THEN 'near<=4' WHEN abs(nullif({a}, '')::HUGEINT - nullif({b}, '')::HUGEINT) <= 20 THEN 'near<=20' ELSE 'far' END"""
REL = _REL.format(a="a_first", b="b_first")


@query("rule_number_relation", f"{RULES} SELECT s1_id, tgt_id, {REL} AS rel FROM x")
def rule_number_relation(s, d):
    return x(s, d).select("s1_id", "tgt_id", W.number_relation(F.col("fa"), F.col("fb")).alias("rel"))


_SHORT = """(length({a}) BETWEEN 1 AND 5 AND length({a}) < length({b}) AND substr({a}, 1, 1) = substr({b}, 1, 1)
 AND list_reduce(range(1, length({b}) + 1), lambda i, j: CASE WHEN i < length({a}) AND substr({a}, i + 1, 1) = substr({b}, j, 1) THEN i + 1 ELSE i END, 0::BIGINT) = length({a}))"""
SHORTER, LONGER = _SHORT.format(a="w_from", b="w_to"), _SHORT.format(a="w_to", b="w_from")


@query("rule_abbreviation", f"{RULES} SELECT s1_id, tgt_id, {SHORTER} AS shorter, {LONGER} AS longer FROM swaps")
def rule_abbreviation(s, d):
    sw = rules.one_word_swaps(x(s, d))
    return sw.select("s1_id", "tgt_id", W.is_abbreviation(F.col("w_from"), F.col("w_to")).alias("shorter"), W.is_abbreviation(F.col("w_to"), F.col("w_from")).alias("longer"))


# ---- exclusions

query("rule_addition_counts", f"{RULES} SELECT * FROM ac")(lambda s, d: rules.addition_counts(x(s, d)))
query("rule_decoy_word", f"{RULES} SELECT s1_id, tgt_id FROM adds JOIN ac USING (country, w) WHERE d >= 2 AND llr >= 0.5 AND nf_eq = 0")(lambda s, d: rules.decoy_word_pairs(x(s, d), 2, 0.5))
VOCAB = "(SELECT country, w, count(*) AS n FROM adds GROUP BY ALL HAVING count(*) >= 2 AND avg(label) < 0.3)"
query("rule_decoy_vocabulary", f"{RULES} SELECT * FROM {VOCAB}")(lambda s, d: rules.decoy_vocabulary(x(s, d), 2, 0.3))
_VPAIRS = f"SELECT DISTINCT s1_id, tgt_id FROM (SELECT *, unnest(added) AS w FROM x WHERE len(dropped) <= 1) SEMI JOIN {VOCAB} v USING (country, w)"
query("rule_vocabulary_pairs", f"{RULES} {_VPAIRS}")(lambda s, d: rules.vocabulary_pairs(x(s, d), rules.decoy_vocabulary(x(s, d), 2, 0.3)))


@query(
    "rule_refined_swap",
    f"""{RULES}, fr AS (
 SELECT country, w AS w_to FROM (SELECT country, w, count(*) AS n FROM (SELECT country, unnest(added) AS w FROM x) GROUP BY ALL)
 LEFT JOIN (SELECT country, w, count(*) AS m FROM (SELECT country, unnest(dropped) AS w FROM x) GROUP BY ALL) USING (country, w) WHERE n >= 20 AND n >= 2.5 * coalesce(m, 0))
SELECT s1_id, tgt_id, w_from, w_to FROM swaps ANTI JOIN fr USING (country, w_to)""",
)
def rule_refined_swap(s, d):
    return rules.refined_swaps(x(s, d), 20, 2.5)


_GATED = f"""(SELECT country, count(*) FILTER (WHERE rel = 'indel' AND far) AS typo, count(*) FILTER (WHERE rel IN ('sub', 'near<=4', 'near<=20')) AS neigh
 FROM (SELECT country, {REL} AS rel, abs(a_first::HUGEINT - b_first::HUGEINT) > 20 AS far FROM x WHERE a_sim >= 0.8 AND nf_eq = 0 AND a_core = b_core) GROUP BY country
 HAVING count(*) FILTER (WHERE rel = 'indel' AND far) < 10 * count(*) FILTER (WHERE rel IN ('sub', 'near<=4', 'near<=20')))"""


def _equal_names(s, d):
    """Variants of equal names alone: the SQL has no words without counterparts."""
    return x(s, d).where("na = nb")


query("rule_gated_countries", f"{RULES} SELECT * FROM {_GATED}")(lambda s, d: rules.gated_countries(_equal_names(s, d), 10.0))
_NUMS = f"list_distinct({WORDS.format('a_nums')})", f"list_distinct({WORDS.format('b_nums')})"
_GATE = f"SELECT DISTINCT s1_id, tgt_id FROM x SEMI JOIN {_GATED} g USING (country) WHERE nf_eq = 0 AND len(list_intersect({_NUMS[0]}, {_NUMS[1]})) = 0"
query("rule_number_gate", f"{RULES} {_GATE}")(lambda s, d: rules.number_gate(x(s, d), rules.gated_countries(_equal_names(s, d), 10.0)))
_LEGAL = f"list_distinct({WORDS.format('a_legal')})", f"list_distinct({WORDS.format('b_legal')})"
CONFLICT = f"(len({_LEGAL[0]}) > 0 AND len({_LEGAL[1]}) > 0 AND len(list_intersect({_LEGAL[0]}, {_LEGAL[1]})) = 0)"


def _gate(s, d):
    return rules.number_gate(x(s, d), rules.gated_countries(_equal_names(s, d), 10.0))


for _mode, _stays in (("narrow", f"{REL} NOT IN ('far', 'indel') OR {CONFLICT}"), ("open", CONFLICT)):
    query(f"rule_still_gated_{_mode}", f"{RULES} SELECT s1_id, tgt_id FROM x SEMI JOIN ({_GATE}) g USING (s1_id, tgt_id) WHERE {_stays}")(lambda s, d, mode=_mode: rules.still_gated(_gate(s, d), x(s, d), mode))


@query("rule_category_swap")
def rule_category_swap(s, d):
    v = x(s, d)
    stats = pairs.token_stats(v.select("country", F.col("na").alias("name")), v.select("country", F.col("nb").alias("name")), 0.0, 9.0)
    return rules.category_swaps(v, stats, 1, 9.0)


# ---- boosts

query("rule_noise_addition", f"{RULES} SELECT s1_id, tgt_id FROM adds JOIN ac USING (country, w) WHERE s >= 1 AND llr <= 1.5 AND a_sim >= 0.95 AND nf_eq = 1")(lambda s, d: rules.noise_addition_pairs(x(s, d), 1, 1.5))
SHARE = """, r0 AS (SELECT country, median(s::DOUBLE / d) AS r0 FROM ac WHERE d >= 5 GROUP BY country),
share AS (SELECT country, w, d, s, r0, CASE WHEN s > 0 THEN round(1 - r0 * d / s, 6) END AS ns FROM ac LEFT JOIN r0 USING (country)),
suffix AS (SELECT country, w, round(1 - coalesce(r0, 0) * d / s, 6) AS ns FROM share WHERE s >= 1 AND round(1 - coalesce(r0, 0) * d / s, 6) >= -9),
acc AS (SELECT s1_id, tgt_id FROM x WHERE p >= 0.6)"""
query("rule_noise_share", f"{RULES}{SHARE} SELECT country, w, d, s, r0, ns FROM share")(lambda s, d: rules.noise_share(x(s, d), 5))
query("rule_noise_suffixes", f"{RULES}{SHARE} SELECT * FROM suffix")(lambda s, d: rules.noise_suffixes(x(s, d), 1, -9.0, 5))


def _accepted(s, d):
    return x(s, d).where("p >= 0.6").select("s1_id", "tgt_id")


@query(
    "rule_dual_use",
    f"""{RULES}{SHARE}, st AS (SELECT country, w, avg((acc.s1_id IS NOT NULL)::INT) AS rate FROM adds LEFT JOIN acc USING (s1_id, tgt_id) WHERE a_sim >= 0.95 AND nf_eq = 1 GROUP BY ALL)
SELECT DISTINCT s1_id, tgt_id FROM adds JOIN share USING (country, w) JOIN st USING (country, w) WHERE a_sim >= 0.95 AND nf_eq = 1 AND d >= 2 AND ns >= -9 AND rate < ns + 9""",
)
def rule_dual_use(s, d):
    return rules.dual_use_pairs(x(s, d), _accepted(s, d), 2, -9.0, -9.0, 5)


_TURNED = """SELECT s1_id, tgt_id, country, a_sim, nf_eq, w_from, w_to, p FROM swaps
 UNION ALL SELECT 'R' || s1_id, tgt_id, country, a_sim, nf_eq, w_to, w_from, 1 - p FROM swaps"""


@query(
    "rule_abbreviation_pairs",
    f"""{RULES}, tw AS ({_TURNED}), sw AS (SELECT *, (p >= 0.6)::INT AS acc FROM tw WHERE a_sim >= 0.95 AND nf_eq = 1 AND ({SHORTER} OR {LONGER})),
g AS (SELECT country, w_from, w_to, count(*) AS n, avg(acc) AS r FROM sw GROUP BY ALL),
sel AS (SELECT a.country, a.w_from, a.w_to FROM g a JOIN g b ON a.country = b.country AND a.w_from = b.w_to AND a.w_to = b.w_from WHERE a.r < 0.5 AND b.r >= 0.5 AND b.n >= 1)
SELECT s1_id, tgt_id FROM sw JOIN sel USING (country, w_from, w_to)""",
)
def rule_abbreviation_pairs(s, d):
    """The variants shorten only; so that both ways occur, each swap is taken turned round too."""
    v = x(s, d).select("s1_id", "tgt_id", "country", "a_sim", "nf_eq", "na", "nb", "p")
    back = v.select(F.concat(F.lit("R"), "s1_id").alias("s1_id"), "tgt_id", "country", "a_sim", "nf_eq", F.col("nb").alias("na"), F.col("na").alias("nb"), (1 - F.col("p")).alias("p"))
    both = v.unionByName(back)
    return rules.abbreviation_pairs(both, both.where("p >= 0.6"), 0.5, 0.5, 1)


_SWAPPED = """sw AS (SELECT s.*, ns, (acc.s1_id IS NOT NULL)::INT AS acc FROM swaps s JOIN suffix f ON f.country = s.country AND f.w = s.w_to LEFT JOIN acc ON acc.s1_id = s.s1_id AND acc.tgt_id = s.tgt_id
 WHERE a_sim >= 0.95 AND (nf_eq = 1 OR nf_eq IS NULL)),
sel AS (SELECT country, w_to FROM sw GROUP BY ALL HAVING count(*) >= 1 AND avg(acc) < first(ns) + 9),
swapped AS (SELECT s1_id, tgt_id FROM sw JOIN sel USING (country, w_to))"""
query("rule_suffix_swaps", f"{RULES}{SHARE}, {_SWAPPED} SELECT * FROM swapped")(lambda s, d: rules.suffix_swaps(x(s, d), _accepted(s, d), rules.noise_suffixes(x(s, d), 1, -9.0, 5), 1, -9.0))
_TOP1 = "(SELECT s1_id, tgt_id FROM (SELECT *, row_number() OVER (PARTITION BY tgt_id ORDER BY p DESC, s1_id) AS rk FROM x) WHERE rk = 1)"
query("rule_top_claimant", f"{RULES} SELECT s1_id, tgt_id FROM swaps SEMI JOIN {_TOP1} t USING (s1_id, tgt_id)")(lambda s, d: rules.top_claimant(rules.one_word_swaps(x(s, d)).select("s1_id", "tgt_id"), x(s, d), "p"))


@query(
    "rule_chain",
    f"""{RULES}{SHARE},
ex AS ({_VPAIRS}), base AS (SELECT s1_id, tgt_id, CASE WHEN (s1_id, tgt_id) IN (SELECT (s1_id, tgt_id) FROM ex) THEN 0 ELSE p END AS p FROM x),
n1 AS (SELECT s1_id, tgt_id FROM adds JOIN ac USING (country, w) WHERE s >= 1 AND llr <= 1.5 AND a_sim >= 0.95 AND nf_eq = 1 AND (s1_id, tgt_id) NOT IN (SELECT (s1_id, tgt_id) FROM ex)),
acc1 AS (SELECT s1_id, tgt_id FROM base WHERE p >= 0.6 OR (s1_id, tgt_id) IN (SELECT (s1_id, tgt_id) FROM n1)),
rate AS (SELECT country, w, avg((acc1.s1_id IS NOT NULL)::INT) AS rate FROM adds LEFT JOIN acc1 USING (s1_id, tgt_id) WHERE a_sim >= 0.95 AND nf_eq = 1 GROUP BY ALL),
du AS (SELECT DISTINCT s1_id, tgt_id FROM adds JOIN share USING (country, w) JOIN rate USING (country, w) WHERE a_sim >= 0.95 AND nf_eq = 1 AND d >= 2 AND ns >= -9 AND rate < ns + 9),
n2 AS (SELECT s1_id, tgt_id FROM n1 UNION SELECT s1_id, tgt_id FROM du WHERE (s1_id, tgt_id) NOT IN (SELECT (s1_id, tgt_id) FROM ex)),
acc2 AS (SELECT s1_id, tgt_id FROM base WHERE p >= 0.6 OR (s1_id, tgt_id) IN (SELECT (s1_id, tgt_id) FROM n2)),
{_SWAPPED.replace("LEFT JOIN acc ON acc.s1_id = s.s1_id AND acc.tgt_id = s.tgt_id", "LEFT JOIN acc2 acc ON acc.s1_id = s.s1_id AND acc.tgt_id = s.tgt_id")},
n3 AS (SELECT s1_id, tgt_id FROM n2 UNION SELECT s1_id, tgt_id FROM swapped SEMI JOIN {_TOP1} t USING (s1_id, tgt_id) WHERE (s1_id, tgt_id) NOT IN (SELECT (s1_id, tgt_id) FROM ex))
SELECT s1_id, tgt_id FROM base WHERE p >= 0.6 OR (s1_id, tgt_id) IN (SELECT (s1_id, tgt_id) FROM n3)""",
)
def rule_chain(s, d):
    v = x(s, d)
    none = v.where("false").select("s1_id", "tgt_id")
    suffixes = rules.noise_suffixes(v, 1, -9.0, 5)
    return rules.chain(
        v, v, rules.vocabulary_pairs(v, rules.decoy_vocabulary(v, 2, 0.3)), rules.noise_addition_pairs(v, 1, 1.5),
        dual=lambda a: rules.dual_use_pairs(v, a, 2, -9.0, -9.0, 5), abbreviated=lambda a: none, swapped=lambda a: rules.suffix_swaps(v, a, suffixes, 1, -9.0),
        decide=lambda p: decide.by_threshold(p, "p", 0.6),
    )


# ---- learned maps

_PLACES = f"SELECT unnest(list_zip({WORDS.format('b_core')}, {WORDS.format('a_core')})) AS z FROM x WHERE len({WORDS.format('a_core')}) = len({WORDS.format('b_core')})"


@query(
    "translit_token_map",
    f"""{RULES}, t AS ({_PLACES}), n AS (SELECT z[1] AS tok, z[2] AS best, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY tok) AS a, row_number() OVER (PARTITION BY tok ORDER BY n DESC, best) AS rk FROM n) SELECT tok, best, n FROM r WHERE rk = 1 AND n >= 2 AND n >= 0.3 * a""",
)
def translit_token_map(s, d):
    return rules.token_map(x(s, d), 2, 0.3)


# ---- thresholds and reports on the linkage view

query("dec_threshold", f"{PAIRS} SELECT s1_id, tgt_id, p FROM scored WHERE p >= 0.5")(lambda s, d: decide.by_threshold(scored(s, d), "p", 0.5))
_CURVE = """, th AS (SELECT DISTINCT s1_id, tgt_id FROM truth), g AS (SELECT i / 100.0::DOUBLE AS tau FROM range(5, 96) t(i)), s1 AS (SELECT entity_id AS s1_id FROM entity WHERE k = 1),
nt AS (SELECT s1_id, count(*) AS n FROM th GROUP BY ALL),
c AS (SELECT tau, s1_id, count(*) AS k, count(y) AS tp FROM g JOIN (SELECT scored.*, th.tgt_id AS y FROM scored LEFT JOIN th USING (s1_id, tgt_id)) ON p >= tau GROUP BY ALL),
curve AS (SELECT tau, round(avg(CASE WHEN coalesce(k, 0) + coalesce(n, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(tp, 0) = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n + k) END), 6) AS macro_f
 FROM g CROSS JOIN s1 LEFT JOIN nt USING (s1_id) LEFT JOIN c USING (tau, s1_id) GROUP BY tau)"""
query("dec_threshold_curve", f"{PAIRS}{_CURVE} SELECT * FROM curve")(lambda s, d: decide.threshold_curve(scored(s, d), "p", truth(s, d), registry.s1(s, d)))
query("dec_tune_threshold", f"{PAIRS}{_CURVE} SELECT * FROM curve ORDER BY macro_f DESC, tau LIMIT 1")(lambda s, d: decide.tune_threshold(scored(s, d), "p", truth(s, d), registry.s1(s, d)))
query("dec_decide", f"{PAIRS} SELECT s1_id, tgt_id FROM (SELECT *, row_number() OVER (PARTITION BY tgt_id ORDER BY p DESC, s1_id) AS rt FROM scored) WHERE rt = 1 AND p >= 0.4")(
    lambda s, d: decide.decide(scored(s, d), "p", {"many_to_one": True, "type": "threshold", "tau": 0.4})
)


@query(
    "eval_recall_by_country",
    f"""{PAIRS} SELECT country, count(*) AS n_true, count(c.s1_id) AS n_found, round(count(c.s1_id)::DOUBLE / count(*), 6) AS recall
FROM (SELECT DISTINCT s1_id, tgt_id FROM truth) t JOIN entity ON entity_id = t.s1_id LEFT JOIN scored c ON c.s1_id = t.s1_id AND c.tgt_id = t.tgt_id GROUP BY country""",
)
def eval_recall_by_country(s, d):
    return decide.ceiling(scored(s, d), truth(s, d), registry.s1(s, d))


@query(
    "eval_country_report",
    f"""{PAIRS}, g AS (SELECT s1_id, count(*) FILTER (WHERE p >= 0.5) AS k, max(p) AS best FROM scored GROUP BY ALL)
SELECT country, count(*) AS n, round(avg((coalesce(g.k, 0) > 0)::INT), 6) AS matched, round(avg(coalesce(g.k, 0)), 6) AS mean_matches, round(median(best), 6) AS median_best, round(avg((best IS NULL)::INT), 6) AS without
FROM entity e LEFT JOIN g ON entity_id = s1_id WHERE e.k = 1 GROUP BY country""",
)
def eval_country_report(s, d):
    return decide.country_report(scored(s, d), "p", 0.5, registry.s1(s, d))


@query("stack_logit", f"{PAIRS} SELECT s1_id, tgt_id, round(ln(q / (1 - q)), 6) AS z FROM (SELECT *, least(greatest(p, 0.000001::DOUBLE), 1 - 0.000001::DOUBLE) AS q FROM scored)")
def stack_logit(s, d):
    return scored(s, d).select("s1_id", "tgt_id", F.round(decide.logit(F.col("p")), 6).alias("z"))


@query(
    "nn_logit_context",
    f"""{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, tgt_id) AS rk FROM scored)
SELECT s1_id, tgt_id, rk, coalesce(round(p - CASE WHEN rk = 1 THEN max(CASE WHEN rk = 2 THEN p END) OVER s ELSE max(p) OVER s END, 6), 10.0::DOUBLE) AS margin FROM r WINDOW s AS (PARTITION BY s1_id)""",
)
def nn_logit_context(s, d):
    return decide.logit_context(scored(s, d), "p")


# ---- recovery

_RECORDS = """, rc AS (SELECT s1_id AS entity_id, country, string_split(a_core, ' ')[1] AS name, a_addr AS addr, a_first AS number, tgt_id FROM var QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY tgt_id) = 1),
tc AS (SELECT tgt_id AS entity_id, country, string_split(b_core, ' ')[1] AS name, b_addr AS addr, b_first AS number FROM var QUALIFY row_number() OVER (PARTITION BY tgt_id ORDER BY s1_id) = 1),
pr AS (SELECT a.entity_id AS s1_id, b.entity_id AS tgt_id, a.addr AS aa, b.addr AS ab FROM rc a JOIN (SELECT *, count(*) OVER (PARTITION BY country, name) AS n FROM tc) b USING (country, name, number)
 WHERE b.n <= 600 AND a.name <> '' AND a.addr <> '' AND b.addr <> '' AND (a.entity_id, b.entity_id) NOT IN (SELECT (s1_id, tgt_id) FROM var WHERE p >= 0.9))"""


def _same_address(s, d):
    """Records of the variants, named by their first word, so that some share name and number."""
    v = src.variants(s, d)
    first = lambda i, o: F.row_number().over(Window.partitionBy(i).orderBy(o)) == 1
    side = lambda i, o, m: v.withColumn("_one", first(i, o)).where("_one").select(F.col(i).alias("entity_id"), "country", F.split(f"{m}_core", " ")[0].alias("name"), F.col(f"{m}_addr").alias("addr"), F.col(f"{m}_first").alias("number"))
    return rules.same_address_pairs(side("s1_id", "tgt_id", "a"), side("tgt_id", "s1_id", "b"), v.where("p >= 0.9"), 600)


_SAME = f"{VARIANTS}{_RECORDS}, sa AS ({token_set('pr', 'aa', 'ab', 'true')})"
query("rec_same_address", f"{_SAME} SELECT s1_id, tgt_id, v AS a_sim FROM sa")(_same_address)
query("rec_recovered", f"{_SAME} SELECT s1_id, tgt_id FROM (SELECT *, count(*) OVER (PARTITION BY tgt_id) AS n FROM sa WHERE v >= 0.999) WHERE n = 1 AND tgt_id NOT IN (SELECT tgt_id FROM var WHERE p >= 0.9)")(
    lambda s, d: rules.recovered(_same_address(s, d), src.variants(s, d).where("p >= 0.9").select("tgt_id"))
)


# ---- cardinality

_ASSIGNED = """, ty AS (
 SELECT s1_id, tgt_id, p, label, CASE WHEN b_addr = '' THEN 'noaddr' WHEN a_addr = '' THEN 's1noaddr' WHEN a_sim >= 0.95 AND nf_eq = 1 THEN 'same' WHEN a_sim >= 0.95 AND nf_eq IS NULL THEN 'same_nonum'
  WHEN a_sim >= 0.8 AND nf_eq = 0 THEN 'diffnum' WHEN nf_eq = 1 THEN 'num_only' ELSE 'other' END AS ar, CASE WHEN a_core = b_core AND a_core <> '' THEN 'exact' ELSE 'multi' END AS nr FROM x),
asg AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, tgt_id) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY tgt_id ORDER BY p DESC, s1_id) AS rt FROM ty) WHERE rt = 1)"""


def _types(s, d):
    v = x(s, d)
    exact = F.when((F.col("na") == F.col("nb")) & (F.col("na") != ""), "exact").otherwise("multi")
    z = v.select("s1_id", "tgt_id", "p", "nf_eq", F.col("a_sim").alias("a_tset"), F.col("a_addr_empty").cast("int"), F.col("b_addr_empty").cast("int").alias("addr_empty_b"), exact.alias("nr"))
    z = z.withColumnRenamed("a_addr_empty", "addr_empty_a").withColumns({c: F.lit(0) for c in ("name_exact", "acro", "n_tset", "tc_n_ua", "tc_n_ub")})
    return rawform.pair_types(z, "p").drop("nr").join(z.select("s1_id", "tgt_id", "nr"), ["s1_id", "tgt_id"])


def _assigned(s, d):
    return cardinality.assigned(x(s, d).select("s1_id", "tgt_id", "p", "label"), _types(s, d))


query("card_assigned", f"{RULES}{_ASSIGNED} SELECT s1_id, tgt_id, p, label, ar, nr, rk::INT AS rk FROM asg WHERE rk <= 12")(lambda s, d: _assigned(s, d).select("s1_id", "tgt_id", "p", "label", "ar", "nr", "rk"))


def _design(s, d):
    v = x(s, d)
    people = v.groupBy("s1_id").agg(F.min("country").alias("country"), F.min("na").alias("name"), F.min("a_addr_empty").alias("addr_empty"))
    return cardinality.design(_assigned(s, d), people)


@query(
    "card_design",
    f"""{RULES}{_ASSIGNED}, me AS (SELECT s1_id, min(country) AS country, min(a_core) AS name, min(a_addr_empty) AS addr_empty FROM x GROUP BY ALL)
SELECT s1_id, count(*) AS n, round(sum(p), 6) AS psum, sum((p > 0.5)::INT)::BIGINT AS n05, sum((p > 0.9)::INT)::BIGINT AS n09, sum((p > 0.2)::INT)::BIGINT AS n02, sum((ar = 'noaddr')::INT)::BIGINT AS n_noaddr,
 round(sum(CASE WHEN ar = 'noaddr' THEN p ELSE 0 END), 6) AS p_noaddr, sum((nr = 'exact')::INT)::BIGINT AS n_exact, round(sum(CASE WHEN nr = 'exact' THEN p ELSE 0 END), 6) AS p_exact,
 sum(starts_with(tgt_id, 'S2')::INT)::BIGINT AS n_s2, sum(label)::BIGINT AS k_true, country, length(first(name)) AS name_len, len(string_split(first(name), ' '))::INT AS name_tok, (country = 'US')::INT AS is_us, first(addr_empty)::INT AS addr_empty
FROM asg JOIN me USING (s1_id) WHERE rk <= 12 GROUP BY s1_id, country""",
)
def card_design(s, d):
    return _design(s, d).drop("ps", "pb")


@query("card_counts", f"""{RULES}{_ASSIGNED}, g AS (SELECT s1_id, list([p] ORDER BY rk) AS ps FROM asg WHERE rk <= 12 GROUP BY s1_id),
b AS (SELECT s1_id, list_reduce(ps, lambda d, q: list_transform(range(1, len(d) + 2), lambda i: coalesce(d[i], 0) * (1 - q[1]) + coalesce(d[i - 1], 0) * q[1]), [1.0::DOUBLE]) AS pb FROM g)
SELECT s1_id, k::INT AS k, round(pb[k + 1], 6) AS chance FROM (SELECT *, unnest(range(0, len(pb))) AS k FROM b)""")
def card_counts(s, d):
    return _design(s, d).select("s1_id", F.posexplode(F.slice("pb", 1, F.size("ps") + 1)).alias("k", "chance")).select("s1_id", "k", F.round("chance", 6).alias("chance"))


@query(
    "card_choose",
    f"""{RULES}{_ASSIGNED}, scored AS (SELECT s1_id, tgt_id, p FROM asg WHERE rk <= 12)
{registry.sql.BEST} SELECT s1_id, tgt_id FROM asg JOIN best USING (s1_id) WHERE rk <= k""",
)
def card_choose(s, d):
    """Under the scores' own distribution the choice is that of the greatest expected F, which the SQL has."""
    return cardinality.prior_select(_assigned(s, d), _design(s, d).select("s1_id", "ps", F.col("pb").alias("prior")))


@query("card_prior_decision")
def card_prior_decision(s, d):
    """A learned prior for two countries, the scores' own for the others."""
    g = _design(s, d)
    model = cardinality.fit(g, 20)
    return cardinality.prior_select(_assigned(s, d), cardinality.learned_priors(g, model, ["en", "fr"]))


query("io_fold_targets", f"{ENTITY} SELECT country, k, entity_id FROM entity WHERE k > 1")(lambda s, d: src.entities(s, d).where("k > 1").select("country", "k", "entity_id"))
