"""Registered queries of pair features, changed words, siblings, raw names and learned steps, each with its SQL where SQL has it, over the variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.functions.translit import romanised
from kinweave.operators import characters, decide, features, learn, pairs, rawform, spelling
from kinweave.plans import registry, sql
from kinweave.plans.rules import CONFLICT
from kinweave.plans.sql import VARIANTS, WORDS, ratio, sorted_words, token_set
from kinweave.sources import entities as src
from kinweave.sources import work

QUERIES: dict = {}
ORACLE_SQL: dict = {}
KEYS = ["s1_id", "tgt_id"]


def _f(spark, d):
    """The variants with the features of pairs; what a query doesn't read isn't computed."""
    return features.pair_features(src.variants(spark, d))


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return put


def _columns(name: str, columns: list[str], oracle: str | None) -> None:
    query(name, oracle)(lambda s, d: _f(s, d).select(*KEYS, *columns))


NAMED, PLACED, SAID = "a_core <> '' AND b_core <> ''", "a_addr <> '' AND b_addr <> ''", "a_words <> '' AND b_words <> ''"


def _when(where: str, value: str, name: str) -> str:
    return f"CASE WHEN {where} THEN round({value}, 6) END AS {name}"


_columns(
    "sim_ratio", ["n_ratio", "c_ratio", "a_ratio"],
    f"{VARIANTS} SELECT s1_id, tgt_id, {_when(NAMED, ratio('a_core', 'b_core'), 'n_ratio')}, {_when(NAMED, ratio('a_compact', 'b_compact'), 'c_ratio')}, {_when(PLACED, ratio('a_addr', 'b_addr'), 'a_ratio')} FROM var",
)


def _partial(a: str, b: str, where: str, name: str) -> str:
    """Best ratio of the shorter to windows of the longer, a window a row."""
    return f"""SELECT s1_id, tgt_id, round(max({ratio("sh", "win")}), 6) AS {name} FROM (
 SELECT s1_id, tgt_id, sh, substr(lo, greatest(1, e - length(sh) + 1), e - greatest(1, e - length(sh) + 1) + 1) AS win FROM (
  SELECT s1_id, tgt_id, sh, lo, unnest(range(1, length(lo) + length(sh))) AS e FROM (
   SELECT s1_id, tgt_id, CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END AS sh, CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END AS lo FROM var WHERE {where}))) GROUP BY ALL"""


_columns(
    "sim_partial", ["n_partial", "c_partial", "a_partial"],
    f"""{VARIANTS} SELECT s1_id, tgt_id, n_partial, c_partial, a_partial FROM var LEFT JOIN ({_partial("a_core", "b_core", NAMED, "n_partial")}) USING (s1_id, tgt_id)
LEFT JOIN ({_partial("a_compact", "b_compact", NAMED, "c_partial")}) USING (s1_id, tgt_id) LEFT JOIN ({_partial("a_addr", "b_addr", PLACED, "a_partial")}) USING (s1_id, tgt_id)""",
)
_columns(
    "sim_token_sort", ["n_tsort"],
    f"{VARIANTS}, so AS (SELECT s1_id, tgt_id, {sorted_words('a_core')} AS u, {sorted_words('b_core')} AS v, {NAMED} AS named FROM var) SELECT s1_id, tgt_id, {_when('named', ratio('u', 'v'), 'n_tsort')} FROM so",
)
_columns(
    "sim_token_set", ["n_tset", "a_tset", "w_tset"],
    f"""{VARIANTS}, n AS ({token_set("var", "a_core", "b_core", NAMED)}), ad AS ({token_set("var", "a_addr", "b_addr", PLACED)}), wo AS ({token_set("var", "a_words", "b_words", SAID)})
SELECT s1_id, tgt_id, n.v AS n_tset, ad.v AS a_tset, wo.v AS w_tset FROM n JOIN ad USING (s1_id, tgt_id) JOIN wo USING (s1_id, tgt_id)""",
)
_PARTS = """(SELECT s1_id || '|' || tgt_id || '|' || i AS s1_id, j AS tgt_id, pa, pb FROM (
 SELECT s1_id, tgt_id, i, pa, unnest(bs) AS pb, unnest(range(1, len(bs) + 1)) AS j FROM (
  SELECT s1_id, tgt_id, unnest(xs) AS pa, unnest(range(1, len(xs) + 1)) AS i, bs FROM (
   SELECT s1_id, tgt_id, string_split(CASE WHEN a_parts <> '' THEN a_parts ELSE a_core END, '|') AS xs, string_split(CASE WHEN b_parts <> '' THEN b_parts ELSE b_core END, '|') AS bs FROM var WHERE a_core <> '' AND b_core <> ''))))"""
_columns(
    "sim_parts_best", ["parts_best"],
    f"""{VARIANTS}, pt AS ({token_set(_PARTS, "pa", "pb", "true")}), bp AS (SELECT string_split(s1_id, '|')[1] AS s1_id, string_split(s1_id, '|')[2] AS tgt_id, max(v) AS parts_best FROM pt GROUP BY ALL)
SELECT s1_id, tgt_id, parts_best FROM var LEFT JOIN bp USING (s1_id, tgt_id)""",
)
_columns(
    "sim_jaro_winkler", ["n_jw", "c_jw"],
    f"{VARIANTS} SELECT s1_id, tgt_id, {_when(NAMED, 'jaro_winkler_similarity(a_core, b_core)', 'n_jw')}, {_when(NAMED, 'jaro_winkler_similarity(a_compact, b_compact)', 'c_jw')} FROM var",
)
_SOFT = "len(list_filter({x}, lambda p: len(list_filter({y}, lambda q: round(jaro_winkler_similarity(p, q), 9) >= 0.9)) > 0))::DOUBLE / len({x})"
_TA, _TB = WORDS.format("a_core"), WORDS.format("b_core")
_columns("sim_soft_tokens", ["tok_soft_a", "tok_soft_b"], f"{VARIANTS} SELECT s1_id, tgt_id, {_when(NAMED, _SOFT.format(x=_TA, y=_TB), 'tok_soft_a')}, {_when(NAMED, _SOFT.format(x=_TB, y=_TA), 'tok_soft_b')} FROM var")
_columns(
    "sim_prefix", ["c_prefix"],
    f"{VARIANTS} SELECT s1_id, tgt_id, {_when(NAMED, 'len(list_filter(range(1, least(length(a_compact), length(b_compact)) + 1), lambda i: substr(a_compact, 1, i) = substr(b_compact, 1, i)))::DOUBLE / least(length(a_compact), length(b_compact))', 'c_prefix')} FROM var",
)


def _jacc(a: str, b: str, name: str) -> str:
    x, y = f"list_distinct({WORDS.format(a)})", f"list_distinct({WORDS.format(b)})"
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN round(len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct({x} || {y})), 6) END AS {name}"


_NB = f"list_distinct({WORDS.format('b_nums')})"
_BOTH_NUMS = f"len(list_intersect(list_distinct({WORDS.format('a_nums')}), {_NB}))"
_columns(
    "sim_sets", ["tok_jacc", "w_jacc", "num_jacc", "num_overlap", "num_b_in_a"],
    f"""{VARIANTS} SELECT s1_id, tgt_id, {_jacc("a_core", "b_core", "tok_jacc")}, {_jacc("a_words", "b_words", "w_jacc")}, {_jacc("a_nums", "b_nums", "num_jacc")},
 {_BOTH_NUMS}::INT AS num_overlap, CASE WHEN len({_NB}) > 0 THEN round({_BOTH_NUMS}::DOUBLE / len({_NB}), 6) END AS num_b_in_a FROM var""",
)
_LA, _LB = f"list_distinct({WORDS.format('a_legal')})", f"list_distinct({WORDS.format('b_legal')})"
_columns(
    "sim_flags",
    ["acro", "contain", "legal_same", "legal_conflict", "legal_missing", "n_tok_a", "n_tok_b", "len_ratio", "name_indic_b", "first_tok_eq", "name_exact", "name_empty_b", "state_eq", "addr_empty_a", "addr_empty_b", "n_addr_tok_a", "n_addr_tok_b"],
    f"""{VARIANTS} SELECT s1_id, tgt_id, ((length(a_initials) >= 2 AND a_initials = b_compact) OR (length(b_initials) >= 2 AND b_initials = a_compact))::INT AS acro,
 (least(length(a_compact), length(b_compact)) >= 4 AND (contains(a_compact, b_compact) OR contains(b_compact, a_compact)))::INT AS contain,
 (len({_LA}) > 0 AND list_sort({_LA}) = list_sort({_LB}))::INT AS legal_same, {CONFLICT}::INT AS legal_conflict, ((len({_LA}) > 0) <> (len({_LB}) > 0))::INT AS legal_missing,
 len({_TA})::INT AS n_tok_a, len({_TB})::INT AS n_tok_b, {_when(NAMED, "least(length(a_core), length(b_core))::DOUBLE / greatest(length(a_core), length(b_core))", "len_ratio")},
 0 AS name_indic_b, coalesce({_TA}[1] = {_TB}[1], false)::INT AS first_tok_eq, ({NAMED} AND a_core = b_core)::INT AS name_exact, (b_core = '')::INT AS name_empty_b,
 CASE WHEN a_state <> '' AND b_state <> '' THEN (a_state = b_state)::INT END AS state_eq, a_addr_empty::INT AS addr_empty_a, b_addr_empty::INT AS addr_empty_b,
 len({WORDS.format("a_addr")})::INT AS n_addr_tok_a, len({WORDS.format("b_addr")})::INT AS n_addr_tok_b FROM var""",
)
_KNOWN = "a_first <> '' AND b_first <> ''"
_NEAR = "starts_with(a_first, b_first) OR starts_with(b_first, a_first) OR ends_with(a_first, b_first) OR ends_with(b_first, a_first)"
_columns(
    "sim_number_features", ["nf_eq", "nf_lev", "nf_contain", "nf_logdiff"],
    f"""{VARIANTS} SELECT s1_id, tgt_id, CASE WHEN {_KNOWN} THEN (a_first = b_first)::INT END AS nf_eq, CASE WHEN {_KNOWN} THEN levenshtein(a_first, b_first)::INT END AS nf_lev,
 CASE WHEN {_KNOWN} THEN ({_NEAR})::INT END AS nf_contain, CASE WHEN {_KNOWN} THEN round(ln(1 + abs(a_first[1:15]::BIGINT - b_first[1:15]::BIGINT)), 6) END AS nf_logdiff FROM var""",
)


def _records(spark, d):
    """The variants' records: the reference side as k 1, the other as k 2."""
    v = src.variants(spark, d)
    side = lambda i, m, k: v.select("country", F.lit(k).alias("k"), F.col(i).alias("entity_id"), *[F.col(f"{m}_{c}").alias(c) for c in features.FIELDS])
    return side("s1_id", "a", 1).unionByName(side("tgt_id", "b", 2))


_IDF = f"""re AS (SELECT a_core AS core FROM var UNION ALL SELECT b_core FROM var),
idf AS (SELECT t, round(ln((1 + (SELECT count(*) FROM re))::DOUBLE / (1 + count(*))) + 1, 9) AS idf FROM (SELECT unnest(list_distinct({WORDS.format("core")})) AS t FROM re) GROUP BY t)"""
query("sim_name_idf", f"{VARIANTS}, {_IDF} SELECT t, idf FROM idf")(lambda s, d: features.name_idf(_records(s, d)))
query(
    "sim_idf_overlap",
    f"""{VARIANTS}, {_IDF}, un AS (SELECT s1_id, tgt_id, unnest(list_distinct({_TA} || {_TB})) AS t, {_TA} AS ta, {_TB} AS tb FROM var WHERE {NAMED})
SELECT s1_id, tgt_id, round(coalesce(sum(idf) FILTER (WHERE list_contains(ta, t) AND list_contains(tb, t)), 0) / sum(idf), 6) AS idf_overlap FROM un JOIN idf USING (t) GROUP BY ALL""",
)(lambda s, d: features.idf_overlap(src.variants(s, d), features.name_idf(_records(s, d))))
query(
    "sim_frequencies",
    f"""{VARIANTS}, fa AS (SELECT country, a_core AS core, count(*) AS n FROM var GROUP BY ALL), fb AS (SELECT country, b_core AS core, count(*) AS n FROM var GROUP BY ALL)
SELECT s1_id, tgt_id, coalesce(x.n, 0) AS s1_freq_a, coalesce(y.n, 0) AS s1_freq_b, coalesce(z.n, 0) AS tgt_freq_b FROM var v
LEFT JOIN fa x ON x.country = v.country AND x.core = a_core LEFT JOIN fa y ON y.country = v.country AND y.core = b_core LEFT JOIN fb z ON z.country = v.country AND z.core = b_core""",
)(lambda s, d: features.frequencies(src.variants(s, d).select(*KEYS, "country", "a_core", "b_core"), _records(s, d)).select(*KEYS, "s1_freq_a", "s1_freq_b", "tgt_freq_b"))
_FOLD = "CASE WHEN h < 4 THEN 'A' WHEN h < 8 THEN 'B' ELSE 'H' END"
query(
    "sim_labels", f"{VARIANTS} SELECT s1_id, tgt_id, label, {_FOLD} AS fold FROM (SELECT *, (s1_id[4:]::BIGINT % 1000003 * 2654435761) % 4294967296 % 10 AS h FROM var)",
)(lambda s, d: features.labelled(src.variants(s, d).select(*KEYS), src.variants(s, d).where("label = 1")).select(*KEYS, "label", "fold"))

# ---- changed words

_UNM = f"len(list_filter({{y}}, lambda q: {ratio('p', 'q')} >= 0.8)) = 0"
_UA, _UB = f"list_filter({_TA}, lambda p: {_UNM.format(y=_TB)})", f"list_filter({_TB}, lambda p: {_UNM.format(y=_TA)})"
query("tok_unmatched", f"{VARIANTS} SELECT s1_id, tgt_id, array_to_string({_UA}, ' ') AS ua, array_to_string({_UB}, ' ') AS ub FROM var")(
    lambda s, d: src.variants(s, d).select(*KEYS, features.unmatched_words(F.col("a_core"), F.col("b_core")).alias("u")).select(*KEYS, F.array_join("u.a", " ").alias("ua"), F.array_join("u.b", " ").alias("ub"))
)


def _stats(s, d):
    v = src.variants(s, d)
    return pairs.token_stats(v.select("country", F.col("a_core").alias("name")), v.select("country", F.col("b_core").alias("name")), 0.01, 0.3)


_STATS = f"""wa AS (SELECT country, t, count(*) AS df1 FROM (SELECT country, unnest(list_distinct({_TA})) AS t FROM var) GROUP BY ALL), wb AS (SELECT country, t, count(*) AS dft FROM (SELECT country, unnest(list_distinct({_TB})) AS t FROM var) GROUP BY ALL),
cn AS (SELECT country, count(*) AS n FROM var GROUP BY ALL),
st AS (SELECT country, t, round(ln((coalesce(dft, 0) + 1)::DOUBLE) - ln((coalesce(df1, 0) + 1)::DOUBLE), 6) AS f, CASE WHEN df1 > 0 THEN round(ln(df1::DOUBLE / n), 6) END AS share1,
 coalesce(df1, 0)::DOUBLE / n >= 0.01::DOUBLE AND round(ln((coalesce(dft, 0) + 1)::DOUBLE) - ln((coalesce(df1, 0) + 1)::DOUBLE), 6) < 0.3::DOUBLE AS cat FROM wa FULL JOIN wb USING (country, t) JOIN cn USING (country))"""


def _side(s: str, u: str) -> str:
    return f"""{s} AS (SELECT s1_id, tgt_id, count(*) AS tc_n_{s}, count(*) FILTER (WHERE cat) AS tc_c_{s}, min(f) AS tc_fmin_{s}, max(f) AS tc_fmax_{s}, max(share1) AS tc_share_{s}
 FROM (SELECT s1_id, tgt_id, country, unnest({u}) AS t FROM var) LEFT JOIN st USING (country, t) GROUP BY ALL)"""


query(
    "tok_change",
    f"""{VARIANTS}, {_STATS}, {_side("ua", _UA)}, {_side("ub", _UB)}
SELECT s1_id, tgt_id, coalesce(tc_n_ua, 0) AS tc_n_ua, coalesce(tc_n_ub, 0) AS tc_n_ub, coalesce(tc_c_ua, 0) AS tc_c_ua, coalesce(tc_c_ub, 0) AS tc_c_ub, tc_fmin_ua, tc_fmax_ua, tc_fmin_ub, tc_fmax_ub, tc_share_ua, tc_share_ub
FROM var LEFT JOIN ua USING (s1_id, tgt_id) LEFT JOIN ub USING (s1_id, tgt_id)""",
)(lambda s, d: features.changed_words(src.variants(s, d), _stats(s, d)))


# ---- siblings, types, raw names


def _targets(s, d):
    v = src.variants(s, d)
    return v.groupBy(F.col("tgt_id").alias("entity_id")).agg(*[F.min_by(f"b_{c}", "s1_id").alias(c) for c in ("core", "compact", "addr", "first")])


query("ctx_siblings")(lambda s, d: pairs.sibling_features(src.variants(s, d), _targets(s, d), "p"))
query(
    "ctx_sibling_numbers",
    f"""{VARIANTS}, tg AS (SELECT tgt_id, min_by(b_first, s1_id) AS f FROM var GROUP BY ALL),
sib AS (SELECT s1_id, tgt_id AS sib, p AS weight FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, tgt_id) AS rk FROM var WHERE p >= 0.3) WHERE rk <= 2),
g AS (SELECT v.s1_id, v.tgt_id, round(max(CASE WHEN a.f <> '' AND b.f <> '' THEN (a.f = b.f)::INT * weight END), 6) AS sib_nf, count(*) AS sib_n FROM var v JOIN sib ON sib.s1_id = v.s1_id AND sib.sib <> v.tgt_id
 JOIN tg a ON a.tgt_id = v.tgt_id JOIN tg b ON b.tgt_id = sib WHERE v.p >= 0.01 GROUP BY ALL)
SELECT s1_id, tgt_id, sib_nf, sib_n FROM var LEFT JOIN g USING (s1_id, tgt_id)""",
)(lambda s, d: pairs.sibling_features(src.variants(s, d), _targets(s, d), "p").select(*KEYS, "sib_nf", "sib_n"))


def _raw(s, d):
    """Raw names of the variants: one titled with a legal form and a bracket, the other in capitals for a third of them."""
    v = src.variants(s, d)
    other = F.when(F.col("label") == 1, F.upper(F.concat("b_core", F.lit(" "), "b_legal"))).otherwise(F.concat(F.initcap("b_core"), F.lit(" ("), "b_legal", F.lit(")")))
    return v.select(*KEYS, "label", "p", F.concat(F.initcap("a_core"), F.lit(" ("), "a_legal", F.lit(")")).alias("na"), other.alias("nb"))


def _types(s, d):
    x = features.changed_words(src.variants(s, d), _stats(s, d)).join(_f(s, d).select(*KEYS, "a_tset", "nf_eq", "addr_empty_a", "addr_empty_b", "name_exact", "acro", "n_tset", "p"), KEYS)
    return rawform.pair_types(x, "p")


query(
    "raw_pair_types",
    f"""{VARIANTS}, n AS ({token_set("var", "a_core", "b_core", NAMED)}), ad AS ({token_set("var", "a_addr", "b_addr", PLACED)}),
x AS (SELECT var.*, n.v AS n_tset, ad.v AS a_tset, CASE WHEN {_KNOWN} THEN (a_first = b_first)::INT END AS nf_eq, len({_UA}) AS ua, len({_UB}) AS ub,
 ((length(a_initials) >= 2 AND a_initials = b_compact) OR (length(b_initials) >= 2 AND b_initials = a_compact)) AS acro, row_number() OVER (PARTITION BY tgt_id ORDER BY p DESC, s1_id) AS rk
 FROM var JOIN n USING (s1_id, tgt_id) JOIN ad USING (s1_id, tgt_id))
SELECT s1_id, tgt_id, CASE WHEN b_addr_empty THEN 'noaddr' WHEN a_addr_empty THEN 's1noaddr' WHEN a_tset >= 0.95 AND nf_eq = 1 THEN 'same' WHEN a_tset >= 0.95 AND nf_eq IS NULL THEN 'same_nonum'
  WHEN a_tset >= 0.8 AND nf_eq = 0 THEN 'diffnum' WHEN nf_eq = 1 THEN 'num_only' ELSE 'other' END AS ar,
 CASE WHEN {NAMED} AND a_core = b_core THEN 'exact' WHEN ua = 0 AND ub = 0 THEN 'fuzzy_eq' WHEN acro THEN 'acro' WHEN n_tset < 0.5 THEN 'alias' WHEN ua = 0 AND ub = 1 THEN 'add1' WHEN ua = 0 AND ub >= 2 THEN 'add2+'
  WHEN ua = 1 AND ub = 0 THEN 'drop1' WHEN ua >= 2 AND ub = 0 THEN 'drop2+' WHEN ua = 1 AND ub = 1 THEN 'swap1' ELSE 'multi' END AS nr, CASE WHEN rk = 1 THEN 't1' ELSE 't2+' END AS tr FROM x""",
)(_types)
query(
    "raw_order_fraction",
    f"""{VARIANTS}, pl AS (SELECT s1_id, tgt_id, list_transform(list_filter({_TA}, lambda w: list_contains({_TB}, w)), lambda w: len({_TB}) - list_position(list_reverse({_TB}), w)) AS q FROM var)
SELECT s1_id, tgt_id, CASE WHEN len(q) >= 2 THEN round(len(list_filter(range(1, len(q)), lambda i: q[i] < q[i + 1]))::DOUBLE / (len(q) - 1), 6) END AS frac FROM pl""",
)(lambda s, d: src.variants(s, d).select(*KEYS, F.round(features.W.order_fraction(F.split("a_core", " "), F.split("b_core", " ")), 6).alias("frac")))
query("raw_features")(lambda s, d: rawform.raw_features(_raw(s, d)))
query("raw_transformation")(lambda s, d: rawform.transformed(_raw(s, d)).select(*KEYS, "t.*"))
query("raw_template_tables")(lambda s, d: rawform.template_tables(rawform.transformed(_raw(s, d)), 2))


def _templates(s, d):
    t = work.once(s, "transformed", d, lambda: rawform.transformed(_raw(s, d)))
    return rawform.template_features(t, rawform.template_tables(t, 2))


query("raw_template_features")(_templates)

# ---- learned steps: models have no SQL, tests hold them to what they must do


def _learnable(s, d):
    """Candidates with ranks, gaps and labels. A fit reads its rows many times over: written, their windows are shuffled once and not for each reading.
    Windows end at a source of targets: one source after the other, so that the shuffles of one are on disk at a time."""

    def among(k):
        x = registry.blk_candidates(s, d).where(F.col("tgt_src") == k)
        t = registry.truth(s, d).where(pairs.source() == k).distinct().withColumn("label", F.lit(1))
        return work.once(s, f"learnable{k}", d, lambda: pairs.rank_gaps(x.join(t, KEYS, "left").fillna(0, ["label"])))

    return among(2).unionByName(among(3))


def _pruned(s, d):
    def build():
        x = _learnable(s, d)
        return learn.pruned(x, learn.cross_fit(x, learn.PRUNING))

    return work.once(s, "pruned", d, build)


query("prune_learned")(lambda s, d: _pruned(s, d).select(*KEYS, "country", "tgt_src", "p_pre"))
STAGE = (*learn.PRUNING, "p_pre", "c_rank_s1", "c_gap_s1", "c_sum_s1", "c_margin_tgt")


def _stage_rows(s, d):
    def build():
        p = _pruned(s, d)
        return p.join(pairs.group_features(p, "p_pre"), KEYS)

    return work.once(s, "stage_rows", d, build)


def _stage(s, d):
    def build():
        x = _stage_rows(s, d)
        return learn.cross_predict(x, learn.cross_fit(x, STAGE), STAGE, "p1")

    return work.once(s, "stage", d, build)


query("stage_cross_fit")(lambda s, d: _stage(s, d).select(*KEYS, "label", "p1"))
query("stack_out_of_fold")(lambda s, d: learn.stacked_out_of_fold(_stage(s, d).withColumn("z", decide.logit(F.col("p1"))), ("z", "cos_n", "cos_a"), rounds=5, depth=2).select(*KEYS, "p2"))
query("eval_auc", f"""{VARIANTS} SELECT round((SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM var a JOIN var b ON a.label = 1 AND b.label = 0) / ((SELECT count(*) FROM var WHERE label = 1) * (SELECT count(*) FROM var WHERE label = 0)), 6) AS auc""")(
    lambda s, d: learn.auc(src.variants(s, d), "p")
)
query("stack_encode", f"{VARIANTS} SELECT s1_id, tgt_id, coalesce(list_position(['en', 'de'], country), 0)::INT - 1 AS country FROM var")(lambda s, d: learn.encoded(src.variants(s, d).select(*KEYS, "country"), {"country": ["en", "de"]}))

# ---- other scripts, characters of pairs, another set's statistics

#: Letters of names and what stands for them in the queries of Indic words, and how those are spelt (+ for what replaces a consonant's vowel).
LATIN, LETTERS = "abcdefghijklmnopqrstuvwxyz", "अबचदएफगहइजकलमनओपयरसतउवा्ीे"
SPELT = "a ba ca da e pha ga ha i ja ka la ma na o pa ya ra sa ta u va +aa + +ii +e".split()


def _foreign(c):
    return F.translate(c, LATIN, LETTERS)


@query(
    "translit_romanised",
    f"""{VARIANTS}, m AS (SELECT MAP {{{", ".join(f"'{c}': '{x}'" for c, x in zip(LETTERS, SPELT))}}} AS m),
t AS (SELECT doc_w AS w, array_to_string(list_transform(string_split(translate(doc_w, '{LATIN}', '{LETTERS}'), ''), lambda c: coalesce(m[c], c)), '') AS r
 FROM (SELECT DISTINCT unnest({WORDS.format("a_core")}) AS doc_w FROM var), m)
SELECT w, regexp_replace(replace(r, 'a+', ''), '[^a-z0-9]', '', 'g') AS spelt FROM t""",
)
def translit_romanised(s, d):
    w = src.variants(s, d).select(F.explode(F.array_remove(F.split("a_core", " "), "")).alias("w")).distinct()
    return w.select("w", romanised(_foreign(F.col("w"))).alias("spelt"))


_FIXED = "CASE WHEN regexp_matches(w, '[0-9]') AND length(regexp_replace(w, '[^a-z]', '', 'g')) >= 3 THEN translate(w, '0134578', 'oleastb') ELSE w END"


@query(
    "translit_words",
    f"""{VARIANTS}, m AS (SELECT MAP {{{", ".join(f"'{k}': '{v}'" for k, v in text.LEGAL.items())}}} AS m),
c AS (SELECT unnest({WORDS.format("a_core")}) AS w, unnest({WORDS.format("b_core")}) AS b FROM var WHERE len({WORDS.format("a_core")}) = len({WORDS.format("b_core")})),
k AS (SELECT translate(b, '{LATIN}', '{LETTERS}') AS tok, {_FIXED} AS w FROM c),
n AS (SELECT tok, coalesce(m[w], w) AS best, count(*) AS n FROM k, m WHERE regexp_matches(tok, '[ऀ-ൿ]') GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY tok) AS al, row_number() OVER (PARTITION BY tok ORDER BY n DESC, best) AS rk FROM n)
SELECT tok, best, n FROM r WHERE rk = 1 AND n >= 2 AND n >= 0.5 * al""",
)
def translit_words(s, d):
    return spelling.word_spellings(src.variants(s, d).select(F.col("a_core").alias("a_name"), _foreign(F.col("b_core")).alias("b_name")))


def _vocabulary(s, d):
    return work.once(s, "characters", d, lambda: characters.vocabulary(src.entities(s, d).select("name", F.col("addr").alias("address"))))


_VOC = """, voc AS (SELECT c, n, (row_number() OVER (ORDER BY n DESC, c) + 3)::INT AS code FROM (
 SELECT c, count(*) AS n FROM (SELECT unnest(string_split(name || addr, '')) AS c FROM entity) WHERE c NOT IN ('', '~', '^') GROUP BY c) ORDER BY n DESC, c LIMIT 252)"""
query("nn_vocabulary", f"{sql.ENTITY}{_VOC} SELECT * FROM voc")(lambda s, d: _vocabulary(s, d))


@query(
    "nn_codes",
    f"""{sql.ENTITY}{_VOC}, m AS (SELECT map(list(c), list(code)) AS m FROM voc),
w AS (SELECT entity_id, rpad(name, 40, '~') || rpad(CASE WHEN length(addr) > 72 THEN addr[1:55] || '^' || right(addr, 16) ELSE addr END, 72, '~') AS w FROM entity)
SELECT entity_id, array_to_string(list_transform(string_split(w, ''), lambda c: CASE WHEN c = '~' THEN 0 WHEN c = '^' THEN 3 ELSE coalesce(m[c], 1) END), ' ') AS codes FROM w, m""",
)
def nn_codes(s, d):
    e = src.entities(s, d).select("entity_id", "name", F.col("addr").alias("address"))
    return characters.encoded(e, _vocabulary(s, d)).select("entity_id", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))


def _stats_sql(name: str, where: str) -> str:
    return f""", {name}w AS (SELECT country, k = 1 AS ref, unnest(list_distinct(string_split(name, ' '))) AS t FROM entity WHERE {where}),
{name}n AS (SELECT country, greatest(1, count(*) FILTER (WHERE k = 1)) AS n1, greatest(1, count(*) FILTER (WHERE k > 1)) AS nt FROM entity WHERE {where} GROUP BY ALL),
{name} AS (SELECT country, t, df1, dft, round(ln((dft + 1)::DOUBLE) - ln((df1 + 1)::DOUBLE) - ln(nt::DOUBLE / n1), 6) AS f FROM (
 SELECT country, t, count(*) FILTER (WHERE ref) AS df1, count(*) FILTER (WHERE NOT ref) AS dft FROM {name}w WHERE t <> '' GROUP BY ALL) JOIN {name}n USING (country))"""


#: Two parts of the records that stand for a training and a test set; the first lacks a country.
_TRAIN, _TEST = "doc_id % 2 = 0 AND country <> 'de'", "doc_id % 2 = 1"


@query(
    "shift_reference_stats",
    f"""{sql.ENTITY}{_stats_sql("tr", _TRAIN)}{_stats_sql("te", _TEST)}
SELECT * FROM tr UNION ALL SELECT * FROM te WHERE country NOT IN (SELECT country FROM tr)""",
)
def shift_reference_stats(s, d):
    e = src.entities(s, d)
    of = lambda x: pairs.token_stats(x.where("k = 1"), x.where("k > 1"), 0.01, 0.3)
    return learn.reference_stats(of(e.where(_TRAIN)), of(e.where(_TEST))).select("country", "t", "df1", "dft", "f")


@query("nn_pair_scores")
def nn_pair_scores(s, d):
    """The mean of two models' log odds on all pruned pairs; the models learn from all pairs of folds A and B, in as many rounds as the operators have."""
    e = src.entities(s, d).select("entity_id", "name", F.col("addr").alias("address"))
    x = characters.pair_codes(_stage(s, d).select(*KEYS, "label", "p1"), characters.encoded(e, _vocabulary(s, d)))
    t = work.once(s, "nn_training", d, lambda: characters.training_pairs(x, "p1", easy=1.0))
    return characters.score(x, characters.train_all(t, (7, 11)))
