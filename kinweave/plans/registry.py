"""Registered queries of sources, normalisation, retrieval, pruning, context and decision, each with its SQL, over the linkage view of the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import address, decision, text
from kinweave.operators import decide, pairs, retrieval
from kinweave.plans import sql
from kinweave.plans.sql import ENTITY, EXACT, NA, PAIRS, RANKS, TOPA, TOPN, A, N
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


# ---- what several queries read, written once


def entities(spark, d):
    """The linkage view: whole texts are cut into records once."""
    return work.once(spark, "entities", d, lambda: src.entities(spark, d))


def vectors(spark, d, view):
    """Unit vectors of the name view (n), the address view (a), or both (na)."""
    if view == "na":
        return retrieval.combined(vectors(spark, d, "n"), vectors(spark, d, "a"))

    def build():
        e = entities(spark, d)
        return retrieval.unit_vectors(e, retrieval.term_counts(e, view))

    return work.once(spark, f"vectors_{view}", d, build, ("k",))


def weights(spark, d, view):
    """The same, a row a posting."""
    return retrieval.postings(vectors(spark, d, view))


def search(spark, d, view, feats=None, k=3, whole=False):
    """Forward search among the targets of each source; ``whole``: over all features, also those that many targets have."""
    share, kind = (None, "_whole") if whole else (retrieval.DF_SHARE[view], "")

    def among(s):
        v = vectors(spark, d, view)
        return work.once(spark, f"top_{view}{s}_{k}_{feats}{kind}", d, lambda: retrieval.top_k(v.where("k = 1"), v.where(F.col("k") == s), k, share, feats))

    return among(2).unionByName(among(3))


def scored(spark, d):
    """s1_id, tgt_id, p: pairs found by name or by address, with the better cosine."""

    def build():
        both = search(spark, d, "n").unionByName(search(spark, d, "a", feats=10))
        return both.groupBy("s1_id", "tgt_id").agg(F.max("score").alias("p"))

    return work.once(spark, "scored", d, build)


def found(spark, d):
    """The candidates of all searches, forward and reverse, with three cosines."""

    def build():
        blocking = retrieval.Blocking(forward={"n": 3, "a": 3, "na": 5}, reverse={"na": 2}, features={"a": 10, "na": 10})
        views = {v: vectors(spark, d, v) for v in ("n", "a", "na")}
        return retrieval.candidates(entities(spark, d), views, blocking)

    return work.once(spark, "candidates", d, build, ("country", "tgt_src"))


def s1(spark, d):
    return entities(spark, d).where("k = 1").select(F.col("entity_id").alias("s1_id"), "country")


def truth(spark, d):
    return src.truth(entities(spark, d))


# ---- sources


@query(
    "io_id_lists",
    f"""{ENTITY}
SELECT e.entity_id AS s1_id, coalesce(string_agg(DISTINCT tgt_id, ',' ORDER BY tgt_id), '') AS ids FROM entity e LEFT JOIN truth ON e.entity_id = s1_id WHERE k = 1 GROUP BY 1""",
)
def io_id_lists(spark, d):
    return src.id_lists(s1(spark, d), truth(spark, d))


@query("io_truth_explode", f"{ENTITY} SELECT DISTINCT s1_id, tgt_id FROM truth")
def io_truth_explode(spark, d):
    return src.explode_truth(io_id_lists(spark, d).select(F.col("s1_id").alias("source1_entity_id"), F.col("ids").alias("matched_entity_ids")))


@query("io_known_truth", f"{ENTITY} SELECT DISTINCT s1_id, tgt_id, a.country, b.k AS tgt_src FROM truth JOIN entity a ON a.entity_id = s1_id JOIN entity b ON b.entity_id = tgt_id")
def io_known_truth(spark, d):
    e = src.entities(spark, d)
    return work.known_truth(src.truth(e).distinct(), e.where("k = 1"), e.where("k > 1"))


@query("io_names_of", f"{ENTITY} SELECT entity_id, name FROM entity SEMI JOIN truth ON entity_id = tgt_id")
def io_names_of(spark, d):
    return work.names_of(src.entities(spark, d), truth(spark, d).select("tgt_id"))


@query("io_load_table", f"{PAIRS} SELECT s1_id, tgt_id FROM scored WHERE p >= 0.5")
def io_load_table(spark, d):
    path = f"{work.work_dir(spark)}/{spark.sparkContext.applicationId}/load-{abs(hash(d))}"
    work.write_table(scored(spark, d).withColumn("tgt_src", pairs.source()), path, ("tgt_src",))
    return work.load_table(spark, f"{path}/*", ["s1_id", "tgt_id"], "p >= 0.5")


# ---- normalisation of whole texts


def _text_query(name, value, oracle):
    @query(name, f"SELECT doc_id, {oracle} AS v FROM documents" if oracle else None)
    def run(spark, d):
        return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", value().alias("v"))


_TOK = """list_transform(list_filter(string_split(trim(regexp_replace(replace(lower(text), '.', ''), '[^a-z0-9ऀ-ൿ]+', ' ', 'g')), ' '), lambda x: x <> ''),
  lambda t: CASE WHEN regexp_matches(t, '[0-9]') AND length(regexp_replace(t, '[^a-z]', '', 'g')) >= 3 THEN translate(t, '0134578', 'oleastb') ELSE t END)"""
_LEGAL = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in text.LEGAL.items()) + "}"
_KEPT = f"list_filter({_TOK}, lambda t: NOT list_contains({[*text.LEGAL, *text.NAME_STOP]!r}, t))"
_text_query("norm_ocr_tokens", lambda: F.array_join(text.tokens(F.lower("text")), " "), f"array_to_string({_TOK}, ' ')")
_text_query(
    "norm_legal_forms",
    lambda: text.legal_forms(text.tokens(F.lower("text"))),
    f"coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform({_TOK}, lambda t: {_LEGAL}[t]), lambda x: x IS NOT NULL))), ' '), '')",
)
_text_query(
    "norm_name_core",
    lambda: text.name_core(text.tokens(F.lower("text"))),
    f"array_to_string(list_filter(list_transform(list_zip(kept, list_prepend('', kept)), lambda z: CASE WHEN z[1] IS NOT NULL AND z[1] <> z[2] THEN z[1] END), lambda t: t IS NOT NULL), ' ')",
)
ORACLE_SQL["norm_name_core"] = ORACLE_SQL["norm_name_core"].replace("FROM documents", f"FROM (SELECT doc_id, {_KEPT} AS kept FROM documents)")
_NUMBERS = "list_transform(regexp_extract_all(lower(text), '([0-9]+)', 1), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)"


@query("norm_numbers", f"SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(n, range(1, len(n) + 1)), lambda p: list_position(n, p[1]) = p[2]), lambda p: p[1]), ',') AS v FROM (SELECT doc_id, {_NUMBERS} AS n FROM documents)")
def norm_numbers(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(text.numbers(F.lower("text")), ",").alias("v"))


_FOLDED = "replace(replace(replace(lower(text), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')"
_text_query("norm_fold_latin", lambda: text.fold(F.col("text")), f"translate({_FOLDED}, '{text.FOLD_FROM + text.LONE_FROM + text.DROPPED}', '{(text.FOLD_TO + text.LONE_TO).replace(chr(39), chr(39) * 2)}')")
_text_query(
    "nn_fixed_width",
    lambda: text.fixed_width(F.col("source"), F.col("text")),
    "rpad(coalesce(source, ''), 40, '~') || rpad(CASE WHEN length(text) > 72 THEN substr(text, 1, 55) || '^' || right(text, 16) ELSE coalesce(text, '') END, 72, '~')",
)


@query("norm_name")
def norm_name(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.normal_name(F.col("text")).alias("n")).select("doc_id", "n.*")


@query("norm_address")
def norm_address(spark, d):
    states = {lang: address.STATES["US"] for lang in ("en", "fr", "de", "es")}
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", address.normal_address(F.col("text"), F.col("lang"), states).alias("a")).select("doc_id", "a.*")


# ---- retrieval


@query("blk_char4_tf", f"{ENTITY}{N} SELECT entity_id, f, tf FROM ntf")
def blk_char4_tf(spark, d):
    return retrieval.term_counts(src.entities(spark, d), "n").select("entity_id", "f", "tf")


@query("blk_char3_tf", f"""{ENTITY} SELECT entity_id, f, count(*) AS tf FROM (SELECT entity_id, unnest(list_transform(range(1, length(compact) + 1), lambda i: substr('^' || compact || '$', i, 3))) AS f FROM entity) GROUP BY ALL""")
def blk_char3_tf(spark, d):
    return src.entities(spark, d).select("entity_id", F.explode(retrieval.char_grams(F.col("compact"), 3)).alias("f")).groupBy("entity_id", "f").agg(F.count("*").alias("tf"))


@query("blk_word_tf", f"{ENTITY}{A} SELECT entity_id, f, tf FROM atf")
def blk_word_tf(spark, d):
    return retrieval.term_counts(src.entities(spark, d), "a").select("entity_id", "f", "tf")


@query("blk_doc_freq", f"{ENTITY}{N} SELECT country, f, count(*) AS df FROM ntf GROUP BY ALL")
def blk_doc_freq(spark, d):
    return retrieval.document_frequency(retrieval.term_counts(src.entities(spark, d), "n"))


for _v, _cte in (("n", N), ("a", A), ("na", N + A + NA)):
    query(f"blk_tfidf_unit_{_v}", f"{ENTITY}{_cte} SELECT entity_id, f, round(w, 6) AS w FROM {_v}w")(lambda spark, d, v=_v: weights(spark, d, v).select("entity_id", "f", F.round("w", 6).alias("w")))
query("blk_topk_name", f"{ENTITY}{N}{sql.both('tn', 'n', 3, None)} SELECT * FROM tn")(lambda spark, d: search(spark, d, "n", whole=True))
query("blk_topk_addr_maxfeats", f"{ENTITY}{A}{TOPA} SELECT * FROM ta")(lambda spark, d: search(spark, d, "a", feats=10))
query("blk_topk_combined", f"{ENTITY}{N}{A}{NA}{sql.both('tc', 'na', 5, 0.01, 10)} SELECT * FROM tc")(lambda spark, d: search(spark, d, "na", feats=10, k=5))
query("blk_exact_core", ENTITY + EXACT.format(t="k > 1"))(lambda spark, d: retrieval.exact_core(src.entities(spark, d)))


def _reverse(o, v, k, share, feats=1_000_000):
    """Searches of each source's targets among the reference records."""
    return "".join(sql.top(f"{o}{s}", v, f"k = {s}", "k = 1", k, share, feats) for s in (2, 3)) + f",\n{o} AS (SELECT * FROM {o}2 UNION ALL SELECT * FROM {o}3)"


@query("blk_topk_reverse", f"{ENTITY}{N}{_reverse('tr', 'n', 3, 0.003)} SELECT s1_id AS tgt_id, tgt_id AS s1_id, score, rk FROM tr")
def blk_topk_reverse(spark, d):
    w = vectors(spark, d, "n")
    back = [retrieval.top_k(w.where(F.col("k") == s), w.where("k = 1"), 3, retrieval.DF_SHARE["n"]) for s in (2, 3)]
    return back[0].unionByName(back[1]).select(F.col("s1_id").alias("tgt_id"), F.col("tgt_id").alias("s1_id"), "score", "rk")


@query(
    "blk_union_via",
    f"""{ENTITY}{N}{A}{TOPN}{TOPA}
SELECT s1_id, tgt_id, bit_or(via)::INT AS via FROM (SELECT s1_id, tgt_id, 1 AS via FROM tn UNION ALL SELECT s1_id, tgt_id, 2 FROM ta UNION ALL SELECT s1_id, tgt_id, 64 FROM ({EXACT.format(t="k > 1")})) GROUP BY ALL""",
)
def blk_union_via(spark, d):
    return retrieval.union_via((search(spark, d, "n"), 1), (search(spark, d, "a", feats=10), 2), (retrieval.exact_core(entities(spark, d)), 64))


_CAND = f"""{ENTITY}{N}{A}{NA}{TOPN}{TOPA}{sql.both("tc", "na", 5, 0.01, 10)}{_reverse("tr", "na", 2, 0.01, 10)},
cand AS (
 SELECT s1_id, tgt_id, bit_or(via)::INT AS via FROM (SELECT s1_id, tgt_id, 1 AS via FROM tn UNION ALL SELECT s1_id, tgt_id, 2 FROM ta UNION ALL SELECT s1_id, tgt_id, 4 FROM tc
  UNION ALL SELECT tgt_id, s1_id, 32 FROM tr UNION ALL SELECT s1_id, tgt_id, 64 FROM ({EXACT.format(t="k = 2")} UNION ALL {EXACT.format(t="k = 3")})) GROUP BY ALL),
cosines AS (
 SELECT s1_id, tgt_id, v, round(sum(a.w * b.w), 6) AS c FROM cand
 JOIN (SELECT 'n' AS v, * FROM nw UNION ALL SELECT 'a', * FROM aw UNION ALL SELECT 'na', * FROM naw) a ON a.entity_id = s1_id
 JOIN (SELECT 'n' AS v, * FROM nw UNION ALL SELECT 'a', * FROM aw UNION ALL SELECT 'na', * FROM naw) b USING (v, f) WHERE b.entity_id = tgt_id GROUP BY ALL),
found AS (
 SELECT e.country, tgt_id[2]::INT AS tgt_src, s1_id, tgt_id, via, coalesce(max(c) FILTER (WHERE v = 'n'), 0) AS cos_n, coalesce(max(c) FILTER (WHERE v = 'a'), 0) AS cos_a, coalesce(max(c) FILTER (WHERE v = 'na'), 0) AS cos_na
 FROM cand JOIN entity e ON e.entity_id = s1_id LEFT JOIN cosines USING (s1_id, tgt_id) GROUP BY ALL)"""


@query("blk_candidates", f"{_CAND} SELECT * FROM found")
def blk_candidates(spark, d):
    return found(spark, d).select("country", F.col("tgt_src").cast("int").alias("tgt_src"), "s1_id", "tgt_id", "via", "cos_n", "cos_a", "cos_na")


@query("blk_pair_cosine", f"{PAIRS} SELECT s1_id, tgt_id, coalesce((SELECT round(sum(a.w * b.w), 6) FROM nw a JOIN nw b USING (f) WHERE a.entity_id = s1_id AND b.entity_id = tgt_id), 0) AS cos_n FROM scored")
def blk_pair_cosine(spark, d):
    return retrieval.pair_cosine(scored(spark, d).select("s1_id", "tgt_id"), vectors(spark, d, "n"), "cos_n")


# ---- pruning, context, shape

_GAPS = ", ".join(
    f"row_number() OVER (PARTITION BY country, tgt_src, s1_id ORDER BY cos_{v} DESC, tgt_id) AS rk1_{v}, round(max(cos_{v}) OVER s - cos_{v}, 6) AS gap1_{v}, "
    f"row_number() OVER (PARTITION BY country, tgt_src, tgt_id ORDER BY cos_{v} DESC, s1_id) AS rkt_{v}, round(max(cos_{v}) OVER t - cos_{v}, 6) AS gapt_{v}"
    for v in ("n", "a", "na")
)


@query("prune_rank_gaps", f"{_CAND} SELECT *, count(*) OVER s AS n_s1, count(*) OVER t AS n_tgt, {_GAPS} FROM found WINDOW s AS (PARTITION BY country, tgt_src, s1_id), t AS (PARTITION BY country, tgt_src, tgt_id)")
def prune_rank_gaps(spark, d):
    return pairs.rank_gaps(blk_candidates(spark, d))


@query("prune_floor_cap", f"{PAIRS} SELECT s1_id, tgt_id, p FROM (SELECT *, {RANKS} FROM scored) WHERE r1 <= 2 AND p >= 0.1")
def prune_floor_cap(spark, d):
    return pairs.prune(scored(spark, d), "p", 0.1, 2)


def _context(prefix=""):
    return f"""{PAIRS}, r AS (SELECT *, {RANKS}, row_number() OVER (PARTITION BY s1_id, tgt_id[1:2] ORDER BY p DESC, tgt_id) AS rs, tgt_id[1:2] AS src FROM scored)
SELECT s1_id, tgt_id, r1 AS {prefix}c_rank_s1, rs AS {prefix}c_rank_s1src, rt AS {prefix}c_rank_tgt, max(p) OVER s AS {prefix}c_max_s1, coalesce(max(CASE WHEN r1 > 1 THEN p END) OVER s, 0) AS {prefix}c_2nd_s1,
 round(max(p) OVER s - p, 6) AS {prefix}c_gap_s1, round(sum(p) OVER s, 6) AS {prefix}c_sum_s1, (sum((p > 0.5)::INT) OVER s)::BIGINT AS {prefix}c_n50_s1, max(p) OVER ss AS {prefix}c_max_s1src,
 max(p) OVER t AS {prefix}c_max_tgt, (sum((p > 0.5)::INT) OVER t)::BIGINT AS {prefix}c_n50_tgt, count(*) OVER t AS {prefix}c_n_tgt,
 round(CASE WHEN rt = 1 THEN p - coalesce(max(CASE WHEN rt > 1 THEN p END) OVER t, 0) ELSE p - max(p) OVER t END, 6) AS {prefix}c_margin_tgt
FROM r WINDOW s AS (PARTITION BY s1_id), t AS (PARTITION BY tgt_id), ss AS (PARTITION BY s1_id, src)"""


query("ctx_group_features", _context())(lambda spark, d: pairs.group_features(scored(spark, d), "p"))
query("ctx_stage3", _context("q_"))(lambda spark, d: pairs.group_features(scored(spark, d), "p", "q_"))


@query(
    "raw_score_shape",
    f"""{PAIRS}, r AS (SELECT *, {RANKS}, tgt_id[1:2] AS src, least(greatest(p, 0.000001::DOUBLE), 1 - 0.000001::DOUBLE) AS q FROM scored),
e AS (SELECT *, -(q * ln(q) + (1 - q) * ln(1 - q)) AS ent, (p > 0.5)::BIGINT AS h5, (p > 0.9)::BIGINT AS h9 FROM r)
SELECT s1_id, tgt_id, (sum(h5) OVER s - h5)::BIGINT AS g5_n05, (sum(h9) OVER s - h9)::BIGINT AS g5_n09, round(sum(p) OVER s - p, 6) AS g5_sum, round(sum(ent) OVER s - ent, 6) AS g5_ent,
 (sum(h9) OVER ss - h9)::BIGINT AS g5_n09_same_src, (sum(h9) OVER s - sum(h9) OVER ss)::BIGINT AS g5_n09_other_src, count(*) OVER s - 1 AS g5_ncand,
 CASE WHEN r1 = 1 THEN coalesce(max(CASE WHEN r1 > 1 THEN p END) OVER s, 0) ELSE max(p) OVER s END AS g5_pmax_other
FROM e WINDOW s AS (PARTITION BY s1_id), ss AS (PARTITION BY s1_id, src)""",
)
def raw_score_shape(spark, d):
    return pairs.score_shape(scored(spark, d), "p")


# ---- decision and evaluation

_IN_TRUTH = "(s1_id, tgt_id) IN (SELECT (s1_id, tgt_id) FROM truth)"
query("dec_many_to_one", f"{PAIRS} SELECT s1_id, tgt_id, p FROM (SELECT *, {RANKS} FROM scored) WHERE rt = 1")(lambda spark, d: pairs.many_to_one(scored(spark, d), "p"))
query("rule_boost", f"{PAIRS} SELECT s1_id, tgt_id, CASE WHEN {_IN_TRUTH} THEN greatest(p, 0.95::DOUBLE) ELSE p END AS p FROM scored")(lambda spark, d: pairs.boost(scored(spark, d), truth(spark, d), "p"))
query("rule_exclude", f"{PAIRS} SELECT s1_id, tgt_id, CASE WHEN {_IN_TRUTH} THEN 0.0::DOUBLE ELSE p END AS p FROM scored")(lambda spark, d: pairs.exclude(scored(spark, d), truth(spark, d), "p"))


def per_entity(pred: str) -> str:
    """f: n_pred, n_true, tp and F of every reference record, given a SELECT of accepted pairs."""
    return f""", pr AS (SELECT DISTINCT s1_id, tgt_id FROM ({pred})), th AS (SELECT DISTINCT s1_id, tgt_id FROM truth),
per AS (
 SELECT entity_id AS s1_id, (SELECT count(*) FROM pr WHERE pr.s1_id = entity_id) AS n_pred, (SELECT count(*) FROM th WHERE th.s1_id = entity_id) AS n_true,
  (SELECT count(*) FROM pr JOIN th USING (s1_id, tgt_id) WHERE s1_id = entity_id) AS tp FROM entity WHERE k = 1),
f AS (SELECT *, round(CASE WHEN n_pred + n_true = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END, 6) AS f FROM per)"""


_HALF = "SELECT s1_id, tgt_id FROM scored WHERE p >= 0.5"


@query("eval_per_entity", f"{PAIRS}{per_entity(_HALF)} SELECT * FROM f")
def eval_per_entity(spark, d):
    return pairs.per_entity(scored(spark, d).where("p >= 0.5"), truth(spark, d), s1(spark, d))


@query("eval_macro_fbeta", f"{PAIRS}{per_entity(_HALF)} SELECT round(avg(f), 6) AS macro_f, count(*) AS n FROM f")
def eval_macro_fbeta(spark, d):
    return eval_per_entity(spark, d).agg(F.round(F.avg("f"), 6).alias("macro_f"), F.count("*").alias("n"))


@query("eval_blocking_ceiling", f"{PAIRS}{per_entity(f'SELECT s1_id, tgt_id FROM scored WHERE {_IN_TRUTH}')} SELECT * FROM f")
def eval_blocking_ceiling(spark, d):
    return decide.perfect_matcher(scored(spark, d), truth(spark, d), s1(spark, d))


@query(
    "eval_error_report",
    f"""{PAIRS}{per_entity(_HALF)} SELECT country, least(n_true, 6) AS n_true, count(*) AS n, round(avg(f), 6) AS macro_f, sum(n_pred - tp)::BIGINT AS false_positives, sum(n_true - tp)::BIGINT AS false_negatives
FROM f JOIN entity ON entity_id = s1_id GROUP BY country, least(n_true, 6)""",
)
def eval_error_report(spark, d):
    return decide.error_report(scored(spark, d).where("p >= 0.5"), truth(spark, d), s1(spark, d))


@query("eval_stressed", f"{PAIRS} SELECT s1_id, tgt_id, p FROM scored WHERE NOT (s1_id[4:]::BIGINT % 1000003 * 40503 % 65536 % 1000 < 200)")
def eval_stressed(spark, d):
    return decide.stressed(scored(spark, d)).select("s1_id", "tgt_id", "p")


@query("stage_mean_scores", f"{PAIRS} SELECT s1_id, tgt_id, (p + score) / 2 AS p FROM scored JOIN tn USING (s1_id, tgt_id)")
def stage_mean_scores(spark, d):
    return decide.mean_scores(scored(spark, d), search(spark, d, "n").withColumnRenamed("score", "p"), "p")


@query("dec_best_k", f"{PAIRS}{sql.BEST} SELECT s1_id, len(ps)::INT AS n, k::INT AS k FROM best")
def dec_best_k(spark, d):
    g = scored(spark, d).groupBy("s1_id").agg(F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, 12).alias("ps"))
    return g.select("s1_id", F.size("ps").alias("n"), decision.best_k(F.col("ps")).cast("int").alias("k"))


@query("dec_expected_f_select", f"{PAIRS}{sql.BEST} SELECT s1_id, tgt_id, p FROM (SELECT *, {RANKS} FROM scored) JOIN best USING (s1_id) WHERE r1 <= k")
def dec_expected_f_select(spark, d):
    return decide.expected_f_select(scored(spark, d), "p")


@query(
    "tok_stats",
    f"""{ENTITY}, w AS (SELECT country, k = 1 AS ref, unnest(list_distinct(string_split(name, ' '))) AS t FROM entity),
c AS (SELECT country, t, count(*) FILTER (WHERE ref) AS df1, count(*) FILTER (WHERE NOT ref) AS dft FROM w WHERE t <> '' GROUP BY ALL),
n AS (SELECT country, greatest(1, count(*) FILTER (WHERE k = 1)) AS n1, greatest(1, count(*) FILTER (WHERE k > 1)) AS nt FROM entity GROUP BY ALL),
x AS (SELECT *, round(ln((dft + 1)::DOUBLE) - ln((df1 + 1)::DOUBLE) - ln(nt::DOUBLE / n1), 6) AS f FROM c JOIN n USING (country))
SELECT country, t, df1, dft, CASE WHEN df1 > 0 THEN round(ln(df1::DOUBLE / n1), 6) END AS share1, f, df1::DOUBLE / n1 >= 0.01::DOUBLE AND f < 0.3::DOUBLE AS cat FROM x""",
)
def tok_stats(spark, d):
    e = src.entities(spark, d)
    return pairs.token_stats(e.where("k = 1"), e.where("k > 1"), 0.01, 0.3)


@query(
    "fold_assign",
    f"""{ENTITY} SELECT entity_id, CASE WHEN h < 4 THEN 'A' WHEN h < 8 THEN 'B' ELSE 'H' END AS fold, doc_id % 1000003 * 40503 % 65536 % 1000 < 200 AS orphan
FROM (SELECT *, (doc_id % 1000003 * 2654435761) % 4294967296 % 10 AS h FROM entity)""",
)
def fold_assign(spark, d):
    return src.entities(spark, d).select("entity_id", pairs.fold(F.col("entity_id")).alias("fold"), pairs.orphan(F.col("entity_id"), 0.2).alias("orphan"))
