"""DuckDB SQL that the registered queries share."""

from __future__ import annotations

from kinweave.sources.entities import ADDED

WORDS = "list_filter(string_split({}, ' '), lambda w: w <> '')"

ENTITY = r"""WITH d0 AS (
 SELECT doc_id, lang AS country, source[4:]::INT % 3 + 1 AS k, lower(text)[1:200] AS head,
  list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM documents),
entity AS (
 SELECT country, k, doc_id, 'S' || k || '-' || doc_id AS entity_id, array_to_string(t[1:6], ' ') AS name, array_to_string(t[1:6], '') AS compact,
  trim((doc_id % 97) || ' ' || array_to_string(t[7:12], ' ')) AS addr, head FROM d0),
truth AS (
 SELECT a.entity_id AS s1_id, b.entity_id AS tgt_id FROM entity a JOIN entity b ON a.country = b.country AND a.head = b.head AND a.k = 1 AND b.k > 1)"""

_W = """,
{v}tf AS (SELECT country, k, entity_id, f, count(*) AS tf FROM (SELECT country, k, entity_id, unnest({grams}) AS f FROM entity) GROUP BY ALL),
{v}x AS (
 SELECT t.*, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS x FROM {v}tf t JOIN (SELECT country, f, count(*) AS df FROM {v}tf GROUP BY ALL) USING (country, f)
 JOIN (SELECT country, count(*) AS n FROM entity GROUP BY ALL) USING (country)),
{v}w AS (SELECT country, k, entity_id, f, x / sqrt(sum(x * x) OVER (PARTITION BY entity_id)) AS w FROM {v}x)"""
N = _W.format(v="n", grams="list_transform(range(1, length(compact) + 1), lambda i: substr('^^' || compact || '$', i, 4))")
A = _W.format(v="a", grams="list_filter(string_split(addr, ' '), lambda x: x <> '')")
NA = """,
naw AS (SELECT country, k, entity_id, 'n:' || f AS f, w * sqrt(0.5) AS w FROM nw UNION ALL SELECT country, k, entity_id, 'a:' || f, w * sqrt(0.5) FROM aw)"""


def top(o: str, v: str, q: str, t: str, k: int, share: float | None, feats: int = 1_000_000) -> str:
    """Search of records where ``q`` holds among those where ``t`` does; ``o`` names the result (s1_id, tgt_id, score, rk). Without a share: over all features."""
    if share is None:
        return f""",
{o}s AS (
 SELECT q.entity_id AS s1_id, t.entity_id AS tgt_id, round(sum(q.w * t.w), 6) AS score
 FROM (SELECT * FROM {v}w WHERE {q}) q JOIN (SELECT * FROM {v}w WHERE {t}) t USING (country, f) GROUP BY ALL),
{o} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, tgt_id) AS rk FROM {o}s) WHERE rk <= {k})"""
    return f""",
{o}r AS (
 SELECT country, f FROM {v}w JOIN (SELECT country, count(DISTINCT entity_id) AS n FROM {v}w WHERE {t} GROUP BY ALL) USING (country)
 WHERE {t} GROUP BY country, f, n HAVING count(*) <= greatest(1000, floor({share} * n))),
{o}q AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(w, 9) DESC, f) AS rk FROM {v}w JOIN {o}r USING (country, f) WHERE {q}) WHERE rk <= {feats}),
{o}s AS (
 SELECT q.entity_id AS s1_id, t.entity_id AS tgt_id, round(sum(q.w * t.w), 6) AS score
 FROM {o}q q JOIN (SELECT * FROM {v}w WHERE {t}) t USING (country, f) GROUP BY ALL),
{o} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, tgt_id) AS rk FROM {o}s) WHERE rk <= {k})"""


def both(o: str, v: str, k: int, share: float | None, feats: int = 1_000_000) -> str:
    """Forward search among the targets of source 2 and of source 3."""
    found = "".join(top(f"{o}{s}", v, "k = 1", f"k = {s}", k, share, feats) for s in (2, 3))
    return f"{found},\n{o} AS (SELECT * FROM {o}2 UNION ALL SELECT * FROM {o}3)"


TOPN, TOPA = both("tn", "n", 3, 0.003), both("ta", "a", 3, 0.003, 10)
PAIRS = f"""{ENTITY}{N}{A}{TOPN}{TOPA},
scored AS (SELECT s1_id, tgt_id, max(score) AS p FROM (SELECT s1_id, tgt_id, score FROM tn UNION ALL SELECT s1_id, tgt_id, score FROM ta) GROUP BY ALL)"""
EXACT = """ SELECT a.entity_id AS s1_id, b.entity_id AS tgt_id
 FROM (SELECT *, count(*) OVER (PARTITION BY country, name) AS n FROM entity WHERE k = 1 AND name <> '') a
 JOIN (SELECT *, count(*) OVER (PARTITION BY country, name) AS n FROM entity WHERE {t} AND name <> '') b ON a.country = b.country AND a.name = b.name
 WHERE a.n <= 5 AND b.n <= 20"""


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two expressions."""
    cell = f"CASE WHEN substr({a}, p_i::INT, 1) = substr({b}, p_j::INT, 1) THEN coalesce(p_up[p_j - 1], 0) + 1 ELSE greatest(p_up[p_j], coalesce(p_acc[-1], 0)) END"
    row = f"list_reduce(range(1, length({b}) + 1), lambda p_acc, p_j: list_append(p_acc, {cell}), CAST([] AS BIGINT[]))"
    table = f"list_reduce(range(1, length({a}) + 1), lambda p_up, p_i: {row}, list_resize(CAST([] AS BIGINT[]), length({b}), 0))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE ({table})[-1] END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ({lcs(a, b)}) / (length({a}) + length({b})) END"


def sorted_words(a: str) -> str:
    return f"array_to_string(list_sort({WORDS.format(a)}), ' ')"


def token_set(source: str, a: str, b: str, where: str) -> str:
    """SELECT of s1_id, tgt_id, v: the token-set ratio of columns a and b of ``source``, null unless ``where`` holds."""
    return f"""SELECT s1_id, tgt_id, CASE WHEN NOT ({where}) THEN NULL WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN i <> '' AND (l = '' OR r = '') THEN 1
  ELSE round(greatest({ratio("il", "ir")}, CASE WHEN i <> '' THEN greatest({ratio("i", "il")}, {ratio("i", "ir")}) ELSE 0 END), 6) END AS v
 FROM (SELECT *, trim(i || ' ' || l) AS il, trim(i || ' ' || r) AS ir FROM (
  SELECT *, array_to_string(list_sort(list_intersect(x, y)), ' ') AS i, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS l,
   array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS r
  FROM (SELECT *, list_distinct({WORDS.format(a)}) AS x, list_distinct({WORDS.format(b)}) AS y FROM {source})))"""


def _pick(values, at: str = "doc_id") -> str:
    return f"list_extract({list(values)!r}, ({at} % {len(values)})::INT + 1)"


def _side(s: str, name: str, words: str, number: str, legal: str, state: str) -> str:
    toks = WORDS.format(name)
    return f"""{name} AS {s}_core, replace({name}, ' ', '') AS {s}_compact,
  CASE WHEN doc_id % 7 = 0 AND len({toks}) >= 4 THEN array_to_string({toks}[1:2], ' ') || '|' || array_to_string({toks}[3:11], ' ') ELSE '' END AS {s}_parts,
  {legal} AS {s}_legal, array_to_string(list_transform({toks}, lambda c: c[1]), '') AS {s}_initials,
  CASE WHEN {words} = '' THEN '' ELSE {number} || ' ' || {words} END AS {s}_addr, {words} AS {s}_words,
  CASE WHEN {words} = '' THEN '' ELSE {number} END AS {s}_nums, CASE WHEN {words} = '' THEN '' ELSE {number} END AS {s}_first, {state} AS {s}_state, {words} = '' AS {s}_addr_empty"""


VARIANTS = f"""WITH v0 AS (
 SELECT doc_id, lang AS country, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS t,
  {_pick(ADDED)} AS word, (doc_id // 7) % 6 AS kind, (doc_id // 3) % 5 AS step, 100 + doc_id % 97 AS f1 FROM documents),
v1 AS (
 SELECT doc_id, country, f1::VARCHAR AS fa,
  (CASE WHEN step <= 1 THEN f1 WHEN step = 2 THEN f1 + 1 WHEN step = 3 THEN f1 + 400 ELSE f1 * 10 + doc_id % 10 END)::VARCHAR AS fb,
  trim(array_to_string(t[1:4], ' ') || CASE WHEN kind = 3 THEN ' ' || word ELSE '' END) AS na,
  trim(CASE WHEN kind IN (1, 4) THEN array_to_string(t[1:4], ' ') || ' ' || word WHEN kind = 2 THEN array_to_string(t[1:3], ' ') || ' ' || word
   WHEN kind = 5 THEN array_to_string(t[1:3], ' ') || ' ' || coalesce(t[4], '')[1:3] ELSE array_to_string(t[1:4], ' ') END) AS nb,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE array_to_string(t[5:7], ' ') END AS wa,
  CASE WHEN doc_id % 13 = 0 THEN '' WHEN (doc_id // 2) % 3 < 2 THEN array_to_string(t[5:7], ' ') ELSE array_to_string(t[8:10], ' ') END AS wb FROM v0),
var AS (
 SELECT 'S1-' || (doc_id // 2) AS s1_id, 'S' || (2 + doc_id % 2) || '-' || (doc_id // 3) AS tgt_id, country, (doc_id % 3 = 0)::INT AS label, ((doc_id * 37) % 1000) / 1000.0::DOUBLE AS p,
  {_side("a", "na", "wa", "fa", _pick(["ltd", "inc", ""]), _pick(["al", "ak", ""]))},
  {_side("b", "nb", "wb", "fb", _pick(["ltd", "ltd pvt", "inc", ""]), _pick(["al", "ak", "", "al", "al"]))} FROM v1)"""

#: The variants with what the rules read: the addresses' token-set ratio, whether first numbers are equal, added and dropped words.
RULES = f"""{VARIANTS}, ts AS ({token_set("var", "a_addr", "b_addr", "a_addr <> '' AND b_addr <> ''")}),
x AS (
 SELECT var.*, ts.v AS a_sim, CASE WHEN a_first <> '' AND b_first <> '' THEN (a_first = b_first)::INT END AS nf_eq,
  list_sort(list_distinct(list_filter({WORDS.format("b_core")}, lambda w: NOT list_contains({WORDS.format("a_core")}, w)))) AS added,
  list_sort(list_distinct(list_filter({WORDS.format("a_core")}, lambda w: NOT list_contains({WORDS.format("b_core")}, w)))) AS dropped
 FROM var JOIN ts USING (s1_id, tgt_id)),
adds AS (SELECT *, added[1] AS w FROM x WHERE len(added) = 1 AND len(dropped) = 0),
swaps AS (SELECT *, dropped[1] AS w_from, added[1] AS w_to FROM x WHERE len(added) = 1 AND len(dropped) = 1),
ac AS (
 SELECT *, round(ln((d + 1)::DOUBLE / (s + 1)), 6) AS llr
 FROM (SELECT country, w, count(*) FILTER (WHERE a_sim >= 0.8 AND nf_eq = 0) AS d, count(*) FILTER (WHERE a_sim >= 0.95 AND nf_eq = 1) AS s FROM adds GROUP BY ALL))"""

RANKS = "row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, tgt_id) AS r1, row_number() OVER (PARTITION BY tgt_id ORDER BY p DESC, s1_id) AS rt"


def poisson(ps: str) -> str:
    """Chances of 0, 1, ... true labels."""
    return f"list_reduce({ps}, lambda d, x: list_transform(range(1, len(d) + 2), lambda i: coalesce(d[i], 0) * (1 - x[1]) + coalesce(d[i - 1], 0) * x[1]), [1.0::DOUBLE])"


#: best: s1_id, ps (the 12 best scores), k (how many to accept) of scored pairs in ``scored``.
BEST = f""", g AS (SELECT s1_id, list([p] ORDER BY p DESC, tgt_id)[1:12] AS ps FROM scored GROUP BY s1_id),
kk AS (SELECT *, {poisson("ps[1:k]")} AS top, {poisson("ps[k + 1:]")} AS rest FROM (SELECT s1_id, ps, unnest(range(0, len(ps) + 1)) AS k FROM g)),
va AS (
 SELECT *, round(CASE WHEN k = 0 THEN rest[1]
  ELSE list_sum(list_transform(range(1, len(top)), lambda a: list_sum(list_transform(range(0, len(rest)), lambda b: top[a + 1] * rest[b + 1] * 1.25 * a / (0.25 * (a + b) + k))))) END, 12) AS v FROM kk),
best AS (SELECT s1_id, ps, k FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY v DESC, k) AS rk FROM va) WHERE rk = 1)"""
