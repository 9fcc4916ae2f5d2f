"""Evidence of raw names: what was typed, which edits lead from one to the other, and which of these copies show."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.strings import edit_script
from kinweave.functions.words import order_fraction

# Words of legal forms as they are written, vowels, rows of a keyboard.
LEGAL = frozenset(
    "pvt private ltd limited llp llc inc incorporated corp corporation co company pc pllc lp llc. plc sarl sas sasu sa eurl sci snc sca selarl opc ltda pa psc".split()
)
VOWELS = frozenset("aeiouy")
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_key = {c: (r, i) for r, row in enumerate(KEYS) for i, c in enumerate(row)}

AR = ("noaddr", "s1noaddr", "same", "same_nonum", "diffnum", "num_only", "other")
NR = ("exact", "fuzzy_eq", "acro", "alias", "add1", "add2+", "drop1", "drop2+", "swap1", "multi")


def pair_types(p: DataFrame, score: str) -> DataFrame:
    """s1_id, tgt_id, ar, nr, tr: how the addresses stand to each other, how the names do, and whether the record is its target's best claimant.

    p: a_tset, nf_eq, addr_empty_a, addr_empty_b, name_exact, acro, n_tset, tc_n_ua, tc_n_ub and ``score``; the first case that fits counts.
    """
    ar = F.expr(
        """CASE WHEN addr_empty_b = 1 THEN 'noaddr' WHEN addr_empty_a = 1 THEN 's1noaddr' WHEN a_tset >= 0.95 AND nf_eq = 1 THEN 'same'
        WHEN a_tset >= 0.95 AND nf_eq IS NULL THEN 'same_nonum' WHEN a_tset >= 0.8 AND nf_eq = 0 THEN 'diffnum' WHEN nf_eq = 1 THEN 'num_only' ELSE 'other' END"""
    )
    nr = F.expr(
        """CASE WHEN name_exact = 1 THEN 'exact' WHEN tc_n_ua = 0 AND tc_n_ub = 0 THEN 'fuzzy_eq' WHEN acro = 1 THEN 'acro' WHEN n_tset < 0.5 THEN 'alias'
        WHEN tc_n_ua = 0 AND tc_n_ub = 1 THEN 'add1' WHEN tc_n_ua = 0 AND tc_n_ub >= 2 THEN 'add2+' WHEN tc_n_ua = 1 AND tc_n_ub = 0 THEN 'drop1'
        WHEN tc_n_ua >= 2 AND tc_n_ub = 0 THEN 'drop2+' WHEN tc_n_ua = 1 AND tc_n_ub = 1 THEN 'swap1' ELSE 'multi' END"""
    )
    first = F.row_number().over(Window.partitionBy("tgt_id").orderBy(F.desc(score), "s1_id")) == 1
    return p.select("s1_id", "tgt_id", ar.alias("ar"), nr.alias("nr"), F.when(first, "t1").otherwise("t2+").alias("tr"))


def raw_record(name: Column) -> Column:
    """Struct of a raw name: small (lower case), words, case (U upper, L lower, T titled, M mixed), brackets (their contents, by |), legal."""
    n = F.coalesce(name, F.lit(""))
    small = F.lower(n)
    words = F.filter(F.split(small, r"(?U)[^\w]+"), lambda w: w != "")
    letters = F.regexp_replace(n, r"[^\p{L}]", "")
    titled = (letters != "") & ~n.rlike(r"\p{L}\p{Lu}") & ~n.rlike(r"(?<!\p{L})\p{Ll}")
    case = F.when((letters != "") & (n == F.upper(n)), "U").when((letters != "") & (n == small), "L").when(titled, "T").otherwise("M")
    inside = F.transform(F.regexp_extract_all(n, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda p: F.lower(F.trim(p)))
    return F.struct(small.alias("small"), words.alias("words"), case.alias("case"), F.array_join(inside, "|").alias("brackets"), F.array_join(F.filter(words, lambda w: w.isin(*sorted(LEGAL))), " ").alias("legal"))


def raw_features(p: DataFrame) -> DataFrame:
    """s1_id, tgt_id and fourteen rn_ columns of pairs of raw names (na, nb): what is equal, whether words are in another order, and
    the insertions, deletions, replacements, edits at the ends (two characters) and edits of a shortest script of the words."""
    @F.pandas_udf("struct<ins:int,del:int,sub:int,edge:int,ops:int>")
    def script(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(x, y):
            ops = edit_script(a, b)
            kinds = [k for k, _, _ in ops]
            rows.append((kinds.count("insert"), kinds.count("delete"), kinds.count("replace"), sum(i < 2 or i >= len(a) - 2 for _, i, _ in ops), len(ops)))
        return pd.DataFrame(rows, columns=["ins", "del", "sub", "edge", "ops"])

    x = p.select("s1_id", "tgt_id", raw_record(F.col("na")).alias("a"), raw_record(F.col("nb")).alias("b"))
    wa, wb = F.array_join("a.words", " "), F.array_join("b.words", " ")
    x = x.withColumn("e", script(wa, wb))
    eq = lambda f: (F.col(f"a.{f}") == F.col(f"b.{f}")).cast("int")
    n = lambda f: (F.col(f"a.{f}") != "").cast("int") + (F.col(f"b.{f}") != "").cast("int")
    return x.select(
        "s1_id", "tgt_id", eq("small").alias("rn_cf_eq"), eq("words").alias("rn_alnum_eq"),
        ((F.array_sort("a.words") == F.array_sort("b.words")) & (F.col("a.words") != F.col("b.words"))).cast("int").alias("rn_reordered"),
        F.round(order_fraction(F.col("a.words"), F.col("b.words")), 6).alias("rn_order_frac"), eq("case").alias("rn_case_same"),
        F.when(n("brackets") > 0, eq("brackets")).alias("rn_paren_eq"), n("brackets").alias("rn_paren_n"),
        F.when(n("legal") == 2, eq("legal")).alias("rn_legal_eq"), n("legal").alias("rn_legal_n"),
        F.col("e.ins").alias("rn_ins"), F.col("e.del").alias("rn_del"), F.col("e.sub").alias("rn_sub"), F.col("e.edge").alias("rn_edge_ops"), F.col("e.ops").alias("rn_ops"),
    )


# ---- edits by type, and what they tell of copies

TYPED = ("accent", "punct", "dup", "transp", "vowel", "cons", "kbd", "digit", "inner")


def _bare(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def near_keys(a: str, b: str) -> bool:
    """Whether two letters are neighbours on a keyboard: at most one row and one place apart."""
    return a in _key and b in _key and all(abs(x - y) <= 1 for x, y in zip(_key[a], _key[b]))


def word_lcs(x: list[str], y: list[str]) -> int:
    row = [0] * (len(y) + 1)
    for w in x:
        last = 0
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
    return row[-1]


def transformation(name: str | None, other: str | None) -> dict:
    """Edits from one raw name to another by type, substitutions ("a>b"), legal forms ("x>y"), dropped and added words, whether the first and the
    last word are kept, and the words' common subsequence (of the longer) less their Jaccard."""
    a, b = (name or "").casefold(), (other or "").casefold()
    n, subs, last = dict.fromkeys(TYPED, 0), [], None
    for kind, i, j in edit_script(a, b):
        x, y = "" if kind == "insert" else a[i], "" if kind == "delete" else b[j]
        c = x or y
        n["inner"] += 2 <= i < len(a) - 2
        n["digit"] += c.isdigit()
        if not c.isalnum():
            n["punct"] += 1
        elif kind == "replace" and _bare(x)[:1] == _bare(y)[:1]:
            n["accent"] += 1
        elif kind == "replace":
            subs.append(f"{x}>{y}")
            turned = last is not None and last[0] == "replace" and last[1] == i - 1 and a[i - 1] == y and b[last[2]] == x
            n["transp" if turned else "vowel" if x in VOWELS and y in VOWELS else "cons"] += 1
            n["kbd"] += near_keys(x, y)
        else:  # a letter beside one like it
            beside = a[max(0, i - 1) : i] + (a[i : i + 1] if kind == "insert" else a[i + 1 : i + 2])
            n["dup"] += c in beside
        last = (kind, i, j)
    u, v = ([_bare(t) for t in re.split(r"[^\w]+", s) if t] for s in (a, b))
    legal = [" ".join(t for t in w if t in LEGAL) for w in (u, v)]
    dropped, added = ([t for t in w if t not in set(o) and t not in LEGAL] for w, o in ((u, v), (v, u)))
    union = set(u) | set(v)
    moved = word_lcs(u, v) / max(len(u), len(v), 1) - len(set(u) & set(v)) / max(len(union), 1)
    return n | {"sub": subs, "legal": ">".join(legal), "drop": dropped, "add": added, "first": float(bool(u) and u[0] in v), "last": float(bool(u) and u[-1] in v), "lcs": moved}


def transformed(p: DataFrame) -> DataFrame:
    """``p`` (raw names na, nb) with ``t``, the struct of ``transformation``."""
    kinds = ", ".join(f"{k}:int" for k in TYPED) + ", sub:array<string>, legal:string, drop:array<string>, add:array<string>, first:double, last:double, lcs:double"

    @F.pandas_udf(f"struct<{kinds}>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([transformation(a, b) for a, b in zip(x, y)], columns=[*TYPED, "sub", "legal", "drop", "add", "first", "last", "lcs"])

    return p.withColumn("t", run("na", "nb"))


def _keys(p: DataFrame) -> DataFrame:
    """s1_id, tgt_id, kind, key of all templates of pairs with ``t``; repeats of a key count."""
    one = lambda kind, c: F.transform(c, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    all_ = F.concat(one("legal", F.array("t.legal")), one("sub", F.col("t.sub")), one("drop", F.col("t.drop")), one("add", F.col("t.add")))
    return p.select(*[c for c in p.columns if c != "t"], F.explode(all_).alias("e")).select(*[c for c in p.columns if c != "t"], "e.kind", "e.key")


def template_tables(p: DataFrame, min_count: int = 5) -> DataFrame:
    """kind, key, llr: ln of how much likelier a template is among copies (label 1) than among others, each count raised by one."""
    n1, n0 = p.agg(F.count_if(F.col("label") == 1)).scalar(), p.agg(F.count_if(F.col("label") == 0)).scalar()
    c = _keys(p.select("s1_id", "tgt_id", "label", "t")).groupBy("kind", "key").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0"))
    llr = F.ln((F.col("c1") + 1) / (n1 + 2)) - F.ln((F.col("c0") + 1) / (n0 + 2))
    return c.where(F.col("c0") + F.col("c1") >= min_count).select("kind", "key", F.round(llr, 6).alias("llr"))


def template_features(p: DataFrame, tables: DataFrame) -> DataFrame:
    """s1_id, tgt_id and nineteen g8_ columns of pairs with ``t``: typed edits, words kept, and sums and minima of the templates' llr (0 if unknown)."""
    k = _keys(p.select("s1_id", "tgt_id", "t")).join(tables, ["kind", "key"], "left").withColumn("llr", F.coalesce("llr", F.lit(0.0)))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("llr"))
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    sums = {f"g8_{kind}_llr": zero(F.sum(of(kind))) for kind in ("legal", "sub", "drop", "add")}
    least = {f"g8_{kind}_min": zero(F.min(of(kind))) for kind in ("drop", "add")}
    g = k.groupBy("s1_id", "tgt_id").agg(*[c.alias(n) for n, c in (sums | least | {"g8_copy_llr": zero(F.sum("llr"))}).items()])
    named = {"accent": "accent", "punct": "punct", "dup": "dup", "transp": "transp", "vowel_sub": "vowel", "cons_sub": "cons", "kbd_sub": "kbd", "digit_ops": "digit", "inner_ops": "inner", "first_kept": "first", "last_kept": "last"}
    own = p.select("s1_id", "tgt_id", *[F.col(f"t.{c}").alias(f"g8_{n}") for n, c in named.items()], F.round("t.lcs", 6).alias("g8_lcs_minus_set"))
    return own.join(g, ["s1_id", "tgt_id"])
