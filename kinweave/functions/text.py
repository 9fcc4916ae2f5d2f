"""Normalisation of names and addresses as column expressions."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of legal forms and their canonical forms; words dropped from names; digits read as letters.
LEGAL = {
    "private": "pvt", "pvt": "pvt", "pvte": "pvt", "limited": "ltd", "ltd": "ltd", "incorporated": "inc", "inc": "inc",
    "corporation": "corp", "corp": "corp", "company": "co", "co": "co", "llc": "llc", "llp": "llp", "lp": "lp", "pllc": "pllc",
    "plc": "plc", "pc": "pc", "pa": "pa", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "eurl": "eurl", "sci": "sci",
    "snc": "snc", "selarl": "selarl", "gmbh": "gmbh", "ets": "ets", "etablissements": "ets", "etablissement": "ets",
}
NAME_STOP = ("the", "and", "of", "de", "du", "des", "la", "le", "les", "et", "d", "l")
OCR_FROM, OCR_TO = "0134578", "oleastb"
# Letters without a decomposition, domains read as names, words between two names of one firm.
SPELT = (("œ", "oe"), ("æ", "ae"), ("ß", "ss"))
LONE_FROM, LONE_TO = "øđłı’‘–—", "odli''--"
DOMAINS = "com|net|org|in|co|biz|info|io|fr|us"
ALSO = r"\b(?:d\s*/\s*b\s*/\s*a|d\.b\.a\.?|dba|doing business as|formerly known as|formerly|f/k/a|a/k/a|trading as|t/a)(?=\W|$)"
INDIC = "[\u0900-\u0d7f]"


def _accents() -> tuple[str, str]:
    """Small letters of the Latin blocks that are a plain letter with marks, and that letter; then what is dropped: marks and joiners."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        d = unicodedata.normalize("NFKD", c.lower())
        if len(c.lower()) == 1 and len(d) > 1 and d[0].isascii() and all(0x300 <= ord(m) < 0x370 for m in d[1:]):
            found[c.lower()] = d[0]
    return "".join(found), "".join(found.values())


FOLD_FROM, FOLD_TO = _accents()
DROPPED = "".join(map(chr, range(0x300, 0x370))) + "\u200c\u200d"


def fold(text: Column) -> Column:
    """Small letters without accents, loose marks or joiners; ligatures spelt out. Other scripts keep their marks."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELT:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.translate(t, FOLD_FROM + LONE_FROM + DROPPED, FOLD_TO + LONE_TO)


def strip_contact(text: Column) -> Column:
    """Phone numbers and "m/s" become spaces, a web address its domain's name."""
    t = F.regexp_replace(text, r"\+?[0-9][0-9\s-]{8,}[0-9]", " ")
    t = F.regexp_replace(t, rf"(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*)\.(?:{DOMAINS})\b", " $1 ")
    return F.regexp_replace(t, r"\bm\s*/\s*s\b", " ")


def ocr_fix(token: Column) -> Column:
    """Digits of a token with three letters or more are read as letters."""
    mixed = token.rlike("[0-9]") & (F.length(F.regexp_replace(token, "[^a-z]", "")) >= 3)
    return F.when(mixed, F.translate(token, OCR_FROM, OCR_TO)).otherwise(token)


def tokens(text: Column) -> Column:
    """Dots deleted, other marks to spaces, split, digits read as letters."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"\.", ""), "[^a-z0-9\u0900-\u0d7f]+", " "))
    return F.transform(F.array_remove(F.split(t, " "), ""), ocr_fix)


def legal_forms(toks: Column) -> Column:
    """Sorted distinct canonical legal forms among tokens, joined by spaces."""
    m = F.create_map(*map(F.lit, chain.from_iterable(LEGAL.items())))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(toks, lambda t: F.try_element_at(m, t)), lambda x: x.isNotNull()))), " ")


def core_tokens(toks: Column) -> Column:
    """Tokens that are neither legal forms nor stop words, a token equal to the one kept before it dropped."""
    kept = F.filter(toks, lambda t: ~t.isin(*LEGAL, *NAME_STOP))
    return F.transform(F.array(kept), lambda k: F.filter(k, lambda t, i: (i == 0) | (t != F.get(k, i - 1))))[0]


def name_core(toks: Column) -> Column:
    return F.array_join(core_tokens(toks), " ")


def name_parts(raw: Column) -> Column:
    """The folded names of one raw name, split where one firm is said to trade as another."""
    return F.filter(F.split(strip_contact(fold(raw)), ALSO), lambda p: F.trim(p) != "")


def normal_name(raw: Column, spelt=None) -> Column:
    """core, compact, parts (of two names or more, by |), legal, initials, indic of a raw name; empty ones of an empty or null name.
    ``spelt``: a function for words in Indic script."""
    split = F.transform(name_parts(raw), tokens)
    if spelt is not None:
        split = F.transform(split, lambda ts: F.filter(F.transform(ts, lambda t: F.when(t.rlike(INDIC), spelt(t)).otherwise(t)), lambda t: t != ""))
    cores = F.filter(F.transform(split, core_tokens), lambda c: F.size(c) > 0)
    all_ = F.flatten(cores)
    core = F.array_join(all_, " ")
    return F.struct(
        core.alias("core"),
        F.replace(core, F.lit(" "), F.lit("")).alias("compact"),
        F.when(F.size(cores) > 1, F.array_join(F.transform(cores, lambda c: F.array_join(c, " ")), "|")).otherwise("").alias("parts"),
        legal_forms(F.flatten(split)).alias("legal"),
        F.array_join(F.transform(all_, lambda t: F.substring(t, 1, 1)), "").alias("initials"),
        F.coalesce(raw.rlike(INDIC), F.lit(False)).alias("indic"),
    )


def numbers(text: Column) -> Column:
    """Distinct runs of digits in order, without leading zeros."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")))


def fixed_width(name: Column, address: Column) -> Column:
    """Name in 40 places, address in 72: where it is longer, its first 55 characters, a mark and its last 16."""
    n = F.rpad(F.coalesce(name, F.lit("")), 40, "~")
    a = F.coalesce(address, F.lit(""))
    return F.concat(n, F.rpad(F.when(F.length(a) > 72, F.concat(F.substring(a, 1, 55), F.lit("^"), F.right(a, F.lit(16)))).otherwise(a), 72, "~"))
