"""Relations of two numbers, two words and two word lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subsequence(short: Column, long: Column) -> Column:
    """Whether the characters of ``short`` are in ``long`` in their order."""
    met = F.aggregate(F.sequence(F.lit(0), F.length(long)), F.lit(0), lambda at, j: F.when((j > 0) & (F.substring(short, at + 1, F.lit(1)) == F.substring(long, j, F.lit(1))) & (at < F.length(short)), at + 1).otherwise(at))
    return met == F.length(short)


def is_abbreviation(short: Column, long: Column) -> Column:
    """At most five characters, fewer than the long word's, from its first one on and in its order."""
    fits = (F.length(short) > 0) & (F.length(short) <= 5) & (F.length(short) < F.length(long))
    return fits & (F.substring(short, 1, 1) == F.substring(long, 1, 1)) & subsequence(short, long)


def number_relation(a: Column, b: Column) -> Column:
    """How two digit strings differ: na where one is null or empty, then eq, one digit more (indel), one other digit (sub),
    two neighbours in turn (transpose), near<=4, near<=20 or far; the first that fits. Over 38 digits nothing is near."""
    apart = F.abs(a.try_cast("decimal(38,0)") - b.try_cast("decimal(38,0)"))
    turned = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b
    transposed = (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), turned)
    one = F.levenshtein(a, b) == 1
    empty = F.coalesce(F.length(a), F.lit(0)) * F.coalesce(F.length(b), F.lit(0)) == 0
    return F.when(empty, "na").when(a == b, "eq").when(one & (F.length(a) != F.length(b)), "indel").when(one, "sub").when(transposed, "transpose").when(apart <= 4, "near<=4").when(apart <= 20, "near<=20").otherwise("far")


def order_fraction(a: Column, b: Column) -> Column:
    """Of the words of ``a`` that ``b`` has, repeats included, the share of neighbours that come in the same order in ``b``, by the last
    place there; null for fewer than two."""
    last = lambda w: F.size(b) - F.array_position(F.reverse(b), w)
    places = F.transform(F.filter(a, lambda w: F.array_contains(b, w)), last)
    steps = lambda p: F.size(F.filter(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.get(p, i - 1) < F.get(p, i)))
    return F.transform(F.array(places), lambda p: F.when(F.size(p) >= 2, steps(p) / (F.size(p) - 1)))[0]


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning over the shorter length; null where one is empty."""
    least = F.least(F.length(a), F.length(b))
    upto = F.filter(F.sequence(F.lit(0), least), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(least > 0, (F.size(upto) - 1) / least)


def number_features(a: Column, b: Column) -> dict[str, Column]:
    """nf_eq, nf_lev, nf_contain (one begins or ends with the other, equal ones too), nf_logdiff (of the first 15 digits) of two digit
    strings; null where one is empty."""
    known = (F.length(a) > 0) & (F.length(b) > 0)
    near = a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a)
    apart = F.abs(F.substring(a, 1, 15).cast("long") - F.substring(b, 1, 15).cast("long"))
    features = {"nf_eq": (a == b).cast("int"), "nf_lev": F.levenshtein(a, b), "nf_contain": near.cast("int"), "nf_logdiff": F.round(F.log1p(apart), 6)}
    return {name: F.when(known, c) for name, c in features.items()}
