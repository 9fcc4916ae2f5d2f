"""Learned Latin spellings of words and of parts of addresses in Indic scripts, and their use on records."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import address, text
from kinweave.functions.text import INDIC
from kinweave.functions.translit import romanised


def most_often(cases: DataFrame, min_count: int = 2, min_share: float = 0.5) -> DataFrame:
    """tok, best, n: for each tok of the cases (tok, best) its most frequent best, with ``min_count`` cases or more, and ``min_share`` of the tok's. Ties by best."""
    n = cases.groupBy("tok", "best").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tok")
    n = n.select("*", F.sum("n").over(w).alias("all_"), F.row_number().over(w.orderBy(F.desc("n"), "best")).alias("rk"))
    return n.where((F.col("rk") == 1) & (F.col("n") >= min_count) & (F.col("n") >= min_share * F.col("all_"))).select("tok", "best", "n")


def _words(raw: str) -> Column:
    return text.tokens(text.fold(F.col(raw)))


def _parts(raw: str) -> Column:
    return F.filter(F.transform(F.split(text.fold(F.col(raw)), "[,;|]"), address.component), lambda p: p != "")


def word_spellings(pairs: DataFrame, min_count: int = 2, min_share: float = 0.5) -> DataFrame:
    """tok, best, n: Latin spellings of Indic words, learned from true pairs (a_name, b_name) of equally many words; legal forms in one form."""
    legal = F.create_map(*map(F.lit, chain.from_iterable(text.LEGAL.items())))
    both = pairs.select(_words("a_name").alias("a"), _words("b_name").alias("b")).where("size(a) = size(b)")
    cases = both.select(F.explode(F.arrays_zip("b", "a")).alias("z")).select(F.col("z.b").alias("tok"), F.col("z.a").alias("word"))
    cases = cases.where(F.col("tok").rlike(INDIC) & ~F.col("word").rlike(INDIC))
    return most_often(cases.select("tok", F.coalesce(F.try_element_at(legal, F.col("word")), F.col("word")).alias("best")), min_count, min_share)


def part_spellings(pairs: DataFrame, states=None, min_count: int = 2, min_share: float = 0.5) -> DataFrame:
    """tok, best, n: states that a part in Indic script stands for, learned from true pairs (country, a_address, b_address) with one
    state of the country on one side and one such part on the other."""
    states = address.STATES if states is None else states
    known = F.coalesce(*[F.when(F.col("country") == c, F.array(*map(F.lit, m))) for c, m in states.items() if m], F.array().cast("array<string>"))
    x = pairs.select(known.alias("known"), _parts("a_address").alias("a"), _parts("b_address").alias("b"))
    x = x.select(F.filter("a", lambda p: F.array_contains("known", p)).alias("a"), F.filter("b", lambda p: p.rlike(INDIC)).alias("b")).where("size(a) = 1 AND size(b) = 1")
    return most_often(x.select(F.col("b")[0].alias("tok"), F.col("a")[0].alias("best")), min_count, min_share)


def with_spellings(e: DataFrame, words: DataFrame, parts: DataFrame) -> DataFrame:
    """``e`` (entity_id, name, address) with _words and _parts: what of a record's own Indic words and parts has a learned spelling; null if none has.

    Each record gets its own small maps, so that the learned tables may be of any size; a frequent word is left to the adaptive skew join.
    """
    indic = e.where(F.col("name").rlike(INDIC) | F.col("address").rlike(INDIC))
    in_parts = F.flatten(F.transform(_parts("address"), lambda p: F.split(p, " ")))

    def looked_up(keys: Column, table: DataFrame, name: str) -> DataFrame:
        k = indic.select("entity_id", F.explode(F.array_distinct(F.filter(keys, lambda w: w.rlike(INDIC)))).alias("tok")).join(table.select("tok", "best"), "tok")
        return k.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("tok", "best"))).alias(name))

    found = looked_up(F.concat(_words("name"), in_parts), words, "_words")
    return e.join(found, "entity_id", "left").join(looked_up(_parts("address"), parts, "_parts"), "entity_id", "left")


def spelt_word(w: Column) -> Column:
    """A word as learned, else letter by letter; needs ``with_spellings``."""
    return F.coalesce(F.try_element_at(F.col("_words"), w), romanised(w))


def spelt_part(p: Column) -> Column:
    """A part of an address as learned as a whole, else word by word."""
    by_word = F.array_join(F.transform(F.split(p, " "), lambda w: F.when(w.rlike(INDIC), spelt_word(w)).otherwise(w)), " ")
    return F.coalesce(F.try_element_at(F.col("_parts"), p), by_word)
