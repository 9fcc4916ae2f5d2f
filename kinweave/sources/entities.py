"""Sources and sinks: tab-separated records, match lists, and the linkage view of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated records without quoting; an empty field is an empty string."""
    df = spark.read.schema(SOURCE).option("sep", "\t").option("quote", "").option("header", True).option("nullValue", "\x00").csv(path)
    return df.fillna("").withColumnsRenamed({"business_name": "name", "business_address": "address"})


def explode_truth(df: DataFrame) -> DataFrame:
    """s1_id, tgt_id of lists of ids (source1_entity_id, matched_entity_ids); blanks are dropped."""
    ids = F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("tgt_id")
    return df.select(F.col("source1_entity_id").alias("s1_id"), ids).select("s1_id", F.trim("tgt_id").alias("tgt_id")).where("tgt_id <> ''")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
    return explode_truth(spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).csv(path))


def id_lists(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each s1_id of ``s1``: its distinct tgt_ids, sorted, joined by commas; an empty string where there are none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("tgt_id")), ",").alias("ids"))
    return s1.select("s1_id").distinct().join(lists, "s1_id", "left").select("s1_id", F.coalesce("ids", F.lit("")).alias("ids"))


def write_id_lists(s1: DataFrame, pairs: DataFrame, path: str) -> None:
    id_lists(s1, pairs).orderBy("s1_id").write.option("sep", "\t").option("quote", "").option("emptyValue", "").option("header", True).csv(path)


def checked(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """``matches``, all of which must be among ``candidates``."""
    if not matches.join(candidates, ["s1_id", "tgt_id"], "left_anti").isEmpty():
        raise ValueError("a match is not among the candidates")
    return matches


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, k (1 reference, 2 and 3 targets), doc_id, entity_id, name, compact, addr, head of every document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    tokens = F.array_remove(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), "")
    d = d.select("doc_id", F.col("lang").alias("country"), (F.substring("source", 4, 9).cast("int") % 3 + 1).alias("k"), tokens.alias("t"), F.substring(F.lower("text"), 1, 200).alias("head"))
    name = F.array_join(F.slice("t", 1, 6), " ")
    addr = F.trim(F.concat_ws(" ", (F.col("doc_id") % 97).cast("string"), F.array_join(F.slice("t", 7, 6), " ")))
    return d.select("country", F.col("k").cast("int").alias("k"), "doc_id", F.concat(F.lit("S"), F.col("k"), F.lit("-"), F.col("doc_id")).alias("entity_id"), name.alias("name"), F.regexp_replace(name, " ", "").alias("compact"), addr.alias("addr"), "head")


def truth(e: DataFrame) -> DataFrame:
    """Pairs of a reference and a target record of one country with equal beginnings."""
    s1 = e.where("k = 1").select("country", "head", F.col("entity_id").alias("s1_id"))
    return s1.join(e.where("k > 1").select("country", "head", F.col("entity_id").alias("tgt_id")), ["country", "head"]).select("s1_id", "tgt_id")


#: Words that variants of names get, and how the second number of a variant differs from the first.
ADDED = ("group", "club", "holding", "union", "care")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate pair made of every document: two names and addresses of its first words, varied by the document's number.

    s1_id, tgt_id, country, label, p, and of both sides (a_, b_) the fields of a normal record: core, compact, parts, legal, initials, indic,
    addr, words, nums, first, state, addr_empty. The linkage view has few pairs that differ by one word; here every kind of
    difference has many: the same, one word added, swapped, dropped, abbreviated, other numbers and streets, no address.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    t = F.array_remove(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), "")
    n, w = F.col("doc_id"), F.col("t")
    pick = lambda i, *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1) if i is None else F.element_at(F.array(*map(F.lit, values)), i.cast("int") + 1)
    joined = lambda a, k: F.array_join(F.slice(w, a, k), " ")
    word, kind, step = pick(None, *ADDED), F.floor(n / 7) % 6, F.floor(n / 3) % 5
    x = d.select("doc_id", F.col("lang").alias("country"), t.alias("t"))
    base, first = joined(1, 4), (100 + n % 97)
    second = F.when(step <= 1, first).when(step == 2, first + 1).when(step == 3, first + 400).otherwise(first * 10 + n % 10)
    na = F.when(kind == 3, F.concat(base, F.lit(" "), word)).otherwise(base)
    nb = F.when(kind.isin(1, 4), F.concat(base, F.lit(" "), word)).when(kind == 2, F.concat(joined(1, 3), F.lit(" "), word)).when(kind == 5, F.concat(joined(1, 3), F.lit(" "), F.substring(F.coalesce(F.get(w, F.lit(3)), F.lit("")), 1, 3))).otherwise(base)
    street, other = joined(5, 3), joined(8, 3)
    wa, wb = F.when(n % 11 == 0, "").otherwise(street), F.when(n % 13 == 0, "").when(F.floor(n / 2) % 3 < 2, street).otherwise(other)
    x = x.select("*", F.trim(na).alias("na"), F.trim(nb).alias("nb"), wa.alias("wa"), wb.alias("wb"), first.cast("string").alias("fa"), second.cast("string").alias("fb"))
    side = {}
    for s, name, words, number, legal, state in (("a", "na", "wa", "fa", pick(None, "ltd", "inc", ""), pick(None, "al", "ak", "")), ("b", "nb", "wb", "fb", pick(None, "ltd", "ltd pvt", "inc", ""), pick(None, "al", "ak", "", "al", "al"))):
        toks = F.array_remove(F.split(name, " "), "")
        empty = F.col(words) == ""
        side |= {
            f"{s}_core": F.col(name), f"{s}_compact": F.replace(F.col(name), F.lit(" "), F.lit("")),
            f"{s}_parts": F.when((n % 7 == 0) & (F.size(toks) >= 4), F.concat(F.array_join(F.slice(toks, 1, 2), " "), F.lit("|"), F.array_join(F.slice(toks, 3, 9), " "))).otherwise(""),
            f"{s}_legal": legal, f"{s}_initials": F.array_join(F.transform(toks, lambda c: F.substring(c, 1, 1)), ""), f"{s}_indic": F.lit(False),
            f"{s}_addr": F.when(empty, "").otherwise(F.concat(F.col(number), F.lit(" "), F.col(words))), f"{s}_words": F.col(words),
            f"{s}_nums": F.when(empty, "").otherwise(F.col(number)), f"{s}_first": F.when(empty, "").otherwise(F.col(number)), f"{s}_state": state, f"{s}_addr_empty": empty,
        }
    ids = [F.concat(F.lit("S1-"), F.floor(n / 2)).alias("s1_id"), F.concat(F.lit("S"), 2 + n % 2, F.lit("-"), F.floor(n / 3)).alias("tgt_id")]
    return x.select(*ids, "country", (n % 3 == 0).cast("int").alias("label"), ((n * 37) % 1000 / 1000).alias("p"), *[c.alias(k) for k, c in side.items()])
