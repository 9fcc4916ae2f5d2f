"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import let, written

#: Words of a shingle, hashes kept.
WORDS, K = 5, 128


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes (32 bits, as long) of the word shingles of a text, repeats included.

    Words are what ASCII white space parts, lower-cased; fewer words than a shingle give the whole sequence, none gives
    an empty array, null is an empty text.
    """

    def shingles(h):
        n = F.size(h)
        at = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(words)]), 32)
        return F.when(n >= words, F.transform(F.sequence(F.lit(0), n - words), at)).when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 32))).otherwise(F.array().cast("array<bigint>"))

    w = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return let(F.transform(w, lambda x: F.xxhash64(x)), shingles)


def sketch(text: Column, words: int = WORDS, k: int = K) -> Column:
    """The k least distinct shingle hashes, ascending; all of them where there are fewer."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1; two empty sketches are alike (1)."""
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / share of the hash range."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((F.element_at(a, -1).cast("double") + 1) / float(1 << 32)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union over a, at most 1."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as eight hex digits a hash; equal texts have equal strings."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def numbered(keys: DataFrame, order: list[Column]) -> DataFrame:
    """``keys`` with ``g``, 0 to n - 1 in that order; no task holds more than a range of them.

    A range sort, each row's place in its partition, and the partitions' sizes added up (one row a partition).
    """
    placed = keys.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_pos")).drop("_at"), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("g", F.col("_before") + F.col("_pos")).drop("_part", "_pos", "_before")


def fingerprint_edits(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """Each document against an edited text and against the next document.

    Next is by descending doc_id (null last; rows of one doc_id in table order), after the last the first. The edited
    text has the last floor(n_chars / 2) code points replaced by as many first ones of the next document, or all of it.
    A single row is its own next. Null texts are empty. Repeated rows each have a row of their own.

    Only ids are sorted; each text meets its neighbour's ids in one shuffle by row number, and sends its beginning and
    its sketch in a second. Both uses of the first read the same columns, so that Spark runs one exchange for them.
    """
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    keys = numbered(t.select("rid", "doc_id", F.floor(F.length("text") / 2).cast("int").alias("half")), [F.desc_nulls_last("doc_id"), F.col("rid")])
    n = keys.count()
    # the row that comes before this one, and how much of this text it takes
    prev = keys.select("rid", ((F.col("g") - 1 + n) % max(n, 1)).alias("g")).join(keys.select("g", F.col("rid").alias("prev"), F.col("half").alias("prev_half")), "g").select("rid", "prev", "prev_half")
    t = t.join(prev, "rid").select("rid", "doc_id", "text", sketch(F.col("text"), words, k).alias("own"), "prev", "prev_half")
    sent = t.select(F.col("prev").alias("rid"), F.expr("substring(text, 1, prev_half)").alias("start"), F.col("own").alias("next"), F.col("doc_id").alias("next_doc_id"))
    e = t.select("rid", "doc_id", "text", "own").join(sent, "rid")
    chars = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.col("start"))
    e = e.select("doc_id", "next_doc_id", chars.cast("long").alias("n_chars"), "own", "next", F.struct(F.sha2(edited.cast("binary"), 256).alias("sha"), sketch(edited, words, k).alias("sketch")).alias("edit"))
    return e.select("doc_id", "n_chars", F.col("edit.sha").alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edit.sketch")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("edit.sketch"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next"), k).alias("near_next"), "next_doc_id", distinct_count(F.col("own"), k).alias("distinct_shingles"), containment(F.col("edit.sketch"), F.col("own"), k).alias("edited_in_own"))
