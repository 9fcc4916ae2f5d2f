"""Exact top-k search: BM25 over an inverted index in shards, with pruning by block maxima."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import give_back, written

K1, B = 1.2, 0.75
#: A posting's weight is a multiple of 1 / UNIT: sums are exact, in whatever order and shard they are made.
UNIT = 1 << 20
#: Postings (or documents) of a shard at which the next one begins, bytes of text that a shard is made of, distinct (query, term) entries of a block of queries.
SHARD_POSTINGS, SHARD_BYTES, BLOCK_ENTRIES = 6_000_000, 32 << 20, 2_000_000
#: Documents of a block whose greatest weight is kept for each frequent word: one that at least a share DENSE of a shard's documents have,
#: as far as their rows have DENSE_CELLS weights together.
BLOCK, DENSE, DENSE_CELLS = 64, 1 / 16, 8_000_000
#: Lists of fewer than LONG postings are added up for all queries of a group at once. A group has STEP queries, or more as long as it has GROUP_CELLS sums.
LONG, STEP, GROUP_CELLS = 64, 16, 2_000_000
#: Postings whose weights are worked out at once: their parts take ten times the room of a weight.
WEIGHED = 1 << 18
#: Shards, at least, of the first wave; each later wave has about as many as all before it.
FIRST = 4
_word = re.compile(r"[^\W_]+")

_INDEX = "level int, ids array<long>, copies binary, lens binary, terms array<string>, dfs array<int>, sizes array<int>, docs binary, tfs binary"


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased; none for null."""
    return _word.findall((text or "").lower())


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids, text: the rows (doc_id, text) of a batch that have equal texts as one; a null text is empty."""
    for b in batches:
        text = pc.fill_null(b.column(1), "").dictionary_encode()
        of = text.indices.to_numpy()
        ends = np.cumsum(np.bincount(of, minlength=len(text.dictionary)))
        ids = b.column(0).take(pa.array(np.argsort(of, kind="stable")))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), ids), text.dictionary], names=["ids", "text"])


def _alike(of: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """A small number for each of ``n`` texts, given (text, word) pairs: the same for texts on the same sides of the main axes of frequent words,
    such as texts of a language. It orders texts and decides nothing."""
    df = np.bincount(term)
    frequent = np.argsort(-df, kind="stable")[:128]
    column = np.full(len(df), -1)
    column[frequent] = np.arange(len(frequent))
    column = column[term]
    x = np.zeros((n, len(frequent)), np.float32)
    x[of[column >= 0], column[column >= 0]] = 1
    x -= x.mean(axis=0)
    axes = np.linalg.eigh((x.T @ x).astype(float))[1][:, -3:]
    return (x @ axes > 0) @ (1 << np.arange(axes.shape[1]))


def build(docs: DataFrame, postings: int = SHARD_POSTINGS) -> DataFrame:
    """The inverted index, a row a shard: documents by likeness and length (``ids``, ``copies``, ``lens``), terms with the counts of rows and of
    documents that have them, and the places and counts of each term in turn. Every row of ``docs`` is in one shard, also those without words.

    Rows meet by their text, and those of equal texts in a shard are one document with as many ``copies``, its ids together: least first,
    null last. Half of the tasks make shards of ``level`` 0, a quarter of level 1, and so on, evenly over the table."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        seen: dict[bytes, list] = {}
        ids, lens, sizes, term, tf = [], array("i"), array("i"), array("i"), array("i")
        task = TaskContext.get().partitionId() + 1
        level = (task & -task).bit_length() - 1

        def packed() -> pa.RecordBatch:
            n, length = len(ids), np.frombuffer(lens, "<i4")
            doc, t = np.repeat(np.arange(n, dtype="<i4"), np.frombuffer(sizes, "<i4")), np.frombuffer(term, "<i4")
            order = np.lexsort((length, _alike(doc, t, n))) if len(t) else np.arange(n)
            place = np.empty(n, "<i4")
            place[order] = np.arange(n, dtype="<i4")
            copies = np.array([len(x) for x in ids], "<i4")
            df = np.bincount(t, copies[doc], len(known)).astype("<i4")
            doc = place[doc]
            by = np.lexsort((doc, t))
            own = [i for j in order.tolist() for i in sorted(ids[j], key=lambda i: (i is None, i or 0))]
            columns = [level], [own], [copies[order].tobytes()], [length[order].tobytes()], [list(known)], [df], [np.bincount(t, minlength=len(known)).astype("<i4")], [doc[by].tobytes()], [np.frombuffer(tf, "<i4")[by].tobytes()]
            types = pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["level", "ids", "copies", "lens", "terms", "dfs", "sizes", "docs", "tfs"])

        for b in batches:
            for own, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                key = hashlib.blake2b(text.encode(), digest_size=16).digest()
                if key in seen:
                    seen[key].extend(own)
                    continue
                seen[key] = own
                w = words(text)
                c = Counter(w)
                ids.append(own)
                lens.append(len(w))
                sizes.append(len(c))
                term.extend([known.setdefault(x, len(known)) for x in c])
                tf.extend(c.values())
                if max(len(term), len(ids)) >= postings:
                    yield packed()
                    known, seen = {}, {}
                    ids, lens, sizes, term, tf = [], array("i"), array("i"), array("i"), array("i")
        if ids:
            yield packed()
        b = own = text = w = c = None
        known, seen = {}, {}
        ids, lens, sizes, term, tf = [], array("i"), array("i"), array("i"), array("i")
        give_back()

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    return docs.mapInArrow(_merged, "ids array<long>, text string").repartition(tasks, F.xxhash64("text")).mapInArrow(shards, _INDEX)


class Shard:
    """One shard, with the weights of the terms of a block of queries."""

    def __init__(self, row: dict, vocabulary: pa.Array, idf: np.ndarray, average: float):
        ids = row["ids"].values
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.copies = np.frombuffer(row["copies"].as_buffer(), "<i4").astype(np.intp)
        self.first = np.cumsum(self.copies) - self.copies
        self.n_blocks = -(-len(self.copies) // BLOCK)
        size = row["sizes"].values.to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.index_in(row["terms"].values, value_set=vocabulary)
        mine = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False)[mine]
        chosen = np.repeat(np.isin(np.arange(len(size)), mine), size)
        self.doc = np.frombuffer(row["docs"].as_buffer(), "<i4")[chosen]
        tf = np.frombuffer(row["tfs"].as_buffer(), "<i4")[chosen]
        norm = K1 * (1 - B + B * (np.frombuffer(row["lens"].as_buffer(), "<i4") / average))
        self.size = size = size[mine]
        self.off = np.concatenate([[0], np.cumsum(size)])
        idf_of, self.weight = np.repeat(idf[at], size), np.empty(len(tf), "<i4")
        for x in (slice(i, i + WEIGHED) for i in range(0, len(tf), WEIGHED)):
            self.weight[x] = np.rint(idf_of[x] * (tf[x] * (K1 + 1) / (tf[x] + norm[self.doc[x]])) * UNIT)
        self.list_of = np.full(len(vocabulary), -1)
        self.list_of[at] = np.arange(len(mine))
        self.bound = np.maximum.reduceat(self.weight, self.off[:-1]).astype(float) if len(mine) else np.zeros(0)
        frequent = np.argsort(-size, kind="stable")[: DENSE_CELLS // (self.n_blocks * BLOCK)]
        frequent = frequent[size[frequent] >= DENSE * len(self.copies)]
        self.row_of = np.full(len(mine), -1)
        self.row_of[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((self.n_blocks, len(frequent), BLOCK))
        for r, t in enumerate(frequent):
            s = slice(self.off[t], self.off[t + 1])
            self.dense[self.doc[s] // BLOCK, r, self.doc[s] % BLOCK] = self.weight[s]
        self.long = {t: (self.doc[self.off[t] : self.off[t + 1]], self.weight[self.off[t] : self.off[t + 1]]) for t in np.flatnonzero((size >= LONG) & (self.row_of < 0)).tolist()}
        self.most = self.dense.max(axis=2).T

    def best(self, queries: list[np.ndarray], k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query that has any, its number, and places in ``ids`` and scores of all rows that may be among its best k,
        given that k rows have ``least``."""
        lists = [x[x >= 0] for x in (self.list_of[q] for q in queries)]
        some = [q for q, x in enumerate(lists) if len(x) and self.bound[x].sum() >= least[q]]
        many = max(STEP, GROUP_CELLS // (self.n_blocks * BLOCK))
        for at in range(0, len(some), many):
            group = some[at : at + many]
            for q, score in zip(group, self._scores([lists[q] for q in group], least[group])):
                doc = np.flatnonzero(score >= max(least[q], 1.0))
                if len(doc):
                    yield q, *self._rows(doc, score[doc], k)

    def _scores(self, lists: list[np.ndarray], least: np.ndarray) -> np.ndarray:
        """The sums of all documents for the queries with these lists; sums below ``least`` may lack a part.

        Lists of the words that are not frequent are added up. What frequent words can add to a document of a block is at most the sum of their
        maxima in it: only blocks that reach the threshold with it go on, and all their documents get the weights of frequent words as one product.
        """
        score, asked, short = np.zeros((len(lists), self.n_blocks * BLOCK)), np.zeros((len(lists), len(self.most))), []
        for i, x in enumerate(lists):
            row = self.row_of[x]
            asked[i, row[row >= 0]] = 1
            x = x[row < 0]
            long = self.size[x] >= LONG
            if long.any():
                doc, weight = zip(*[self.long[t] for t in x[long].tolist()])
                score[i] = np.bincount(np.concatenate(doc, dtype=np.intp), np.concatenate(weight, dtype=float), score.shape[1])
            short.append(x[~long])
        of, t = np.repeat(np.arange(len(lists)), [len(x) for x in short]), np.concatenate(short)
        n = self.size[t]
        at = np.arange(n.sum()) + np.repeat(self.off[t] - np.cumsum(n) + n, n)
        np.add.at(score.reshape(-1), np.repeat(of * score.shape[1], n) + self.doc[at], self.weight[at].astype(float))
        blocks = score.reshape(len(lists), self.n_blocks, BLOCK)
        bound = asked @ self.most
        alive = (bound > 0) & (blocks.max(axis=2) + bound >= least[:, None])
        used = np.flatnonzero(asked.any(axis=0))
        asked = asked[:, used]
        for b in np.flatnonzero(alive.any(axis=0)):
            on = np.flatnonzero(alive[:, b])
            blocks[on, b] += asked[on] @ self.dense[b][used]
        return score

    def _rows(self, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` and scores, given documents and their sums: of those that, with their copies, may be among the best k."""
        if len(doc) > k:
            stay = score >= np.partition(score, len(doc) - k)[len(doc) - k]
            doc, score = doc[stay], score[stay]
        by = np.argsort(-score, kind="stable")
        doc, score = doc[by], score[by]
        enough = np.searchsorted(np.cumsum(self.copies[doc]), k)
        if enough < len(doc):
            stay = score >= score[enough]
            doc, score = doc[stay], score[stay]
        n = np.minimum(self.copies[doc], k)
        return np.arange(n.sum()) + np.repeat(self.first[doc] - np.cumsum(n) + n, n), np.repeat(score, n)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, postings: int = SHARD_POSTINGS, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """query_id, rank, doc_id, score: the best ``k`` documents of each row of ``queries`` (query_id, text) by BM25.

    A query is the set of the words of its whole text; the score is the sum over its words of
    ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average length)), each term
    rounded to 1 / UNIT, with N, df and the average over all documents. Best is by score, then by least doc_id (null
    last). Documents that share no word with a query are not found for it, so a query may have fewer rows, and one
    without words (null, empty, punctuation) none. Repeated rows of documents are found one by one, repeated queries
    answered one by one; empty tables give an empty result. Other columns are not read.

    Rows of equal texts are one document of the index, found with as many of its ids as are among the best k.
    The index is written once to the shared folder. Queries go over it in blocks of about ``entries`` words, each
    block sent to every task; equal queries are answered once. A block goes over the shards in waves, each about as
    large as all before it: a wave's tasks know the k-th best (score, doc_id) that the earlier ones found for a query and
    return only what comes before it, k at most. So a query's rows grow with the number of waves, the logarithm of the
    table, and not with the tasks. The rows meet by query after each wave. Besides, the texts are shuffled once, and the counts of words.
    """
    spark = docs.sparkSession

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(words(x.as_py()))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["query_id", "terms"])

    index = written(build(docs, postings), "index")
    asked_ = queries.select(F.col("query_id").cast("long"), "text").mapInArrow(asked, "query_id long, terms array<string>").where("size(terms) > 0")
    asked_ = written(asked_.select("query_id", F.sha2(F.concat_ws(" ", "terms"), 256).alias("query"), "terms"), "queries")
    n, lengths = index.select("lens", "copies").mapInArrow(_lengths, "n long, words long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("words")).first()
    once = written(asked_.groupBy("query").agg(F.first("terms").alias("terms")).withColumn("number", F.monotonically_increasing_id()), "distinct")
    entry = once.select("number", F.explode("terms").alias("term"))
    counted = index.select(F.inline(F.arrays_zip("terms", "dfs"))).toDF("term", "df")
    df = counted.join(entry.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    n_blocks = max(1, -(-entry.count() // entries))
    block = F.pmod(F.xxhash64("number"), F.lit(n_blocks))
    entry = written(entry.join(df, "term").select(block.alias("block"), "number", "term", "df"), "weighted")
    levels = index.groupBy("level").count().collect() if n else []
    best = [_in_waves(index, part, _waves({r["level"]: r["count"] for r in levels}), n, lengths / n or 1.0, k) for part in _parts(entry, n_blocks if n else 0)]
    if not best:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    best = reduce(DataFrame.unionByName, best).groupBy("number").agg(F.collect_list(F.struct("rank", "doc_id", "score")).alias("found"))
    return asked_.select("query", "query_id").join(once.select("query", "number"), "query").join(best, "number").select("query_id", F.inline("found"))


def _parts(entry: DataFrame, n_blocks: int) -> Iterator[pa.Table]:
    for i in range(n_blocks):
        part = entry.where(F.col("block") == i).select("number", "term", "df").toArrow()
        if part.num_rows:
            yield part


def _waves(shards: dict[int, int]) -> list[list[int]]:
    """The levels of each wave, given each level's shards: the highest levels first, until they have FIRST, then one by one."""
    waves: list[list[int]] = [[]]
    for level in sorted(shards, reverse=True):
        if sum(shards[x] for x in waves[0]) >= FIRST:
            waves.append([])
        waves[-1].append(level)
    return waves


def _in_waves(index: DataFrame, part: pa.Table, waves: list[list[int]], n: int, average: float, k: int) -> DataFrame:
    """number, rank, doc_id, score: the best ``k`` of every query of one block, wave by wave."""
    best, floor = None, None
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for wave in waves:
        found = _search(index.where(F.col("level").isin(wave)), part, n, average, k, floor)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        if wave is not waves[-1]:
            # one row a query of the block
            floor = best.where(F.col("rank") == k).select("number", "score", "doc_id").toArrow()
    return best


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lens, copies = ([np.frombuffer(x.as_buffer(), "<i4").astype(np.int64) for x in c] for c in b.columns)
        yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in copies], pa.int64()), pa.array([int(x @ c) for x, c in zip(lens, copies)], pa.int64())], names=["n", "words"])


def _search(index: DataFrame, part: pa.Table, n: int, average: float, k: int, floor: pa.Table | None) -> DataFrame:
    """number, doc_id, score: each task's best ``k`` of every query of one block (number, term, df), as far as they are not
    behind the query's row of ``floor`` (number, score, doc_id), the last of k rows that are known already."""
    term, query = part["term"].combine_chunks().dictionary_encode(), part["number"].combine_chunks().dictionary_encode()
    at, of = term.indices.to_numpy(), query.indices.to_numpy()
    df = np.zeros(len(term.dictionary))
    df[at] = part["df"].to_numpy()
    # queries that are alike are next to each other: a group of them has few frequent words
    by = np.argsort(_alike(of, at, len(query.dictionary)), kind="stable")
    number, names = np.empty(len(by), int), query.dictionary.take(pa.array(by))
    number[by] = np.arange(len(by))
    of = number[of]
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(names)))
    least, last = np.zeros(len(names)), np.full(len(names), np.iinfo(np.int64).max)
    if floor is not None:
        of = pc.index_in(floor["number"].combine_chunks(), value_set=names).to_numpy()
        least[of] = np.rint(floor["score"].to_numpy() * UNIT)
        last[of] = pc.fill_null(floor["doc_id"], np.iinfo(np.int64).max).to_numpy()
    sent = index.sparkSession.sparkContext.broadcast((term.dictionary, np.log(1 + (n - df + 0.5) / (df + 0.5)), names, np.split(at[order], ends[:-1]), least, last))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, names, queries, least, last = sent.value
        bests: dict[int, tuple] = {}
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard({c: b.column(c)[i] for c in b.schema.names[1:]}, vocabulary, idf, average)
                known = least.copy()
                for q, old in bests.items():
                    known[q] = max(least[q], old[0][-1] if len(old[0]) == k else 0.0)
                for q, place, score in shard.best(queries, k, known):
                    old = bests.get(q)
                    stay = (score > least[q]) | (shard.ids[place] <= last[q])
                    place, score = place[stay], score[stay]
                    if not len(place):
                        continue
                    new = score, shard.ids[place], shard.null[place]
                    if old is not None:
                        new = tuple(map(np.concatenate, zip(old, new)))
                    by = np.lexsort((new[2], new[1], -new[0]))[:k]
                    bests[q] = tuple(x[by] for x in new)
        if bests:
            score, ids, null = map(np.concatenate, zip(*bests.values()))
            which = np.repeat(list(bests), [len(x[0]) for x in bests.values()])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), pa.array(ids, mask=null), pa.array(score / UNIT)], names=["number", "doc_id", "score"])
        b = shard = known = old = new = by = stay = place = which = ids = null = score = None
        bests.clear()
        give_back()

    return index.mapInArrow(search, "number long, doc_id long, score double")


ORACLE = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::DOUBLE AS len FROM p GROUP BY doc_id),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(len) FROM l) AS total),
i AS (SELECT p.doc_id, p.term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len / (total / n))))) * 1048576)::BIGINT AS weight
 FROM p JOIN d USING (term) JOIN l USING (doc_id), c),
s AS (SELECT q.doc_id AS query_id, i.doc_id, sum(weight)::DOUBLE / 1048576 AS score FROM p q JOIN i USING (term) WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= 10
"""
