"""Candidate retrieval: sparse TF-IDF postings, top-k by an inverted-index join, exact cosines, provenance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.memory import give_back
from kinweave.sources import work

#: Postings of a block of targets, held by a task, and of a block of queries, which pass through it; fewer than LEAST_QUERIES aren't cut for more tasks.
TARGET_POSTINGS, QUERY_POSTINGS, LEAST_QUERIES = 3_000_000, 12_000_000, 50_000


def char_grams(text: Column, n: int) -> Column:
    """Grams of ``n`` characters, one ending at each character: the text is padded in front by n - 2 marks and behind by one."""
    padded = F.concat(F.lit("^" * (n - 2)), text, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.length(text) > 0, grams).otherwise(F.array().cast("array<string>"))


def term_counts(e: DataFrame, view: str) -> DataFrame:
    """country, k, entity_id, f, tf: character four-grams of the compact name (view n) or words of the address (a)."""
    grams = char_grams(F.col("compact"), 4) if view == "n" else F.array_remove(F.split("addr", " "), "")
    # a record's rows meet before they are cut into features: what follows is grouped where it is
    e = e.select("country", "k", "entity_id", "compact" if view == "n" else "addr").repartition("country", "k", "entity_id")
    return e.select("country", "k", "entity_id", F.explode(grams).alias("f")).groupBy("country", "k", "entity_id", "f").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("country", "f").agg(F.count("*").alias("df"))


def unit_vectors(e: DataFrame, tf: DataFrame) -> DataFrame:
    """country, k, entity_id, fs, ws: a row of features and weights (1 + ln tf) idf a record, of length one; idf is the country's, all sources pooled."""
    n = e.groupBy("country").agg(F.count("*").alias("n"))
    idf = document_frequency(tf).join(n, "country").select("country", "f", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, ["country", "f"]).withColumn("x", (1 + F.ln("tf")) * F.col("idf"))
    v = w.groupBy("country", "k", "entity_id").agg(F.collect_list(F.struct("f", "x")).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return v.select("country", "k", "entity_id", F.col("v.f").alias("fs"), F.transform("v.x", lambda x: x / F.col("norm")).alias("ws"))


def unit_weights(e: DataFrame, tf: DataFrame) -> DataFrame:
    """country, k, entity_id, f, w: the same, a row a posting."""
    return postings(unit_vectors(e, tf))


def postings(v: DataFrame) -> DataFrame:
    """The vectors ``v`` (fs, ws) with a row a posting (f, w)."""
    return v.select(*[c for c in v.columns if c not in ("fs", "ws")], F.inline(F.arrays_zip("fs", "ws"))).withColumnsRenamed({"fs": "f", "ws": "w"})


def packed(w: DataFrame) -> DataFrame:
    """Postings (country, entity_id, f, w) as vectors; vectors stay as they are. A record may have several rows of them."""
    if "fs" in w.columns:
        return w
    v = w.groupBy("country", "entity_id").agg(F.collect_list(F.struct("f", "w")).alias("v"))
    return v.select("country", "entity_id", F.col("v.f").alias("fs"), F.col("v.w").alias("ws"))


#: Of the targets of a country and source, the share that may have a feature; never fewer than LEAST_DF targets.
DF_SHARE, LEAST_DF = {"n": 0.003, "a": 0.003, "na": 0.01}, 1000


def combined(n: DataFrame, a: DataFrame) -> DataFrame:
    """The vectors of two views side by side, a row each, at half the square: cosines are the mean of both."""
    half = lambda d, v: d.select("country", "k", "entity_id", F.transform("fs", lambda f: F.concat(F.lit(f"{v}:"), f)).alias("fs"), F.transform("ws", lambda w: w * 0.5**0.5).alias("ws"))
    return half(n, "n").unionByName(half(a, "a"))


def _grid(q: DataFrame, t: DataFrame, most: int) -> tuple[DataFrame, int]:
    """country, n (its targets), nq, nt: into how many blocks its queries and targets are cut; and the number of tiles.

    Blocks of targets have about ``most`` postings. Queries are cut for the session's cores, by the country's share of them, or at QUERY_POSTINGS.
    """
    cores = q.sparkSession.sparkContext.defaultParallelism
    size = lambda c: F.sum(F.size("fs")).alias(c)
    g = q.groupBy("country").agg(size("q")).join(t.groupBy("country").agg(F.count_distinct("entity_id").alias("n"), size("t")), "country")
    g = g.withColumn("all", F.sum("q").over(Window.partitionBy())).withColumn("nt", F.greatest(F.lit(1), F.ceil(F.col("t") / most)))
    share = F.least(F.ceil(cores * F.col("q") / F.col("all") / F.col("nt")), F.ceil(F.col("q") / LEAST_QUERIES))
    g = g.select("country", "n", F.greatest(F.lit(1), share, F.ceil(F.col("q") / QUERY_POSTINGS)).cast("int").alias("nq"), F.col("nt").cast("int").alias("nt"))
    # a row a country: known before the plan, which holds them thrice
    got = g.collect()
    return F.broadcast(q.sparkSession.createDataFrame(got, g.schema)), max(1, sum(r["nq"] * r["nt"] for r in got))


def _block(c: str, n: str) -> Column:
    return F.pmod(F.xxhash64(c), F.col(n)).cast("int")


def _in_tiles(rows: DataFrame, tiles: int, run, schema: str) -> DataFrame:
    """``run`` over the rows of each tile (country, tile) in turn: side by side, each by id. Partitions go by the number of tiles: a tile is few bytes and much time."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return rows.repartition(2 * tiles, "country", "tile").sortWithinPartitions("country", "tile", "side", "id").mapInArrow(held, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Each tile, side and the rows of it, as they come."""
    for b in batches:
        keys, start = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)), 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start][:2], keys[start][2], b.slice(start, i - start)
                start = i


def _flat(rows: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """The distinct ids of rows in their order, and of each posting the place of its id, its feature and weight."""
    ids = pa.concat_arrays([r.column("id") for r in rows])
    first = np.ones(len(ids), bool)
    first[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
    size = np.concatenate([pc.list_value_length(r.column("fs")).to_numpy(zero_copy_only=False) for r in rows])
    f, w = (pa.concat_arrays([r.column(c).flatten() for r in rows]) for c in ("fs", "ws"))
    return ids.filter(pa.array(first)), np.repeat(np.cumsum(first) - 1, size), f, w.to_numpy(zero_copy_only=False)


#: Targets whose scores are looked through together; scores further apart than SLACK don't round to the same.
WIDE, SLACK = 64, 3e-6


class _Lists:
    """The postings of a block of targets by feature (all, if none are given); features are numbered in order, targets too."""

    def __init__(self, features: list[pa.Array], rows: list[pa.RecordBatch]):
        features = pa.concat_arrays(features) if features else pc.unique(pa.concat_arrays([r.column("fs").flatten() for r in rows]))
        self.features = features.take(pc.sort_indices(features))
        self.ids, doc, f, w = _flat(rows)
        code, doc, w = self.known(doc, f, w)
        by = np.argsort(code, kind="stable")
        code, doc, w = code[by], doc[by], w[by]
        first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(doc) != 0))[: len(code)])
        if len(first) < len(code):
            code, doc, w = code[first], doc[first], np.add.reduceat(w, first)
        self.doc, self.w = doc, w
        self.off = np.searchsorted(code, np.arange(len(self.features) + 1)).tolist()
        self.total, self.last = np.zeros(-(-len(self.ids) // WIDE) * WIDE), np.empty(len(self.ids), np.int64)

    def known(self, of: np.ndarray, f: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = pc.index_in(f, value_set=self.features).fill_null(-1).to_numpy(zero_copy_only=False)
        keep = code >= 0
        return code[keep], of[keep], w[keep]

    def scores(self, code: list[int], w: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Targets of a query, the best ``k`` among them, and their scores. Where it meets many, they are looked for in blocks of targets:
        the k-th greatest of the blocks' maxima is no greater than the k-th best score."""
        docs, total = [], self.total
        for c, x in zip(code, w, strict=True):
            a, b = self.off[c], self.off[c + 1]
            if a < b:
                d = self.doc[a:b]
                total[d] += x * self.w[a:b]
                docs.append(d)
        if sum(map(len, docs)) > len(total) // 8:
            most = total.reshape(-1, WIDE).max(axis=1)
            least = np.partition(most, len(most) - k)[len(most) - k] - SLACK if len(most) >= k else 0.0
            met = np.flatnonzero(total >= least) if least > 0 else np.flatnonzero(total)
            s = total[met]
            total.fill(0.0)
            return met, s
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0)
        met = np.concatenate(docs)
        place = np.arange(len(met))
        self.last[met] = place
        met = met[self.last[met] == place]
        s = total[met]
        total[met] = 0.0
        return met, s

    def best(self, rows: list[pa.RecordBatch], k: int, max_feats: int | None) -> pa.RecordBatch:
        """s1_id, tgt_id, score: the best ``k`` targets of each query."""
        ids, of, f, w = _flat(rows)
        code, of, w = self.known(of, f, w)
        if max_feats:
            by = np.lexsort((code, -np.floor(w * 1e9 + 0.5), of))
            code, of, w = code[by], of[by], w[by]
            keep = np.arange(len(of)) - np.searchsorted(of, of) < max_feats
            code, of, w = code[keep], of[keep], w[keep]
        by = np.lexsort((code, of))
        code, of, w = code[by], of[by], w[by]
        ends = np.searchsorted(of, np.arange(len(ids) + 1)).tolist()
        code, w = code.tolist(), w.tolist()
        which, found, score = [], [], []
        for i in range(len(ids)):
            met, s = self.scores(code[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]], k)
            if not len(met):
                continue
            s = np.floor(s * 1e6 + 0.5)
            if len(met) > k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                met, s = met[keep], s[keep]
            by = np.lexsort((met, -s))[:k]
            which.append(np.full(len(by), i))
            found.append(met[by])
            score.append(s[by])
        which, found, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, found, score))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(which)), self.ids.take(pa.array(found)), pa.array(score / 1e6)], names=["s1_id", "tgt_id", "score"])


def top_k(queries: DataFrame, targets: DataFrame, k: int, share: float | None = 0.003, max_feats: int | None = None, least: int = LEAST_DF, most: int = TARGET_POSTINGS) -> DataFrame:
    """s1_id, tgt_id, score, rk: the k targets of each query with the greatest dot product over features that at most ``least`` targets of its
    country, or a ``share`` of them if that is more, have (of these a query's ``max_feats`` heaviest); ties by tgt_id. Without a share: over all features.
    Queries and targets (of one source): vectors, or postings (country, entity_id, f, w).

    A country's queries and targets are cut into blocks; each block of targets, of ``most`` postings or so, meets each block of queries in a
    task, which adds up products along posting lists and returns a query's best k. So vectors are shuffled, once for each block of the other side,
    and never products.
    """
    q, t = packed(queries).select("country", "entity_id", "fs", "ws"), packed(targets).select("country", "entity_id", "fs", "ws")
    grid, tiles = _grid(q, t, most)
    id_, none = t.schema["entity_id"].dataType.simpleString(), F.lit(None)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cut = t.join(grid, "country").select("*", every(F.col("nq")).alias("j"))
    rows = cut.select("country", (_block("entity_id", "nt") * F.col("nq") + F.col("j")).alias("tile"), F.lit(1).alias("side"), F.col("entity_id").alias("id"), "fs", "ws")
    if share is not None:
        df = t.select("country", F.explode("fs").alias("f")).groupBy("country", "f").agg(F.count("*").alias("df"))
        rare = df.join(grid, "country").where(F.col("df") <= F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("n"))))
        rare = rare.groupBy("country", "nq", "nt", F.pmod(F.hash("f"), F.lit(256))).agg(F.collect_list("f").alias("fs"))
        rare = rare.select("country", every(F.col("nq") * F.col("nt")).alias("tile"), F.lit(0).alias("side"), none.cast(id_).alias("id"), "fs", none.cast("array<double>").alias("ws"))
        rows = rare.union(rows)
    q = q.join(grid, "country").select("*", every(F.col("nt")).alias("i"))
    rows = rows.union(q.select("country", F.col("i") * F.col("nq") + _block("entity_id", "nq"), F.lit(2), F.col("entity_id").cast(id_), "fs", "ws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, features, held, lists, open_ = None, [], [], None, []
        for tile, side, b in _runs(batches):
            if tile != at:
                if lists and open_:
                    yield lists.best(open_, k, max_feats)
                at, features, held, lists, open_ = tile, [], [], None, []
            if side == 0:
                features.append(b.column("fs").flatten())
            elif side == 1:
                held.append(b)
            elif held and (features or share is None):
                if lists is None:
                    lists, held = _Lists(features, held), [True]
                # a query's rows may go on in the next batch
                ids = b.column("id")
                cut = pc.index(ids, ids[len(ids) - 1]).as_py()
                if cut:
                    yield lists.best([*open_, b.slice(0, cut)], k, max_feats)
                    open_ = []
                open_.append(b.slice(cut))
        if lists and open_:
            yield lists.best(open_, k, max_feats)

    found = _in_tiles(rows, tiles, run, f"s1_id {id_}, tgt_id {id_}, score double")
    best = Window.partitionBy("s1_id").orderBy(F.desc("score"), "tgt_id")
    return found.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k).select("s1_id", "tgt_id", "score", F.col("rk").cast("long").alias("rk"))


def exact_core(e: DataFrame, max_s1: int = 5, max_tgt: int = 20) -> DataFrame:
    """Pairs with equal non-empty names whose groups are small enough on either side."""
    small = lambda d, most: d.join(d.groupBy("country", "name").agg(F.count("*").alias("n")).where(F.col("n") <= most).drop("n"), ["country", "name"])
    named = e.where("name <> ''").select("country", "name", "k", "entity_id")
    s1 = small(named.where("k = 1"), max_s1).select("country", "name", F.col("entity_id").alias("s1_id"))
    return s1.join(small(named.where("k > 1"), max_tgt).select("country", "name", F.col("entity_id").alias("tgt_id")), ["country", "name"]).select("s1_id", "tgt_id")


def union_via(*parts: tuple[DataFrame, int]) -> DataFrame:
    """s1_id, tgt_id, via: distinct pairs with the bits of the parts that have them."""
    out = None
    for df, bit in parts:
        p = df.select("s1_id", "tgt_id", F.lit(bit).alias("via"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("s1_id", "tgt_id").agg(F.bit_or("via").cast("int").alias("via"))


class _Vectors:
    """The vectors of a block of targets."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.ids, of, f, self.w = _flat(rows)
        self.features = pc.unique(f)
        self.code = pc.index_in(f, value_set=self.features).to_numpy(zero_copy_only=False)
        self.size = np.bincount(of, minlength=len(self.ids))
        self.start = np.cumsum(self.size) - self.size
        self.query = np.zeros(len(self.features))

    def dots(self, b: pa.RecordBatch) -> pa.RecordBatch:
        """s1_id, tgt_id, dot of the pairs of each row: a query and the targets it is compared with (``ids``)."""
        code = pc.index_in(b.column("fs").flatten(), value_set=self.features).fill_null(-1).to_numpy(zero_copy_only=False)
        w = b.column("ws").flatten().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(pc.list_value_length(b.column("fs")).to_numpy(zero_copy_only=False)))
        asked = pc.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False)
        at = pc.index_in(b.column("ids").flatten(), value_set=self.ids).fill_null(-1).to_numpy(zero_copy_only=False)
        which = np.repeat(np.arange(b.num_rows), asked)
        which, at = which[at >= 0], at[at >= 0]
        till, out = np.searchsorted(which, np.arange(b.num_rows + 1)), np.zeros(len(at))
        for i in range(b.num_rows):
            x, t = slice(ends[i], ends[i + 1]), at[till[i] : till[i + 1]]
            c, v = code[x][code[x] >= 0], w[x][code[x] >= 0]
            np.add.at(self.query, c, v)
            n = self.size[t]
            place = np.arange(n.sum()) + np.repeat(self.start[t] - np.cumsum(n) + n, n)
            out[till[i] : till[i + 1]] = np.bincount(np.repeat(np.arange(len(t)), n), self.query[self.code[place]] * self.w[place], len(t))
            self.query[c] = 0.0
        return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(which)), self.ids.take(pa.array(at)), pa.array(out)], names=["s1_id", "tgt_id", "dot"])


def pair_dots(pairs: DataFrame, w: DataFrame, most: int = TARGET_POSTINGS) -> DataFrame:
    """s1_id, tgt_id, dot of the distinct ``pairs`` whose records both have vectors (``w``, or postings).

    Pairs meet by country of the query and by blocks of both sides, as in ``top_k``; a record goes once to each block that asks for it and not with every pair.
    """
    v = packed(w)
    grid, tiles = _grid(v, v, most)
    home = v.select(F.col("entity_id").alias("s1_id"), "country").distinct().join(grid, "country")
    tile = _block("tgt_id", "nt") * F.col("nq") + _block("s1_id", "nq")
    p = pairs.select("s1_id", "tgt_id").distinct().join(home, "s1_id").select("country", tile.alias("tile"), "s1_id", "tgt_id")
    v = v.select(F.col("entity_id").alias("id"), "fs", "ws")
    t = p.select("country", "tile", F.col("tgt_id").alias("id")).distinct().join(v, "id")
    q = p.groupBy("country", "tile", F.col("s1_id").alias("id")).agg(F.collect_list("tgt_id").alias("ids")).join(v, "id")
    ids = F.lit(None).cast(q.schema["ids"].dataType)
    rows = t.select("country", "tile", F.lit(1).alias("side"), "id", "fs", "ws", ids.alias("ids")).union(q.select("country", "tile", F.lit(2), "id", "fs", "ws", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for of, side, b in _runs(batches):
            if of != at:
                at, held, block = of, [], None
            if side == 1:
                held.append(b)
            elif held:
                if block is None:
                    block, held = _Vectors(held), [True]
                yield block.dots(b)

    id_ = v.schema["id"].dataType.simpleString()
    return _in_tiles(rows, tiles, run, f"s1_id {id_}, tgt_id {id_}, dot double").groupBy("s1_id", "tgt_id").agg(F.sum("dot").alias("dot"))


def pair_cosine(pairs: DataFrame, w: DataFrame, name: str) -> DataFrame:
    """``pairs`` with the exact cosine of their records; 0 where they share no feature."""
    out = pairs.join(pair_dots(pairs, w), ["s1_id", "tgt_id"], "left")
    return out.select(*[F.col(c) for c in pairs.columns], F.round(F.coalesce("dot", F.lit(0.0)), 6).alias(name))


@dataclass(frozen=True)
class Blocking:
    """How many targets a record gets in each view (forward), how many records a target gets (reverse), a query's heaviest features, and the
    greatest group of equal names."""

    forward: dict = field(default_factory=lambda: {"n": 15, "a": 15, "na": 30})
    reverse: dict = field(default_factory=lambda: {"na": 3})
    features: dict = field(default_factory=lambda: {"na": 10})
    group: int = 5


#: Bits of ``via``: which search found a pair.
FORWARD_BIT, REVERSE_BIT, EXACT_BIT = {"n": 1, "a": 2, "na": 4}, {"n": 8, "a": 16, "na": 32}, 64


def candidates(e: DataFrame, views: dict[str, DataFrame], blocking: Blocking) -> DataFrame:
    """country, tgt_src, s1_id, tgt_id, via, cos_n, cos_a, cos_na: candidates of all reference records among the targets of sources 2 and 3.

    Each search is written as it is done, so that no plan holds them all.

    e: country, k, entity_id, name. views: the vectors of n, a and na, where na is n and a ``combined``.
    """
    out = None
    for src in (2, 3):
        parts = []
        for v, k in blocking.forward.items():
            w = views[v]
            forward = top_k(w.where("k = 1"), w.where(F.col("k") == src), k, DF_SHARE[v], blocking.features.get(v))
            parts.append((work.written(forward, "forward"), FORWARD_BIT[v]))
        for v, k in blocking.reverse.items():
            w = views[v]
            back = work.written(top_k(w.where(F.col("k") == src), w.where("k = 1"), k, DF_SHARE[v], blocking.features.get(v)), "back")
            parts.append((back.select(F.col("s1_id").alias("tgt_id"), F.col("tgt_id").alias("s1_id")), REVERSE_BIT[v]))
        parts.append((exact_core(e.where(F.col("k").isin(1, src)), blocking.group, 4 * blocking.group), EXACT_BIT))
        found = union_via(*parts).withColumn("tgt_src", F.lit(src))
        out = found if out is None else out.unionByName(found)
    out = out.join(e.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    out = found = work.written(out, "found")
    for v in ("n", "a"):
        out = out.join(work.written(pair_dots(found, views[v]), "dots").withColumnRenamed("dot", f"_{v}"), ["s1_id", "tgt_id"], "left").fillna(0.0, [f"_{v}"])
    n, a = F.col("_n"), F.col("_a")
    cosines = {"cos_n": F.round(n, 6), "cos_a": F.round(a, 6), "cos_na": F.round((n + a) / 2, 6)}
    return out.withColumns(cosines).select("country", "tgt_src", "s1_id", "tgt_id", "via", *cosines)
