"""Near-duplicates: SimHash fingerprints, pigeonhole blocks, Hamming verification; for similarity of shingle sets, blocks are shared rare shingles, and an exact check follows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded, fresh, portions, written
from kinweave.llm.graph import components, thinned, top

#: Fingerprints of a bucket that are compared pair by pair in a join; larger buckets are linked in other, exact ways.
CROWD = 32
#: Fingerprints on a side of a tile of a crowded bucket.
TILE = 1024
#: The same for shingle sets.
SIMILAR_CROWD = 32
#: Texts in which frequent shingles are counted, and the most of these that every task gets.
SAMPLE, COMMON = 5_000, 1 << 15
SEED = 42
_word = re.compile(r"\w+")


# ---- fingerprints


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of the shingles of ``size`` words, repeats included; of the whole sequence where it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n - size + 1)


def _mixed(h: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` 64-bit values a hash: the hash itself, then a bijective mix of it with the lane's odd constant."""
    out = np.empty((len(h), lanes), np.uint64)
    out[:, 0] = h
    for i in range(1, lanes):
        x = h + np.uint64((0x9E3779B97F4A7C15 * i) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = x ^ (x >> np.uint64(31))
    return out


def majority(h: np.ndarray, lanes: int = 1) -> bytes:
    """The fingerprint, big-endian: a bit is 1 if set in over half of the hashes; no hash gives zero."""
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(h), 1 << 15):  # bounds memory on long texts
        part = _mixed(h[at : at + (1 << 15)], lanes).astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8 * lanes), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h)).tobytes()


def plain_words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split()


def bare_words(text: str) -> list[bytes]:
    """Lower-cased letters and digits: case and punctuation don't count."""
    return [w.encode() for w in _word.findall(text.lower())]


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, bare: bool = False) -> DataFrame:
    """doc_id, f0 ... (a long for each 64 bits) of every row's whole text; null texts are empty: fingerprint zero."""
    of = bare_words if bare else plain_words
    schema = pa.schema([("doc_id", pa.int64()), *[(f"f{i}", pa.int64()) for i in range(lanes)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in portions(whole, "text")):
            got = b"".join(majority(_hashes(of(t or ""), words), lanes) for t in b.column(1).to_pylist())
            f = np.frombuffer(got, ">u8").astype(np.uint64).view(np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(np.ascontiguousarray(f[:, i])) for i in range(lanes)]], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"f{i} long" for i in range(lanes)))


# ---- links at a few differing bits of 64, exactly


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def exact_links(fps: DataFrame, most: int = 2) -> DataFrame:
    """a, b: edges whose components are those of all pairs of ``fps`` (distinct, column fp) with at most ``most`` (0 to 2) differing bits.

    64 bits in most + 2 blocks: close pairs share at least two, so every two blocks together are a key of 32 bits or so.
    Buckets of up to CROWD fingerprints are joined with themselves and verified. In a larger one, two fingerprints at
    two differing bits or fewer have a value in common that differs from each in one bit at most and has the bucket's
    key too: each meets all such values, at most 65, and those that share one are linked. So crowds cost rows in
    proportion, and no link is lost.
    """
    if most not in (0, 1, 2):
        raise ValueError("most is 0, 1 or 2")
    n = most + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    masks = [_signed(a | b) for a, b in combinations(blocks, 2)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("e")).select("fp", "e.k", "e.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    near = written(keyed.join(sizes, ["k", "v"]), "blocks")
    a = near.where(F.col("n") <= CROWD)
    b = a.select("k", "v", F.col("fp").alias("b"))
    pairs = a.join(b, ["k", "v"]).where((F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= most)).select(F.col("fp").alias("a"), "b")
    mask = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("k") + 1)
    bits = F.array(*[F.lit(_signed(1 << i)) for i in range(64)] if most else [F.lit(0).cast("long")])
    around = F.filter(F.transform(bits, lambda x: F.col("fp").bitwiseXOR(x)), lambda z: z.bitwiseAND(mask) == F.col("v"))
    met = near.where(F.col("n") > CROWD).select("fp", F.explode(F.concat(F.array("fp"), around)).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1)
    crowd = met.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where("a <> b")
    if most == 1:  # what meets at a third value may differ in two bits
        crowd = crowd.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return pairs.union(crowd).distinct()


def hamming_classes(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row: the least doc_id reachable over links of fingerprints.

    Equal fingerprints are one node. Null and empty texts have fingerprint zero, linked like any other. A null doc_id
    is passed over for component_id unless the component has no other. Repeated rows are kept; an empty table gives none.
    """
    d = written(fingerprints(docs, words).withColumnRenamed("f0", "fp"), "fingerprints")
    fps = d.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(exact_links(fps.select("fp"), most))
    fps = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = fps.groupBy("root").agg(F.min("least").alias("component_id"))
    return d.join(fps.join(of_root, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# ---- links at a similarity of shingle sets, exactly


#: Bits of the fingerprints of sets, and standard deviations that links at the similarity may lie beyond their expected distance.
LANES, DEVIATIONS = 4, 5
#: Sets of fewer members are compared whole, whatever their fingerprints: a few members' majorities differ more often than expected.
SMALL = 32
#: Shingles on a side of a tile of a group of near copies.
TILE_MEMBERS = 1 << 18
#: Nodes, at 24 bytes, that every task gets at most; more of them are joined by a shuffle.
NODE_BYTES = 32 << 20


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes in order; none for a text without a word."""
    return np.unique(_hashes(bare_words(text or ""), words))


def _node(h: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) if len(h) else None


def enough(inter, a, b, part: Fraction):
    """Whether sets of ``a`` and ``b`` members of which ``inter`` are common have a Jaccard of ``part`` at least; in whole numbers."""
    return inter * (part.numerator + part.denominator) >= (a + b) * part.numerator


def differing(part: Fraction) -> int:
    """Bits of 64 LANES that fingerprints of sets with a Jaccard of ``part`` differ in at most: the expected number and DEVIATIONS more.

    A bit differs with the chance angle / pi of the two sets' vectors, whose cosine is 2 J / (1 + J) for sets of one size and
    greater for others. Five deviations leave out 3 pairs in 10 million that lie just at ``part``, and fewer beyond it. Exact sums
    over sets of 30 to 300 members stay below that chance; smaller ones don't, hence SMALL.
    """
    chance = math.acos(min(1.0, 2 * float(part) / (1 + float(part)))) / math.pi
    return math.ceil(64 * LANES * chance + DEVIATIONS * math.sqrt(64 * LANES * chance * (1 - chance)))


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of frequent shingles in about SAMPLE texts. They only set an order: links don't depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(b.column(0)[i].as_py(), words).view(np.int64))], names=["h"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    got = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r["h"] for r in got], np.int64).view(np.uint64), np.array([r["n"] for r in got], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame, words: int, part: Fraction) -> DataFrame:
    """doc_id, node (of the set of shingles; null without a word), n (its size), keys and f0 ... (its fingerprint) of every row.

    Shingles have one order in all texts, rare ones first. Two sets with a Jaccard of ``part`` or more have one of their
    first n - ceil(part n) + 1 shingles in common; these are the keys. That holds for any order and any number of rows.
    Of equal sets only the first in a batch has keys.
    """
    frequent, counts = common_shingles(docs, words)
    lanes = [f"f{i}" for i in range(LANES)]
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), *[(f, pa.int64()) for f in lanes]])

    def keys(h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(frequent, h).clip(max=max(0, len(frequent) - 1))
        times = np.where(frequent[at] == h, counts[at], 0) if len(frequent) else np.zeros(len(h), np.int64)
        first = len(h) - -(-part.numerator * len(h) // part.denominator) + 1
        return h[np.lexsort((h, times))[:first]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen: set[int | None] = set()
            for b in portions(whole, "text"):
                rows = []
                for i in range(b.num_rows):
                    h = shingle_set(b.column(1)[i].as_py(), words)
                    node = _node(h)
                    f = np.frombuffer(majority(h, LANES), ">u8").astype(np.uint64).view(np.int64).tolist()
                    rows.append((b.column(0)[i].as_py(), node, len(h), keys(h) if node not in seen and len(h) else [], *f))
                    seen.add(node)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n long, keys array<long>, " + ", ".join(f"{f} long" for f in lanes))


def alike(rows: DataFrame, part: Fraction) -> DataFrame:
    """a, b: edges (nodes) whose components hold every pair of sets that share a key and lie within ``differing`` bits or are SMALL.

    rows: as ``prefixes`` has them. Buckets of up to SIMILAR_CROWD sets are joined with themselves. Larger ones are cut into parts of
    about TILE fingerprints; each two parts meet in a task that compares all their pairs and returns a spanning forest of
    what is near, so no bucket is capped, collected as one or expanded into pairs. Sizes and places of the key rule pairs out too.
    """
    lanes, most = [f"f{i}" for i in range(LANES)], differing(part)
    place = F.col("n").bitwiseOR(F.shiftleft(F.col("at").cast("long"), 32)).alias("place")
    keyed = rows.where("node is not null").select("node", "n", F.posexplode("keys").alias("at", "key")).select("key", "node", place)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    near = keyed.join(sizes, "key").select("key", "node", "met", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("n"), F.shiftright("place", 32).alias("at"))
    of = rows.where("node is not null").groupBy("node").agg(*[F.first(f).alias(f) for f in lanes])
    near = written(near.join(of, "node"), "blocks")
    a = near.where(F.col("met") <= SIMILAR_CROWD)
    b = a.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), *[F.col(f).alias(f"_{f}") for f in lanes])
    apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"_{f}"))) for f in lanes), F.lit(0))
    common = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt"))
    pairs = a.join(b, "key").where((F.col("node") < F.col("b")) & enough(common, F.col("n"), F.col("m"), part) & ((apart <= most) | (F.least("n", "m") < SMALL))).select(F.col("node").alias("a"), "b")
    parts = F.ceil(F.col("met") / TILE).cast("int")
    crowd = near.where(F.col("met") > SIMILAR_CROWD).withColumn("p", F.pmod(F.xxhash64("node", F.lit(SEED)), parts).cast("int"))
    tiles = crowd.withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1))).select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "node", "n", *lanes)

    def forest(node: np.ndarray, n: np.ndarray, p: np.ndarray, f: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
        first = np.sort(np.unique(node, return_index=True)[1])
        node, n, p, f = node[first], n[first], p[first], f[first]
        tree, out = np.arange(len(node)), []
        right = np.flatnonzero(p == j)
        for x in np.flatnonzero(p == i).tolist():
            y = right[(right > x) & (tree[right] != tree[x])] if i == j else right[tree[right] != tree[x]]
            y = y[enough(np.minimum(n[x], n[y]), n[x], n[y], part)]
            close = (np.bitwise_count(f[y] ^ f[x]).sum(axis=1, dtype=np.int64) <= most) | (np.minimum(n[x], n[y]) < SMALL)
            for z in y[close].tolist():
                if tree[z] != tree[x]:
                    tree[tree == tree[z]] = tree[x]
                    out.append((int(node[x]), int(node[z])))
        return out

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate(held)
            out = forest(x[:, 4], x[:, 5], x[:, 3], x[:, 6:], int(x[0, 1]), int(x[0, 2]))
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            for rows in np.split(x, np.flatnonzero((np.diff(x[:, :3], axis=0) != 0).any(axis=1)) + 1):
                if held and len(rows) and (held[0][0, :3] != rows[0, :3]).any():
                    yield done(held)
                    held = []
                if len(rows):
                    held.append(rows)
        if held:
            yield done(held)

    # arrays and not frames of pandas, whose import would stay with every worker
    found = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(forests, "a long, b long")
    return thinned(pairs.union(found).where("a <> b"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` (few longs a row), sent to every task where its size allows."""
    return F.broadcast(df) if bounded(df, NODE_BYTES, 24) else df


def similar_links(docs: DataFrame, rows: DataFrame, words: int, part: Fraction) -> DataFrame:
    """a, b: edges (nodes) whose components are those of all pairs with a Jaccard of ``part`` or more, and of no others.

    Pairs that share a key and whose fingerprints are near make groups; each set of a group of more than one goes to the task of its
    group, as 8 bytes a shingle, which compares whole sets. A group with over TILE_MEMBERS shingles is cut into parts, each two of
    which meet in a task. Tasks return spanning forests, so rows don't grow with a group's pairs.
    """
    roots = components(alike(rows, part))
    member = written(roots.union(roots.select("root", "root").distinct()).join(rows.groupBy("node").agg(F.first("n").alias("n")), "node"), "groups")
    sizes = member.groupBy("root").agg(F.ceil(F.sum("n") / TILE_MEMBERS).cast("int").alias("parts"))
    member = written(member.join(_small(sizes), "root").select("node", "root", "parts"), "members")
    ids = rows.join(_small(member.select("node")), "node", "left_semi").select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(_small(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    schema = pa.schema([("node", pa.int64()), ("said", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen: set[int | None] = set()
            for b in portions(whole, "text"):
                rows = []
                for i in range(b.num_rows):
                    h = shingle_set(b.column(0)[i].as_py(), words)
                    if len(h) and (node := _node(h)) not in seen:
                        seen.add(node)
                        rows.append((node, h.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    x = texts.mapInArrow(sets, "node long, said binary").join(_small(member), "node")
    x = x.withColumn("p", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.select("root", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "node", "said")

    def links(group: list[tuple[int, int, bytes]], i: int, j: int) -> tuple[list[int], list[int]]:
        member = {node: (p, np.frombuffer(said, np.uint64)) for p, node, said in group}
        node, p = list(member), np.array([p for p, _ in member.values()])
        sets = [h for _, h in member.values()]
        n = np.array([len(h) for h in sets], np.int64)
        on = np.zeros((len(sets), 1024), bool)
        for k, h in enumerate(sets):
            on[k, h & np.uint64(1023)] = True
        bits = np.packbits(on, axis=1).view(np.uint64)
        right, tree, a, b = np.flatnonzero(p == j), np.arange(len(sets)), [], []
        for x in np.flatnonzero(p == i).tolist():
            y = right[(right > x) & (tree[right] != tree[x])] if i == j else right[tree[right] != tree[x]]
            # a bit that only one of two sets has stands for one member at least that the other lacks
            most = np.minimum(n[x] - np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64), n[y] - np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1, dtype=np.int64))
            for z in y[enough(most, n[x], n[y], part)].tolist():
                if tree[z] != tree[x] and enough(len(np.intersect1d(sets[x], sets[z], assume_unique=True)), n[x], n[z], part):
                    tree[tree == tree[z]] = tree[x]
                    a.append(node[x])
                    b.append(node[z])
        return a, b

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("root", "i", "j", "p", "node", "said")
        stream = (row for whole in batches for b in portions(whole, "said") for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names), strict=True))
        for (_, i, j), group in groupby(stream, key=lambda r: r[:3]):
            a, b = links([r[3:] for r in group], i, j)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return thinned(x.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(verify, "a long, b long"))


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, node, least of every row: ``least`` is the smallest doc_id of the row's class of near copies.

    Similarity is the Jaccard of the sets of ``words``-word shingles (case and punctuation aside), by 64-bit hashes. Classes are
    joined by pairs of that similarity, every one of them (but for what ``differing`` leaves out) and no other. Texts without a word
    are one class only where the texts are equal, which they are by shingles: they are left alone instead, each a class of its own (node null).
    """
    part = Fraction(str(similarity))
    d = written(prefixes(docs, words, part), "prefixes")
    roots = written(components(similar_links(docs, d, words, part)), "roots")
    copies = d.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    linked = roots.union(roots.select("root", "root").distinct())
    linked = written(copies.join(_small(linked), "node").select("node", "root", "least"), "linked")
    of_root = linked.groupBy("root").agg(F.min("least").alias("least"))
    linked = linked.select("node", "root").join(_small(of_root), "root").select("node", "least")
    alone = copies.where("rows > 1").select("node", "least").join(_small(linked.select("node")), "node", "left_anti")
    classes = written(linked.union(alone), "classes")
    return d.select("doc_id", "node").join(_small(classes), "node", "left").select("doc_id", "node", F.coalesce("least", "doc_id").alias("least"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the smallest doc_id of each class of near copies, all columns.

    Rows with an id that repeats stay or go together, but of rows that are equal in id and text one stays; rows without
    an id stay only where their class has no id; texts without a word all stay.
    """
    c = similar_classes(docs, words, similarity)
    gone, again = fresh(docs, "_gone"), fresh(docs, "_again")
    ids = written(c.groupBy(F.col("doc_id").alias(gone)).agg(F.every(~F.col("doc_id").eqNullSafe(F.col("least"))).alias("goes"), F.count("node").alias("rows")), "ids")
    kept = docs.join(_small(ids.where("goes").select(gone)), docs["doc_id"].eqNullSafe(F.col(gone)), "left_anti")
    twice = ids.where("NOT goes AND rows > 1").select(F.col(gone).alias(again))
    if twice.isEmpty():
        return kept
    met = kept["doc_id"].eqNullSafe(F.col(again))
    return kept.join(_small(twice), met, "left_anti").unionByName(kept.join(_small(twice), met, "left_semi").dropDuplicates(["doc_id", "text"]))
