"""Pairs as characters: a vocabulary, fixed-width codes, training pairs, and a model of the differences between both sides' characters."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import fixed_width
from kinweave.operators.pairs import fold

#: Codes of padding, unknown characters, the start and the cut; characters follow. Marks of ``fixed_width`` for padding and the cut.
PAD, UNKNOWN, START, CUT, FIRST = 0, 1, 2, 3, 4
PAD_MARK, CUT_MARK = "~", "^"
SIZE, HIDDEN = 252, 24
NAME, WIDTH = 40, 112
#: Pairs whose differences are held at a time; the greatest log odds (of a chance clipped at 1e-6).
ROWS, MOST = 1024, float(np.log((1 - 1e-6) / 1e-6))


def vocabulary(records: DataFrame, size: int = SIZE) -> DataFrame:
    """c, n, code: the ``size`` most frequent characters of names and addresses, coded from FIRST on by falling count; ties by the character."""
    chars = F.filter(F.split(F.concat(F.coalesce("name", F.lit("")), F.coalesce("address", F.lit(""))), ""), lambda c: (c != "") & ~c.isin(PAD_MARK, CUT_MARK))
    n = records.select(F.explode(chars).alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(size)
    return n.withColumn("code", (F.row_number().over(Window.orderBy(F.desc("n"), "c")) + FIRST - 1).cast("int"))


def encoded(records: DataFrame, codes: DataFrame) -> DataFrame:
    """entity_id, codes: a record's name and address as WIDTH codes. ``codes`` is a vocabulary, of SIZE rows at most, and so a map in each task."""
    table = codes.agg(F.map_from_entries(F.collect_list(F.struct("c", "code")))).scalar()
    of = lambda c, m: F.when(c == PAD_MARK, PAD).when(c == CUT_MARK, CUT).otherwise(F.coalesce(F.try_element_at(m, c), F.lit(UNKNOWN)))
    x = records.select("entity_id", F.split(fixed_width(F.col("name"), F.col("address")), "").alias("t"), table.alias("m"))
    return x.select("entity_id", F.transform(F.filter("t", lambda c: c != ""), lambda c: of(c, F.col("m"))).alias("codes"))


def pair_codes(p: DataFrame, codes: DataFrame) -> DataFrame:
    """``p`` (s1_id, tgt_id) with x: START and the codes of both records."""
    side = lambda i, name: codes.select(F.col("entity_id").alias(i), F.col("codes").alias(name))
    return p.join(side("s1_id", "_a"), "s1_id").join(side("tgt_id", "_b"), "tgt_id").withColumn("x", F.concat(F.array(F.lit(START)), "_a", "_b")).drop("_a", "_b")


def training_pairs(p: DataFrame, score: str, low: float = 0.005, high: float = 0.995, easy: float = 0.15) -> DataFrame:
    """Pairs of folds A and B: the hard ones, scored between ``low`` and ``high``, and a share of the others by a hash; with hard and held_out (by record)."""
    hard = F.col(score).between(low, high)
    sample = F.pmod(F.xxhash64("s1_id", "tgt_id", F.lit(17)), F.lit(100)) < easy * 100
    x = p.where((fold(F.col("s1_id")) != "H") & (hard | sample))
    return x.withColumns({"hard": hard, "held_out": F.pmod(F.xxhash64("s1_id", F.lit(5)), F.lit(20)) == 0})


def _counted(x: pa.Array, vocabulary_size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of ``_differences`` the columns whose codes occur, and their values; the others are zero."""
    codes = FIRST + vocabulary_size
    rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), 1 + 2 * WIDTH)[:, 1:]
    for i in range(0, len(rows), ROWS):
        v = rows[i : i + ROWS]
        there = np.flatnonzero(np.bincount(v.ravel(), minlength=codes))
        there, place = there[there >= UNKNOWN], np.zeros(codes, np.int64)
        place[there] = np.arange(1, len(there) + 1)
        m, v = len(there) + 1, place[v]

        def run(v: np.ndarray, start: int, width: int, m: int = m) -> np.ndarray:
            count = lambda at: np.bincount((v[:, at : at + width] + m * np.arange(len(v))[:, None]).ravel(), minlength=len(v) * m).reshape(len(v), m)
            return np.abs(count(start) - count(WIDTH + start))[:, 1:] / width

        yield np.concatenate([there, there + codes - UNKNOWN]) - UNKNOWN, np.concatenate([run(v, 0, NAME), run(v, NAME, WIDTH - NAME)], axis=1)


def _differences(x: pa.Array, vocabulary_size: int) -> Iterator[np.ndarray]:
    """Per code, how much oftener names and addresses of one side have it than the other's, as two runs of numbers; ROWS pairs at a time."""
    for columns, f in _counted(x, vocabulary_size):
        whole = np.zeros((len(f), 2 * (FIRST + vocabulary_size - UNKNOWN)))
        whole[:, columns] = f
        yield whole


@dataclass(frozen=True)
class Perceptron:
    """One hidden layer; the log odds of label 1."""

    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    last: float

    @classmethod
    def of(cls, w: np.ndarray) -> Perceptron:
        n = (len(w) - 1) // HIDDEN - 2
        return cls(w[: n * HIDDEN].reshape(n, HIDDEN), w[n * HIDDEN : (n + 1) * HIDDEN], w[(n + 1) * HIDDEN : -1], float(w[-1]))

    def at(self, columns: np.ndarray) -> Perceptron:
        """The same for rows of which only these columns are not zero."""
        return Perceptron(self.hidden[columns], self.bias, self.out, self.last)

    def odds(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden layer and the log odds of rows of features."""
        h = 1 / (1 + np.exp(-(f @ self.hidden + self.bias)))
        return h, h @ self.out + self.last

    def loss(self, f: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of the rows' cross-entropies, and its gradient."""
        h, z = self.odds(f)
        d = 1 / (1 + np.exp(-z)) - y
        back = d[:, None] * self.out * h * (1 - h)
        return float(np.sum(np.logaddexp(0, z) - y * z)), np.concatenate([(f.T @ back).ravel(), back.sum(0), h.T @ d, [d.sum()]])


def train(p: DataFrame, vocabulary_size: int = SIZE, rounds: int = 60, seed: int = 7) -> Perceptron:
    """A perceptron of label (0 or 1) on the differences of pairs (x, label, held_out), all that are not held out."""
    loss = _losses(p, vocabulary_size)
    return Perceptron.of(minimum(lambda w: loss({0: w})[0], _start(vocabulary_size, seed), rounds))


def train_all(p: DataFrame, seeds: Sequence[int], vocabulary_size: int = SIZE, rounds: int = 60) -> list[Perceptron]:
    """A perceptron of each seed, as ``train`` has it; they learn side by side and share what is read."""
    return [Perceptron.of(w) for w in minima(_losses(p, vocabulary_size), [_start(vocabulary_size, k) for k in seeds], rounds)]


def _start(vocabulary_size: int, seed: int) -> np.ndarray:
    n, random = 2 * (FIRST + vocabulary_size - UNKNOWN), np.random.default_rng(seed)
    return np.concatenate([random.normal(0, (2 / (n + HIDDEN)) ** 0.5, n * HIDDEN), np.zeros(HIDDEN), random.normal(0, (2 / HIDDEN) ** 0.5, HIDDEN), [0.0]])


def _losses(p: DataFrame, vocabulary_size: int) -> Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]]:
    """The mean loss of the training pairs and its gradient, of several models at a time.

    Each call reads ``p`` (a written table, then); differences are counted as they are read and never kept, neither on
    disk nor in memory. A task returns one sum of gradients for each model.
    """
    d = p.where("NOT held_out").select("x", F.col("label").cast("double").alias("label"))
    d = d.coalesce(2 * p.sparkSession.sparkContext.defaultParallelism)
    wide = 2 * (FIRST + vocabulary_size - UNKNOWN)

    def loss(ws: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = {k: Perceptron.of(w) for k, w in ws.items()}
            n, total, gradient = 0, dict.fromkeys(ws, 0.0), {k: np.zeros(len(w)) for k, w in ws.items()}
            for b in batches:
                y = b.column("label").to_numpy(zero_copy_only=False)
                for columns, f in _counted(b.column("x"), vocabulary_size):
                    for k, m in models.items():
                        value, g = m.at(columns).loss(f, y[:ROWS])
                        total[k] += value
                        gradient[k][: wide * HIDDEN].reshape(wide, HIDDEN)[columns] += g[: len(columns) * HIDDEN].reshape(-1, HIDDEN)
                        gradient[k][wide * HIDDEN :] += g[len(columns) * HIDDEN :]
                    n, y = n + len(f), y[ROWS:]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([*ws]), pa.array([n] * len(ws)), pa.array([*total.values()]), pa.array([g.tobytes() for g in gradient.values()])], names=["model", "n", "loss", "gradient"])

        got = d.mapInArrow(summed, "model long, n long, loss double, gradient binary").collect()
        out = {}
        for k, w in ws.items():
            # in one order, so that reruns agree
            by = sorted((r for r in got if r["model"] == k), key=lambda r: (r["n"], r["loss"], bytes(r["gradient"])))
            n = max(1, sum(r["n"] for r in by))
            out[k] = sum(r["loss"] for r in by) / n, sum((np.frombuffer(r["gradient"]) for r in by), np.zeros(len(w))) / n
        return out

    return loss


def minima(loss, starts: Sequence[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Where ``loss`` is least from each start; it gets the points that are asked for at a time, by the start's place, and returns values and gradients."""
    runs = [_descent(w, rounds) for w in starts]
    asked, out = {i: next(r) for i, r in enumerate(runs)}, {}
    while asked:
        got, more = loss(asked), {}
        for i in asked:
            try:
                more[i] = runs[i].send(got[i])
            except StopIteration as end:
                out[i] = end.value
        asked = more
    return [out[i] for i in range(len(runs))]


def minimum(loss, w: np.ndarray, rounds: int) -> np.ndarray:
    """Where ``loss`` (value and gradient) is least."""
    return minima(lambda asked: {i: loss(x) for i, x in asked.items()}, [w], rounds)[0]


def _descent(w: np.ndarray, rounds: int, kept: int = 10, least: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """``rounds`` steps of L-BFGS at most, each with a falling loss: yields points, is sent their values and gradients, returns the last."""
    value, g = yield w
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.linalg.norm(g) <= least:
            break
        way, a = -g, []
        for s, y in reversed(steps):
            a.append(s @ way / (s @ y))
            way = way - a[-1] * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y / (y @ y))
        for (s, y), x in zip(steps, reversed(a), strict=True):
            way = way + (x - y @ way / (s @ y)) * s
        size, slope = 1.0 if steps else 1 / np.linalg.norm(g), g @ way
        for _ in range(20):
            new, new_g = yield w + size * way
            if new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * way, new_g - g
        w, fell, value, g = w + s, value - new, new, new_g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-kept:]
        if fell <= least * abs(value):
            break
    return w


def score(p: DataFrame, models: list[Perceptron], vocabulary_size: int = SIZE) -> DataFrame:
    """s1_id, tgt_id, z: the mean of the models' log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [np.mean([np.clip(m.at(columns).odds(f)[1], -MOST, MOST) for m in models], axis=0) for columns, f in _counted(b.column("x"), vocabulary_size)]
            yield pa.RecordBatch.from_arrays([b.column("s1_id"), b.column("tgt_id"), pa.array(np.concatenate(z) if z else np.zeros(0))], names=["s1_id", "tgt_id", "z"])

    p = p.select("s1_id", "tgt_id", "x")
    return p.mapInArrow(run, f"s1_id {p.schema['s1_id'].dataType.simpleString()}, tgt_id {p.schema['tgt_id'].dataType.simpleString()}, z double")
