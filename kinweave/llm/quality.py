"""Quality classifier: a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import fresh, portions

#: Labelled documents that the field is fitted on at most, by the order of a hash of their ids.
SAMPLE = 6000
#: Lines of a training sequence; longer documents are several sequences.
SEQUENCE = 64
ROUNDS, RATE, DECAY = 200, 0.1, 1e-4
#: Places of a padded group of sequences; lines beyond which a text is scored in chunks; characters whose features are made at once.
CELLS, LONG, PART = 1 << 16, 1 << 15, 1 << 20
#: A document with at least this score is predicted good.
THRESHOLD = 0.7

#: Byte classes: 0 other symbols, 1 capitals, 2 small letters (and all of other scripts), 3 digits, 4 space, 5 usual marks, 6 exclamation, 7 line end.
_class = np.zeros(256, np.uint8)
_class[65:91], _class[97:123], _class[128:], _class[48:58] = 1, 2, 2, 3
_class[[32, 9, 11, 12, 13]], _class[10] = 4, 7
for _c in b".,;:'\"-()?":
    _class[_c] = 5
_class[33] = 6
BASE, AROUND = 13, 5


def line_features(texts: list[str], repeated: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a visible character, their lengths, and the number of such lines of each text.

    ``repeated``: whether each line came before, for a part of a longer text. A line's own features are shares of its bytes by class, word lengths and repetition; its neighbours give AROUND of theirs.
    """
    rows, lengths, counts = [], [], []
    for text in texts:
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        counts.append(len(lines))
        if not lines:
            continue
        raw = "\n".join(lines).encode("utf-8", "replace")
        cls = _class[np.frombuffer(raw, np.uint8)]
        at = np.flatnonzero(cls == 7)
        start = np.concatenate([[0], at + 1])
        size = np.diff(np.concatenate([start, [len(cls) + 1]])) - 1.0
        share = np.stack([np.add.reduceat((cls == k).astype(np.int32), np.minimum(start, len(cls) - 1)) for k in range(7)], axis=1) / np.maximum(size, 1)[:, None]
        words = [x.split() for x in lines]
        n = np.array([max(len(w), 1) for w in words], float)
        kinds = np.array([len(set(w)) for w in words], float)
        seen: set[str] = set()
        again = np.array([x in seen or seen.add(x) is not None for x in lines], float) if repeated is None else repeated
        letters = share[:, 1] + share[:, 2]
        capital = share[:, 1] / np.maximum(letters, 1e-9) * (letters > 0)
        x = np.stack([np.ones(len(lines)), np.minimum(10 * share[:, 0], 3), np.minimum(50 * share[:, 6], 3), capital, 1 - kinds / n, again, np.minimum(5 * share[:, 3], 3), np.minimum(10 * share[:, 5], 3), np.log1p(size) / 5, np.minimum(size / n / 10, 3), (share[:, 0] > 0.04) * 1.0, (capital > 0.5) * 1.0, (kinds / n < 0.6) * 1.0], axis=1)
        near = np.zeros((len(lines), 2 * AROUND))
        near[1:, :AROUND], near[:-1, AROUND:] = x[:-1, 1 : 1 + AROUND], x[1:, 1 : 1 + AROUND]
        rows.append(np.concatenate([x, near], axis=1))
        lengths.append(size)
    if not rows:
        return np.zeros((0, BASE + 2 * AROUND)), np.zeros(0), np.array(counts, int)
    return np.concatenate(rows), np.concatenate(lengths), np.array(counts, int)


def _padded(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(counts.max(initial=0))[None, :] < counts[:, None]
    out = np.zeros((*at.shape, *values.shape[1:]))
    out[at] = values
    return out, at


def forward_backward(good: np.ndarray, at: np.ndarray, move: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good, pair marginals summed over places (zero unless ``pairs``), and log partition of each row.

    good: score of good over bad at each place (sequence, place); at: which places are; move: 2 x 2 scores of neighbours.
    """
    d, t = good.shape
    emit = np.stack([np.zeros_like(good), good], axis=2)
    fore, back = np.zeros((d, t, 2)), np.zeros((d, t, 2))
    if t == 0:
        return np.zeros((d, 0)), np.zeros((d, 2, 2)), np.zeros(d)
    fore[:, 0] = emit[:, 0]
    for i in range(1, t):
        fore[:, i] = np.where(at[:, i, None], emit[:, i] + np.logaddexp(fore[:, i - 1, 0, None] + move[0], fore[:, i - 1, 1, None] + move[1]), fore[:, i - 1])
    for i in range(t - 2, -1, -1):
        b = back[:, i + 1] + emit[:, i + 1]
        back[:, i] = np.where(at[:, i + 1, None], np.logaddexp(move[:, 0] + b[:, 0, None], move[:, 1] + b[:, 1, None]), 0)
    z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
    p = np.where(at, np.exp(np.minimum(fore[:, :, 1] + back[:, :, 1] - z[:, None], 0)), 0)
    if not pairs:
        return p, np.zeros((d, 2, 2)), z
    joint = fore[:, :-1, :, None] + move + (emit + back)[:, 1:, None, :] - z[:, None, None, None]
    return p, (np.exp(np.minimum(joint, 0)) * at[:, 1:, None, None]).sum(axis=1), z


def long_mean(good: np.ndarray, size: np.ndarray, move: np.ndarray, chunk: int = 1 << 16) -> float:
    """Length-weighted mean of the marginals of one sequence of any length: messages are carried from chunk to chunk, so that
    besides scores and lengths only one chunk's messages are held."""
    cuts = list(range(0, len(good), chunk))
    first = np.zeros((len(cuts) + 1, 2))  # what comes into each chunk, scaled

    def forward(c: int) -> np.ndarray:
        out, m = np.empty((min(chunk, len(good) - cuts[c]), 2)), first[c]
        for i, g in enumerate(good[cuts[c] : cuts[c] + chunk].tolist()):
            if c or i:
                m = np.logaddexp(m[0] + move[0], m[1] + move[1])
            m = m + (0.0, g)
            m = m - m.max()
            out[i] = m
        return out

    for c in range(len(cuts)):
        first[c + 1] = forward(c)[-1]
    total, back = 0.0, np.zeros(2)
    for c in range(len(cuts) - 1, -1, -1):
        fore = forward(c)
        for i in range(len(fore) - 1, -1, -1):
            at = cuts[c] + i
            s = fore[i] + back
            total += size[at] / (1 + np.exp(np.clip(s[0] - s[1], -700, 700)))
            back = np.logaddexp(move[:, 0] + back[0], move[:, 1] + back[1] + good[at])
            back -= back.max()
    return total / size.sum()


@dataclass(frozen=True)
class Field:
    """Weights of the features, scores of neighbouring labels, and the line from mean marginals to a score."""

    weights: np.ndarray
    move: np.ndarray
    scale: tuple[float, float]
    empty: float

    def means(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of good; nan for texts without lines."""
        out, held = np.full(len(texts), np.nan), []
        for i, text in enumerate(texts):
            good, size = self._lines(text)
            if len(good) > LONG:
                out[i] = long_mean(good, size, self.move)
            elif len(good):
                held.append((len(good), i, good, size))
        held.sort(key=lambda h: h[:2])  # texts of like length together, CELLS places at once
        start = 0
        while start < len(held):
            stop = start + 1
            while stop < len(held) and held[stop][0] * (stop + 1 - start) <= CELLS:
                stop += 1
            part = held[start:stop]
            counts = np.array([h[0] for h in part])
            good, at = _padded(np.concatenate([h[2] for h in part]), counts)
            weight, _ = _padded(np.concatenate([h[3] for h in part]), counts)
            p, _, _ = forward_backward(good, at, self.move, pairs=False)
            out[[h[1] for h in part]] = (p * weight).sum(axis=1) / weight.sum(axis=1)
            start = stop
        return out

    def _lines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Score of good over bad and length of each line with a visible character; a part of the text at a time."""
        if len(text) <= PART:
            x, size, _ = line_features([text])
            return x @ self.weights, size
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        seen: set[int] = set()
        again = np.array([(h := hash(x)) in seen or seen.add(h) is not None for x in lines], float)
        scores, sizes, start = [], [], 0
        while start < len(lines):
            stop, n = start, 0
            while stop < len(lines) and (n < PART or stop == start):
                n += len(lines[stop]) + 1
                stop += 1
            low, high = max(0, start - 1), min(len(lines), stop + 1)  # a line's features need one neighbour on each side
            x, size, _ = line_features(["\n".join(lines[low:high])], again[low:high])
            scores.append((x @ self.weights)[start - low : stop - low])
            sizes.append(size[start - low : stop - low])
            start = stop
        return (np.concatenate(scores), np.concatenate(sizes)) if scores else (np.zeros(0), np.zeros(0))

    def scores(self, texts: list[str]) -> np.ndarray:
        z = _logit(self.means(texts))
        return np.where(np.isnan(z), self.empty, 1 / (1 + np.exp(-(self.scale[0] * z + self.scale[1]))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(texts: list[str], good: np.ndarray) -> Field:
    """The field with the greatest likelihood of each document's label on all its lines, less a small square penalty.

    Then a logistic line from the mean marginals' log odds to the label. Without both labels the score is a constant.
    """
    rate = float(good.mean()) if len(good) else 0.5
    width = BASE + 2 * AROUND
    if len(set(good.tolist())) < 2:
        return Field(np.zeros(width), np.zeros((2, 2)), (0.0, float(_logit(np.array(rate)))), rate)
    x, _, counts = line_features(texts)
    label = np.repeat(good, counts)
    pieces, at = [], 0
    for n in counts.tolist():
        pieces += [min(SEQUENCE, n - i) for i in range(0, n, SEQUENCE)]
    pieces = np.array(pieces)
    start = np.concatenate([[0], np.cumsum(pieces)])
    order = np.argsort(pieces, kind="stable")
    groups = []
    for part in np.array_split(order, max(1, min(16, len(order) // 50))):
        rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in part])
        groups.append((*_padded(x[rows], pieces[part]), *_padded(label[rows], pieces[part])[:1]))
    w, move = np.zeros(width), np.zeros((2, 2))
    state = [np.zeros(width + 4), np.zeros(width + 4)]
    for step in range(1, ROUNDS + 1):
        g, gm = -DECAY * len(pieces) * w, -DECAY * len(pieces) * move
        for f, at, y in groups:
            p, joint, _ = forward_backward(f @ w, at, move)
            g = g + np.einsum("dt,dtk->k", (y - p) * at, f)
            same = (at[:, 1:]).sum(axis=1)
            own = np.zeros((len(y), 2, 2))
            first = y[:, 0].astype(int)
            own[np.arange(len(y)), first, first] = same
            gm = gm + (own - joint).sum(axis=0)
        grad = np.concatenate([g, gm.reshape(-1)]) / len(pieces)
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move_by = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, move = w + move_by[:width], move + move_by[width:].reshape(2, 2)
    field = Field(w, move, (1.0, 0.0), rate)
    z = _logit(field.means(texts))
    has = ~np.isnan(z)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method on two numbers
        p = 1 / (1 + np.exp(-(a * z[has] + b)))
        e, v = good[has] - p, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * z[has] ** 2).sum() + 1, (v * z[has]).sum()], [(v * z[has]).sum(), v.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(e * z[has]).sum() - (a - 1), e.sum()])
        a, b = a + da, b + db
    return Field(w, move, (float(a), float(b)), rate)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is 2 mod 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """The field of at most ``sample`` labelled ids (and twice as many rows, where ids repeat) that aren't held out; labels and ids are no features."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality").orderBy("doc_id", "text").limit(2 * sample).collect()
    return train([r["text"] or "" for r in rows], np.array([float(r["quality"]) for r in rows]))


def score(docs: DataFrame, field: Field, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted of every row's whole text, and the columns of ``keep``.

    Null and empty texts, and such of white space, have the share of good documents as their score. Repeated rows are kept, an
    empty table gives none. Columns of ``docs`` that are named score or predicted are not kept: the new ones take their names;
    ``accepted`` keeps them.
    """
    names = [c for c in docs.columns if c in {"doc_id", *keep} and c not in ("score", "predicted")]
    return _scored(docs, field, names, "score", "predicted")


def accepted(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts are predicted good."""
    mark, bad = fresh(docs, "_score"), fresh(docs, "_predicted")
    return _scored(docs, field, docs.columns, mark, bad).where(F.col(bad) == 1).select(*docs.columns)


def _scored(docs: DataFrame, field: Field, names: list[str], score: str, predicted: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "text"):
                s = held.value.scores([t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*names, score, predicted])

    columns = docs.select(*dict.fromkeys([*names, "text"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return columns.mapInArrow(run, f"{kinds}, {score} double, {predicted} int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see ``score``. Empty tables give no rows."""
    return score(docs, fit(docs, labels, sample)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
