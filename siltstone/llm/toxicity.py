"""Toxicity with a classifier chain.

Categories are predicted one after another by linear (logistic) models; a model's inputs are the text's word features
and the probabilities of the categories before it. In training those probabilities come from out-of-fold predictions,
so that a later model never sees what an earlier one learned by heart.

Features are presence bits of words and of word beginnings (4 and 5 bytes), for words of letters
with A-Z lower-cased; the `FEATURES` with the strongest evidence are kept, of equal ones that with the smaller hash.
The categories of the query are `toxic`, as `labels.toxic` has it, and `severe`. The tables have no second label, so
`severe` is a weak one made in training: a toxic text is severe if at least `SEVERE` of its `PARTS` parts (runs of as
many words each) are toxic by themselves, as a model trained on the other folds judges each part alone. Where in a
text the evidence lies is not among the inputs of either model.

Training takes at most `SAMPLE` labelled rows, those with the lowest hash of their id; every row is scored over its
whole text, however long, at some 20 bytes of memory for each of its bytes. Defined results: a null text is an empty
text; equal texts have equal scores; repeated rows are scored one by one; null labels and labels without a document
are left out; of several labels of a document the largest counts; without labels, or with labels of one value, every
probability is 0; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import LOWER, U, lowest, materialize, one_text, small, texts, word_hashes, words_of

SAMPLE, FEATURES, FOLDS, PARTS, SEVERE, RIDGE = 20_000, 256, 3, 4, 2, 0.1

_GAP = np.ones(256, bool)
_GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
BEGINNINGS = (4, 5)


def features(data: np.ndarray, off: np.ndarray, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of a block, and their rows; a text has a row for each of its parts."""
    low = LOWER[data]
    s, e, first = words_of(low, off, _GAP)
    count = np.diff(first)
    row = np.repeat(np.arange(len(off) - 1), count)
    if parts > 1:
        row = row * parts + (np.arange(len(s)) - first[row]) * parts // count[row]
    out, rows = [word_hashes(low, s, e)], [row]
    for n in BEGINNINGS:
        long = e - s > n
        out.append(word_hashes(low, s[long], s[long] + n) + U(n))
        rows.append(row[long])
    return np.concatenate(out), np.concatenate(rows)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights (last: intercept) by Newton's method with a quadratic penalty."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    """Linear models in the order of the categories, each with the earlier ones' probabilities as further inputs."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    names: tuple[str, ...] = ()
    weights: list[np.ndarray] = field(default_factory=list)

    def bits(self, data: np.ndarray, off: np.ndarray, parts: int = 1) -> np.ndarray:
        """Whether each kept feature occurs: texts (or their parts) x features."""
        n, k = (len(off) - 1) * parts, len(self.hashes)
        if not k:
            return np.zeros((n, 0), bool)
        h, row = features(data, off, parts)
        table = np.full(1 << 16, -1, np.int32)  # a first look that most words fail
        table[(self.hashes & U(0xFFFF)).astype(np.int64)] = 1
        may = table[(h & U(0xFFFF)).astype(np.int64)] >= 0
        h, row = h[may], row[may]
        at = np.minimum(np.searchsorted(self.hashes, h), k - 1)
        hit = self.hashes[at] == h
        found = np.zeros(n * k, bool)
        found[row[hit] * k + at[hit]] = True
        return found.reshape(n, k)

    def predict(self, bits: np.ndarray) -> np.ndarray:
        x = bits.astype(np.float64)
        for w in self.weights:
            x = np.column_stack([x, probability(x, w)])
        return x[:, bits.shape[1] :] if self.weights else np.zeros((len(bits), len(self.names)))


def fit_chain(hashes: np.ndarray, bits: np.ndarray, labels: dict[str, np.ndarray], fold: np.ndarray) -> Chain:
    """Models for the categories in the order of `labels`; fold: 0..FOLDS-1 for each row."""
    chain = Chain(hashes, tuple(labels))
    x = bits.astype(np.float64)
    for y in labels.values():
        out = np.zeros(len(x))
        for k in range(FOLDS):
            inside = fold != k
            if inside.any() and (~inside).any():
                out[~inside] = probability(x[~inside], logistic(x[inside], y[inside]))
        chain.weights.append(logistic(x, y))
        x = np.column_stack([x, out])
    return chain


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_y"))
    known = materialize(lowest(materialize(known, "toxicity-known"), "doc_id", sample), "toxicity-labels")
    fold = (F.crc32(F.concat(F.lit("fold"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).cast("binary")) % FOLDS).cast("int")  # equal texts share a fold
    rows = one_text(docs.select("doc_id", "text").join(small(known), "doc_id"), ["doc_id"])
    rows = materialize(rows.select("text", "_y", fold.alias("_fold")), "toxicity-texts")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            for first, end, data, off in texts(b.column(0)):
                h, row = features(data, off)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, yes = h[new], y[first:end][row[new]].astype(np.int64)
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                if len(start):
                    n = np.diff([*start, len(h)])
                    pos = np.add.reduceat(yes, start)
                    yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(pos), pa.array(n - pos)], ["h", "pos", "neg"])

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("pos")).first()
    if not totals.n or not totals.pos or totals.pos == totals.n:
        return Chain(names=("toxic", "severe"))
    counted = rows.mapInArrow(seen, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (totals.pos + 1)) - F.log((F.col("neg") + 0.5) / (totals.n - totals.pos + 1))
    strongest = counted.where("pos >= 3").withColumn("z", odds * F.sqrt("pos")).where("z > 0").orderBy(F.desc("z"), "h").limit(FEATURES).collect()
    if not strongest:
        return Chain(names=("toxic", "severe"))
    chain = Chain(np.sort(np.array([r.h for r in strongest], np.int64).view(np.uint64)))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, off in texts(b.column(0)):
                x = np.packbits(chain.bits(data, off, PARTS).reshape(end - first, -1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1)[first:end], b.column(2)[first:end]], ["x", "_y", "_fold"])

    got = rows.mapInArrow(marked, "x binary, _y int, _fold int").toArrow()  # bounded by the sample
    width = len(chain.hashes)
    packed = np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(got.num_rows, -1)
    parts = np.unpackbits(packed, axis=1, count=PARTS * width).reshape(got.num_rows, PARTS, width).astype(bool)
    y, fold = got.column("_y").to_numpy().astype(float), got.column("_fold").to_numpy()
    bits = parts.any(1)
    return fit_chain(chain.hashes, bits, {"toxic": y, "severe": severe_labels(bits, parts, y, fold)}, fold)


def severe_labels(bits: np.ndarray, parts: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """1 for toxic texts of which enough parts are toxic by themselves, by the model of the other folds."""
    many = np.zeros(len(y))
    for k in range(FOLDS):
        inside = fold != k
        if inside.any() and (~inside).any():
            w = logistic(bits[inside].astype(np.float64), y[inside])
            many[~inside] = (probability(parts[~inside].reshape(-1, parts.shape[2]).astype(np.float64), w).reshape(-1, parts.shape[1]) >= 0.5).sum(1)
    return y * (many >= SEVERE)


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_toxic, p_severe, toxic (0/1), severe (0/1) for each row of `docs`."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES numbers a category

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [held.value.predict(held.value.bits(data, off)) for _, _, data, off in texts(b.column(1))]
            if p:
                p = np.concatenate(p)
                yes = (p >= threshold).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(yes[:, 0]), pa.array(yes[:, 0] * yes[:, 1])], ["doc_id", "p_toxic", "p_severe", "toxic", "severe"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {id_type}, p_toxic double, p_severe double, toxic int, severe int")
