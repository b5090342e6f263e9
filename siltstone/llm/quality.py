"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A text becomes a row of statistics (lengths, shares of character classes, repetition, entropy), computed over the
whole text. Random Fourier features approximate a Gaussian kernel over them. Each partition of the training rows
sums its own part of the normal equations; the ridge weights solve their total. Raw scores of held-back training
rows are made probabilities by isotonic regression.

Training takes at most `SAMPLE` labelled rows, those with the lowest hash of their id, a documented bound; every
row is scored. Defined results: a null text is an empty text and has a score; equal texts have equal scores;
repeated rows are scored one by one; null labels and labels without a document are left out; of a document with
several labels the mean decides (0.5 counts as 1); without any label every score is 0.5; an empty table gives no
rows; a text of any length is measured whole, at some 40 bytes of memory for each of its bytes; other columns are kept
by `score_quality` under their own names, which the score's must not be among (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.shared import LOWER, STRETCH, lowest, materialize, one_text, small, texts, word_hashes, words_of

#: Bounds and parameters of training.
SAMPLE, FEATURES, RIDGE, SEED, THRESHOLD = 40_000, 384, 1e-3, 7, 0.7

_CLASSES = np.zeros((256, 9))
_CLASSES[65:91, 0] = 1  # upper case
_CLASSES[97:123, 1] = 1  # lower case
_CLASSES[48:58, 2] = 1  # digits
_CLASSES[[0x20, 0x09, 0x0D], 3] = 1  # blanks
_CLASSES[0x0A, 4] = 1  # line ends
_CLASSES[[ord(c) for c in ".,;:'\"()-"], 5] = 1  # prose marks
_CLASSES[[ord(c) for c in "!?"], 6] = 1
_CLASSES[[ord(c) for c in "#$%&*+/<=>@[]\\^_`{|}~"], 7] = 1
_CLASSES[128:, 8] = 1
STATISTICS = 18


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h in each of n rows."""
    order = np.lexsort((h, row))
    r, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[first], minlength=n)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a block."""
    n, lens = len(off) - 1, np.diff(off)
    if n == 1:  # a long text stands alone
        counts = sum((np.bincount(data[k : k + STRETCH], minlength=256) for k in range(0, len(data), STRETCH)), np.zeros(256, np.int64)).reshape(1, 256)
    else:
        counts = np.bincount(np.repeat(np.arange(n), lens) * 256 + data, minlength=n * 256).reshape(n, 256)
    total = np.maximum(lens, 1)[:, None]
    shares = counts @ _CLASSES / total
    p = counts / total
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    s, e, first = words_of(data, off)
    n_words = np.diff(first)
    w_row = np.repeat(np.arange(n), n_words)
    w = word_hashes(LOWER[data], s, e)
    again = np.zeros(len(w))
    if len(w) > 1:
        again[1:] = (w[1:] == w[:-1]) & (w_row[1:] == w_row[:-1])
    ends = data[e - 1] if len(e) else data[:0]
    odd = (_CLASSES[ends, 6] + _CLASSES[ends, 7]) if len(e) else np.zeros(0)
    is_line = np.zeros(256, bool)
    is_line[0x0A] = True
    ls, le, lfirst = words_of(data, off, is_line)
    n_lines = np.diff(lfirst)
    l_row = np.repeat(np.arange(n), n_lines)
    lines = word_hashes(data, ls, le)
    per = lambda x, by, m: np.bincount(by, weights=x, minlength=n) / np.maximum(m, 1)
    length = (e - s).astype(float)
    mean_len = per(length, w_row, n_words)
    return np.column_stack([
        shares, entropy, np.log1p(lens), np.log1p(n_lines), mean_len, np.sqrt(np.maximum(per(length**2, w_row, n_words) - mean_len**2, 0)),
        _distinct(w_row, w, n) / np.maximum(n_words, 1), per(again, w_row, n_words), per(odd, w_row, n_words), _distinct(l_row, lines, n) / np.maximum(n_lines, 1),
    ])


def _each(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Statistics of each batch."""
    for b in batches:
        x = [statistics(data, off) for _, _, data, off in texts(b.column(column))]
        if x:
            yield b, np.concatenate(x)


@dataclass
class QualityModel:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(STATISTICS))
    scale: np.ndarray = field(default_factory=lambda: np.ones(STATISTICS))
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def fourier(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ w + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES)
        return np.column_stack([z, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights if self.weights is not None else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values, ties of x pooled first."""
    order = np.argsort(x, kind="stable")
    xs, start = np.unique(x[order], return_index=True)
    sums, ns = np.add.reduceat(y[order], start), np.diff([*start, len(y)])
    blocks: list[list[float]] = []
    for at, s, n in zip(xs, sums, ns, strict=True):
        blocks.append([s, n, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2], hi]
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    values = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return knots, values


def in_training(doc_id: Column, of: int = 4, out: int = 2) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of != out


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    known = materialize(lowest(materialize(known, "quality-known"), "doc_id", sample), "quality-labels")
    held_back = F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    rows = one_text(docs.select("doc_id", "text").join(small(known), "doc_id"), ["doc_id"]).select("text", "_y", held_back.alias("_cal"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "_y", "_cal"])

    rows = materialize(rows.mapInArrow(measured, "x array<double>, _y int, _cal boolean"), "quality-statistics")
    model = QualityModel()
    fit = rows.where(~F.col("_cal"))
    n = fit.count()
    if n == 0:
        return model
    moments = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    model.mean, model.scale = np.array([r.m for r in moments]), np.array([max(r.s, 1e-6) for r in moments])

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for x in batches:
            z = model.fourier(np.array(x.column(0).to_pylist()).reshape(-1, STATISTICS))
            y = x.column(1).to_numpy(zero_copy_only=False)
            a += z.T @ z
            b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b"])

    # The sample bounds the partitions, and so what reaches the driver.
    parts = fit.select("x", "_y").repartition(max(1, min(8, n // 2000))).mapInArrow(equations, "a binary, b binary").collect()
    a = sum(np.frombuffer(r.a).reshape(FEATURES + 1, FEATURES + 1) for r in parts)
    b = sum(np.frombuffer(r.b) for r in parts)
    model.weights = np.linalg.solve(a + RIDGE * n * np.diag([*np.full(FEATURES, 1.0), 1e-6]) / FEATURES, b)
    cal = rows.where("_cal").select("x", "_y").toArrow()
    if cal.num_rows:
        x = np.array(cal.column("x").to_pylist()).reshape(-1, STATISTICS)
        model.knots, model.values = isotonic(model.raw(x), cal.column("_y").to_numpy().astype(float))
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """`docs` with a score of each text; `name` must not be one of its columns."""
    if name in docs.columns:
        raise ValueError(f"docs already has a column {name}")
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few kB, whatever the input
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(data, off) for _, _, data, off in texts(b.column(at))]
            s = held.value.score(np.concatenate(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`."""
    scored = score_quality(docs.select("doc_id", "text"), train_quality(docs, labels), "score")
    return scored.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
