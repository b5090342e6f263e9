"""Language identification with a bit-sliced Bloom filter over n-grams.

Row r of the filter is a bit mask over languages. An n-gram is looked up in `PROBES` rows; the AND of their masks
holds all languages that contain it. A text's hits are counted for each language, corrected for the false-positive
rate that the language's share of set bits implies, and the largest count decides. N-grams are four bytes of the
text with A-Z lower-cased and everything but letters made one blank.

A language's filter takes the n-grams that are frequent in it: in at least `LEAST` of its sampled texts and at least
`SHARE` of the rate of the language where it is most frequent, so that quoted passages of another language stay out.
Training takes about `SAMPLE` texts of each language, those whose id's hash lies below a bound that the language's
count implies (the bound is the only limit); all n-grams that pass enter the filter, which has at least `SLOTS` rows
for each n-gram of the largest language. Every row is predicted from its whole text.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text if nothing was
learned; equal scores go to the language that sorts first; equal texts have equal results; repeated rows are judged
one by one; rows with a null lang or id teach nothing; an empty table gives no rows; a very long text is counted in
stretches, at some 11 bytes of memory for each of its bytes; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import LOWER, STRETCH, U, materialize, mix, one_text, small, texts

SAMPLE, LEAST, SHARE, ROWS, SLOTS, PROBES = 3000, 0.002, 0.3, 1 << 18, 16, 2

_LETTER = LOWER.copy()
_LETTER[: ord("a")] = 0x20
_LETTER[ord("A") : ord("Z") + 1] = LOWER[ord("A") : ord("Z") + 1]
_LETTER[ord("z") + 1 : 128] = 0x20


def grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Four-byte n-grams of each text of a block and their rows, a long text's in stretches; a blank stands before each text."""
    if len(off) > 2 or len(data) <= STRETCH:
        yield _grams(data, off)
        return
    x = np.full(len(data) + 1, 0x20, np.uint8)
    x[1:] = _LETTER[data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20)
    x = x[keep]
    for k in range(0, len(x) - 3, STRETCH):
        y = x[k : k + STRETCH + 3].astype(np.uint32)
        g = y[:-3] | y[1:-2] << 8 | y[2:-1] << 16 | y[3:] << 24
        yield g, np.zeros(len(g), np.int64)


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    x = np.full(len(data) + n, 0x20, np.uint8)
    at = np.arange(len(data)) + row + 1
    x[at] = _LETTER[data]
    rows = np.zeros(len(x), np.int64)
    rows[at] = row
    rows[off[:-1] + np.arange(n)] = np.arange(n)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20) | (rows[1:] != rows[:-1])
    x, rows = x[keep].astype(np.uint32), rows[keep]
    if len(x) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
    whole = rows[3:] == rows[:-3]
    return g[whole], rows[:-3][whole]


def _slots(g: np.ndarray, rows: int) -> list[np.ndarray]:
    h = mix(g.astype(np.uint64) + U(0x9E3779B97F4A7C15))
    return [((h >> U(32 * k)) & U(rows - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray  # rows x words of 64 languages

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> LanguageFilter:
        languages = sorted(members)
        rows = max(ROWS, 1 << (SLOTS * max(map(len, members.values()), default=0)).bit_length())
        masks = np.zeros((rows, max(1, -(-len(languages) // 64))), np.uint64)
        for k, lang in enumerate(languages):
            for at in _slots(members[lang], rows):
                masks[at, k // 64] |= U(1 << (k % 64))
        return cls(languages, masks)

    def rates(self) -> np.ndarray:
        """False-positive rate of each language."""
        filled = [((self.masks[:, k // 64] >> U(k % 64)) & U(1)).mean() for k in range(len(self.languages))]
        return np.array(filled) ** PROBES

    def count(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Corrected counts: texts x languages."""
        n = len(off) - 1
        total, hits = np.zeros(n), np.zeros((n, len(self.languages)))
        for g, row in grams(data, off):
            a, b = _slots(g, len(self.masks))
            total += np.bincount(row, minlength=n)
            for word in range(self.masks.shape[1]):
                m = self.masks[:, word]
                m = m[a] & m[b]
                for k in range(64 * word, min(64 * word + 64, len(self.languages))):
                    hits[:, k] += np.bincount(row, weights=(m >> U(k % 64)) & U(1), minlength=n)
        fp = self.rates()
        return np.maximum(hits - total[:, None] * fp, 0) / (1 - fp)


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def train_language(docs: DataFrame, sample: int = SAMPLE) -> LanguageFilter:
    """The filter learned from about `sample` texts a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id"))).select("doc_id", "lang")
    count = small(materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_of")), "languages"))  # a row for each language
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).cast("double") * F.col("_of") < F.lit(float(sample << 40))
    ids = materialize(known.join(count, "lang").where(low).select("doc_id", "lang").distinct(), "language-ids")
    rows = one_text(docs.select("doc_id", "lang", "text").join(small(ids), ["doc_id", "lang"]), ["doc_id", "lang"]).select("lang", "text")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), dtype=object)
            for first, end, data, off in texts(b.column(1)):
                key = np.unique(np.concatenate([np.unique(row.astype(np.uint64) << U(32) | g.astype(np.uint64)) for g, row in grams(data, off)]))  # an n-gram counts once a text
                of, g = lang[first:end][(key >> U(32)).astype(np.int64)], (key & U(0xFFFFFFFF)).astype(np.int64)
                for name in set(lang[first:end]):
                    v, c = np.unique(g[of == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(v, pa.int64()), pa.array(c, pa.int64())], ["lang", "g", "c"])

    totals = {r.lang: r.n for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = rows.mapInArrow(seen, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    size = small(materialize(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes"))
    rated = counted.join(size, "lang").withColumn("rate", F.col("c") / F.col("n"))
    rated = rated.withColumn("top", F.max("rate").over(Window.partitionBy("g")))
    kept = rated.where((F.col("rate") >= LEAST) & (F.col("c") >= 2) & (F.col("rate") >= SHARE * F.col("top")))
    got = kept.select("lang", "g").toArrow()  # the sampled texts bound it
    lang, g = np.array(got.column("lang").to_pylist(), dtype=object), got.column("g").to_numpy().astype(np.uint32)
    return LanguageFilter.build({name: g[lang == name] for name in totals if (lang == name).any()})


def predict_language(docs: DataFrame, filters: LanguageFilter) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs`."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # 2 MB for each 64 languages

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        names = np.array([*f.languages, "und"], dtype=object)
        for b in batches:
            best, score = [], []
            for first, end, data, off in texts(b.column(2)):
                has = np.bincount(np.repeat(np.arange(end - first), np.diff(off)), weights=(_LETTER[data] != 0x20) & (_LETTER[data] < 0x80), minlength=end - first) > 0
                for k in np.flatnonzero(~has & (np.diff(off) > 0)):
                    has[k] = any(map(str.isalpha, bytes(data[off[k] : off[k + 1]]).decode("utf8", "ignore")))
                c = f.count(data, off) if f.languages else np.zeros((end - first, 0))
                if not f.languages:
                    best.append(np.zeros(end - first, np.int64))
                    score.append(np.zeros(end - first))
                    continue
                top = c.argmax(1)
                s = c[np.arange(len(c)), top] / np.maximum(c.sum(1), 1e-9)
                best.append(np.where(has, top, len(f.languages)))
                score.append(np.where(has, np.clip(s, 0, 1), 0.0))
            if best:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[np.concatenate(best)].tolist(), pa.string()), pa.array(np.concatenate(score))], ["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(judged, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
