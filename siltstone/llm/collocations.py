"""Phrase collocation mining.

1. Texts are lower-cased in A-Z and cut into pieces; identical pieces of a language become one with a multiplicity, first
   within a task, then over a shuffle.
2. Hash sums of words and word pairs, added up fragment by fragment, are upper bounds of their counts (hashes that
   collide only add). What reaches the threshold is marked in a bit filter of at most 32 MB, which goes to all tasks.
   A phrase can't be frequent if one of its pairs isn't: what the filter lets through by chance costs work, nothing else.
3. Phrases of one to `WIDEST` words that pass are summed within a task, keyed by exact word numbers, and go to the hash
   bucket of their text. In each bucket duckdb sums the weighted phrases out of core, under a fixed amount of memory.
4. Each cut of a candidate asks for the counts of its two parts: the requests are shuffled to the parts' buckets, the
   answers go back to the candidate. Longer candidates tell the phrases inside them their count in the same way.
5. The first phrases of each language are cut in salted parts before they meet.

All counts are exact, and products are decimals. Defined results: a null text is empty; a null language is `und` and
joins documents whose language is that string; repeated rows and ids all count; text of any length is read whole, and
a piece of any length is one row; ties are told apart by the phrase's bytes; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import LANE, U, dealt, materialize, mix, n_fragments, one_by_one, trim, word_hashes

#: Most words of a phrase, least count, phrases reported for each language, and the percentage from which a longer phrase covers one inside it.
WIDEST, LEAST, FIRST, COVERED = 4, 30, 2000, 80
SCALE = 2_000_000
#: Pieces held in a task before they go on, and bytes of pieces whose phrases are summed at a time.
HELD_BYTES, CHUNK_BYTES = 16 << 20, 6 << 20
#: Bits of the filter for each entry, and at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Memory of duckdb in a bucket; beyond it, it spills to its temporary folder.
BUCKET_MEMORY = "256MB"
#: Parts in which a language's first phrases are cut before they meet.
SALTS = 16

_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]+")


def _counted_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, piece, words, weight): pieces with single spaces, those that are alike in a task summed."""
    held: dict[tuple[str, bytes], int] = {}
    size = 0

    def flushed() -> pa.RecordBatch:
        keys = list(held)
        piece = [k[1] for k in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array(piece, pa.binary()).cast(pa.string()), pa.array([p.count(b" ") + 1 for p in piece], pa.int64()), pa.array(list(held.values()), pa.int64())],
            ["lang", "piece", "words", "weight"],
        )

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
            for p in _BREAK.split((text.as_py() or b"").lower()):
                p = b" ".join(p.split())
                if p:
                    key = (lang, p)
                    n = held.get(key, 0)
                    held[key] = n + 1
                    if not n:
                        size += len(p) + 64
                        if size > HELD_BYTES:
                            yield flushed()
                            held.clear()
                            size = 0
    if held:
        yield flushed()
    trim()


def pieces(docs: DataFrame, by: str = "lang", text: str = "text") -> DataFrame:
    """lang, piece, words, weight: every different piece of each language with its number of occurrences."""
    slim = docs.select(F.coalesce(F.col(by).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    found = slim.mapInArrow(_counted_pieces, "lang string, piece string, words long, weight long")
    return found.groupBy("lang", "piece", "words").agg(F.sum("weight").alias("weight"))


class _Chunk:
    """Words of some pieces: dictionary, and for each word its number, language, weight and how many words its piece has from it on."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(batches)
        lang = t.column("lang").combine_chunks().dictionary_encode()
        lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
        cut = pc.split_pattern(pa.concat_arrays([c.cast(pa.large_string()) for c in t.column("piece").chunks]), " ")
        off = np.asarray(cut.offsets, np.int64)
        coded = cut.flatten().dictionary_encode()
        row = np.repeat(np.arange(t.num_rows), np.diff(off))
        self.words, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.langs, self.lang = lang.dictionary.cast(pa.large_string()), lang.indices.to_numpy().astype(np.int64)[row]
        self.weight, self.left = t.column("weight").to_numpy()[row], off[1:][row] - np.arange(len(row))

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word, places at which a pair begins, hash of each pair; they depend on language and words only."""
        w, of = _hashed(self.words)[self.code], _hashed(self.langs)[self.lang]
        at = np.flatnonzero(self.left > 1)
        with np.errstate(over="ignore"):
            single = mix(w * LANE[0] + of * LANE[2])
            return single, at, mix(w[at] * LANE[0] + w[at + 1] * LANE[1] + of[at] * LANE[3])


def _hashed(strings: pa.Array) -> np.ndarray:
    """64-bit hash of each string's bytes."""
    off = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return word_hashes(data, off[:-1] - off[0], off[1:] - off[0])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
            if size >= CHUNK_BYTES:
                yield _Chunk(held)
                held, size = [], 0
    if held:
        yield _Chunk(held)
    trim()


def _bounds(shift: int, least: int):
    """Pieces to rows (fragment, body): hashes of words and pairs, and their sums, which needn't be known beyond `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            single, at, pair = c.hashes()
            h, inverse = np.unique(np.concatenate([single, pair]), return_inverse=True)
            n = np.bincount(inverse, weights=np.minimum(np.concatenate([c.weight, c.weight[at]]), least))
            n = np.minimum(n, least).astype(np.uint32)
            f = (h >> U(shift)).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            body = [h[a:z].tobytes() + n[a:z].tobytes() for a, z in zip(start, [*start[1:], len(h)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(f[start]), pa.array(body, pa.binary())], ["fragment", "body"])

    return run


def _frequent(least: int):
    """Rows (fragment, body) to the hashes whose sums reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in one_by_one(batches):
            raw = t.column("body").to_pylist()
            h = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 12) for x in raw])
            n = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 12, len(x) // 12 * 8) for x in raw])
            h, inverse = np.unique(h, return_inverse=True)
            h = h[np.bincount(inverse, weights=n) >= least]
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return run


#: Bits of a part of the filter.
PART = 1 << 16


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, slot) to the parts' bits."""
    for part, t in one_by_one(batches):
        bits = np.zeros(PART, np.uint8)
        bits[t.column("slot").to_numpy() % PART] = 1
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])


def frequent_filter(found: DataFrame, least: int = LEAST) -> np.ndarray:
    """Bits for the hashes of words and pairs of `found` that may occur `least` times; its length, a power of two, has a bound."""
    shift = 64 - max(1, (n_fragments(found) - 1).bit_length())  # the leading bits of a hash name its fragment
    sums = found.mapInArrow(_bounds(shift, least), "fragment long, body binary")
    kept = materialize(dealt(sums, "fragment").mapInArrow(_frequent(least), "h long"), "frequent")
    bits = min(MOST_BITS, max(PART, 1 << (BITS_EACH * kept.count()).bit_length()))
    slot = kept.select(F.col("h").bitwiseAND(bits - 1).alias("slot")).select(F.floor(F.col("slot") / PART).alias("part"), "slot")
    out = np.zeros(bits // 8, np.uint8)
    for r in dealt(slot, "part").mapInArrow(_parts, "part long, bits binary").collect():  # at most MOST_BITS / 8 bytes
        out[r.part * PART // 8 : (r.part + 1) * PART // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _phrases(bits, widest: int):
    """Pieces to (lang, phrase, size, weight), summed within a chunk, of the phrases whose words and pairs all pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = bits.value

        def passes(h: np.ndarray) -> np.ndarray:
            slot = (h & U(8 * len(mask) - 1)).astype(np.int64)
            return (mask[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

        for c in _chunks(batches):
            single, at, pair = c.hashes()
            word = passes(single)
            linked = np.zeros(len(word), bool)
            linked[at[passes(pair)]] = True
            linked[:-1] &= word[:-1] & word[1:]
            number, key = np.zeros(len(word), np.int64), c.lang * len(c.words) + c.code
            q = np.flatnonzero(word)
            for size in range(1, widest + 1):
                if size == 2:
                    q = q[linked[q]]
                elif size > 2:
                    q = q[c.left[q] >= size]
                    q = q[linked[q + size - 2]]
                if not len(q):
                    break
                if size > 1:
                    key = number[q] * len(c.words) + c.code[q + size - 1]
                else:
                    key = key[q]
                _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                number[q] = inverse
                weight = np.bincount(inverse, weights=c.weight[q]).astype(np.int64)
                for a in range(0, len(first), 1 << 16):
                    p = q[first[a : a + (1 << 16)]]
                    text = pc.binary_join_element_wise(*[c.words.take(pa.array(c.code[p + j])) for j in range(size)], pa.scalar(" ", pa.large_string()))
                    yield pa.RecordBatch.from_arrays([c.langs.take(pa.array(c.lang[p])).cast(pa.string()), text.cast(pa.string()), pa.array(np.full(len(p), size, np.int32)), pa.array(weight[a : a + (1 << 16)])], ["lang", "phrase", "size", "weight"])

    return run


def _bucket(least: int):
    """Weighted phrases of a hash bucket to their counts, summed by duckdb with a bound on its memory; those below `least` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("weight", pa.int64())])
        with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as con:
            con.register("weighted", pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches)))
            yield from con.sql(f"SELECT lang, phrase, any_value(size) AS size, CAST(sum(weight) AS BIGINT) AS f FROM weighted GROUP BY lang, phrase HAVING sum(weight) >= {int(least)}").to_arrow_reader(1 << 15)
        trim()

    return run


def phrase_counts(found: DataFrame, least: int = LEAST, widest: int = WIDEST) -> DataFrame:
    """lang, phrase, size, f: the phrases of one to `widest` words that occur at least `least` times in `found`, which has pieces with weights."""
    bits = found.sparkSession.sparkContext.broadcast(frequent_filter(found, least))
    weighted = found.mapInArrow(_phrases(bits, widest), "lang string, phrase string, size int, weight long")
    return weighted.repartition("lang", "phrase").mapInArrow(_bucket(least), "lang string, phrase string, size int, f long")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of each candidate: the cut that scores lowest."""
    w = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(F.col("w"), start, n), " ")
    cut = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), w.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = F.array(F.struct(F.lit(0).alias("side"), part(1, F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))
    asked = cut.withColumn("x", F.explode(sides)).select("lang", "phrase", "size", "a", "k", "x.side", "x.part")
    told = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    answered = asked.join(told, ["lang", "part"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("of")))
    each = answered.groupBy("lang", "phrase", "size", "a", "k").agg(of(0).alias("l"), of(1).alias("r"))
    score = F.expr(f"(CAST(a AS DECIMAL(19, 0)) * {SCALE}) div (CAST(l AS DECIMAL(19, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return each.groupBy("lang", "phrase", "size", "a").agg(lowest.alias("x")).select("lang", "phrase", "size", "a", "x.l", "x.r", "x.score")


def uncovered(candidates: DataFrame, percent: int = COVERED) -> DataFrame:
    """The candidates that don't lie inside a longer one with `percent` of their count."""
    w = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))))
    inside = candidates.where("size > 2").select("lang", "size", F.col("a").alias("over"), w.alias("w")).select("lang", "over", F.explode(F.array_distinct(spans)).alias("phrase"))
    largest = inside.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    return candidates.join(largest, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.col("over").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * percent)).drop("over")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, widest: int = WIDEST, percent: int = COVERED, by: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of each language."""
    found = materialize(pieces(docs, by, text), "pieces")
    counts = materialize(phrase_counts(found, least, widest), "phrases")
    n = found.groupBy("lang").agg(F.sum(F.col("weight") * F.col("words")).alias("n"))
    kept = uncovered(scored(counts), percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) n FROM w GROUP BY lang),
g AS (SELECT lang, phrase, k, count(*) f FROM (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) i FROM w), (SELECT unnest([1, 2, 3, 4]) k) WHERE i + k - 1 <= len(w)) GROUP BY lang, phrase, k HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f a, string_split(phrase, ' ') w FROM g WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, a, c.j, x.f l, y.f r, (CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) score
      FROM (SELECT *, unnest(range(1, k)) j FROM c) c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j+1:c.k], ' ')),
m AS (SELECT lang, phrase, k, a, l, r, CAST(score AS BIGINT) score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, array_to_string(w[i:i+z-1], ' ') phrase, max(a) over_a FROM (SELECT lang, w, a, z, unnest(range(1, k - z + 2)) i FROM (SELECT *, unnest(range(2, k)) z FROM c)) GROUP BY 1, 2),
q AS (SELECT m.* FROM m LEFT JOIN o ON o.lang = m.lang AND o.phrase = m.phrase WHERE over_a IS NULL OR 100 * over_a < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT q.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank FROM q) JOIN t USING (lang) WHERE rank <= 2000
"""
