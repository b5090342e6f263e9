"""Ranked lexical search over a two-level quantised index.

A document's impact for a term is (10**9 tf) div (1000 tf + 8 m), with m from its length; an item's score is the sum of
weight times impact over its different terms. The index holds blocks of documents, one row each: the block's terms, and
for each term its documents, frequencies and impacts rounded up to a byte, with the term's largest byte in front.

1. One pass counts the documents and words that lengths are compared with; a second writes the index. It covers every
   row and every term, and is searched as often as wanted.
2. Document frequencies of the asked terms are summed from the blocks' terms alone (the postings stay unread).
3. A search reads the blocks. First level: the largest bytes of a block bound all its scores; if that is below the k-th
   score that the task already has, the item passes the block by. Second level: bytes give an upper bound and, one step
   lower, a lower bound of each document's score; every document whose upper bound reaches the k-th lower bound, of the
   block or of the task so far, is scored anew in exact integers from its frequencies. Each task gives its first k.

A document that is left out has k others in its block or task that score higher, so the result is exact. Items go to
the tasks in groups of at most `ASKED` terms (one item at least). Defined results: a null or empty text has no terms; an
item without terms, or whose terms no document holds, gives no rows; rows that repeat an item_id are one item with the
terms of all; documents that repeat a doc_id are ranked one by one; a null doc_id comes last among ties; texts of any
length are read whole; empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.shared import LOWER, materialize, texts, trim, work_dir, words_of

#: Impacts are at most 10**6; a byte stands for this much.
STEP = 4000
#: Bytes of text of a block, and terms of the items that are searched together.
BLOCK_BYTES, ASKED = 6 << 20, 500_000

_GAP = np.ones(256, bool)
_GAP[0x80:] = False
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False

_BLOCK = "terms array<string>, postings binary, top binary, docs binary, tfs binary, impacts binary, ms binary"


def _terms(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The words low[s:e] as a string array."""
    n = e - s
    off = np.zeros(len(s) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    at = np.repeat(s - off[:-1], n) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(low[at].tobytes())])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to one row: documents that have terms, and their terms."""
    docs = words = 0
    for b in batches:
        for _, _, data, off in texts(b.column(0)):
            first = words_of(LOWER[data], off, _GAP)[2]
            docs += int(np.count_nonzero(np.diff(first)))
            words += int(first[-1] - first[0])
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([words], pa.int64())], ["n", "l"])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _blocks(n: int, l: int, id_type: pa.DataType):  # noqa: E741
    """(id, text) to the index's rows."""

    def row(ids: list[pa.Array], parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        coded = pa.chunked_array([t for t, _ in parts], pa.large_string()).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        count = np.concatenate([c for _, c in parts])
        d = len(count)
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * d + np.repeat(np.arange(d), count), return_counts=True)
        m = 10 + (90 * count * n) // max(1, l)
        doc = key % d
        q = -(-impact(tf, m[doc]) // STEP)
        start = np.flatnonzero(np.concatenate([[True], key[1:] // d != key[:-1] // d])) if len(key) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(q, start) if len(key) else q
        small = np.uint16 if d <= 65536 else np.uint32
        body = [np.diff([*start, len(key)]).astype(np.uint32), top.astype(np.uint8), doc.astype(small), tf.astype(np.uint16 if not len(tf) or tf.max() < 65536 else np.uint32), q.astype(np.uint8), m.astype(np.int64)]
        held = pa.concat_arrays(ids)
        arrays = [pa.ListArray.from_arrays(pa.array([0, d], pa.int32()), held), pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in body)]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "terms", "postings", "top", "docs", "tfs", "impacts", "ms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0
        for b in batches:
            for a, z, data, off in texts(b.column(1)):
                low = LOWER[data]
                s, e, first = words_of(low, off, _GAP)
                ids.append(b.column(0).slice(a, z - a))
                parts.append((_terms(low, s, e), np.diff(first)))
                size += len(data) + 16 * (z - a)
                if size >= BLOCK_BYTES:
                    yield row(ids, parts)
                    ids, parts, size = [], [], 0
        if ids:
            yield row(ids, parts)
        trim()

    return run


@dataclass
class Index:
    """A written index: its folder, the documents with terms, all their terms, and the type of the ids."""

    path: str
    n: int
    l: int  # noqa: E741
    id_type: T.DataType

    def rows(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("ids", T.ArrayType(self.id_type)), *T._parse_datatype_string(_BLOCK).fields])
        return spark.read.schema(schema).parquet(self.path)


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Writes the index of every row of `docs`, to `path` or a new folder of the shared one."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    size = docs.select(text_col).mapInArrow(_sizes, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    path = path or f"{work_dir(spark, 'lexical')}/index"
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *T._parse_datatype_string(_BLOCK).fields])
    docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_blocks(size.n, size.l, id_type), schema).write.option("compression", "zstd").parquet(path)
    return Index(path, size.n, size.l, id_type)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, term), each different term of a row once."""
    for b in batches:
        for a, _, data, off in texts(b.column(1)):
            low = LOWER[data]
            s, e, first = words_of(low, off, _GAP)
            if not len(s):
                continue
            coded = _terms(low, s, e).dictionary_encode()
            key = np.unique(np.repeat(np.arange(len(off) - 1), np.diff(first)) * len(coded.dictionary) + coded.indices.to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(a + key // len(coded.dictionary))), coded.dictionary.take(pa.array(key % len(coded.dictionary))).cast(pa.string())], ["item", "term"])


def _frequencies(asked):
    """Blocks' (terms, postings) to (term, df) of the asked terms, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(asked.value, pa.string())
        df = np.zeros(len(terms), np.int64)
        for b in batches:
            for t, p in zip(b.column(0), b.column(1), strict=True):
                at = pc.index_in(terms, value_set=t.values.cast(pa.string())).fill_null(-1).to_numpy()
                df[at >= 0] += np.frombuffer(p.as_py(), np.uint32)[at[at >= 0]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    return run


class _Block:
    """A row of the index, read back."""

    def __init__(self, row: dict, terms: pa.Array) -> None:
        raw = lambda c, kind: np.frombuffer(row[c].as_py(), kind)
        self.ids, self.m = row["ids"].values, raw("ms", np.int64)
        self.at = pc.index_in(terms, value_set=row["terms"].values.cast(pa.string())).fill_null(-1).to_numpy()  # of each asked term
        size = raw("postings", np.uint32).astype(np.int64)
        self.end = np.cumsum(size)
        self.start, self.top, self.q = self.end - size, raw("top", np.uint8).astype(np.int64), raw("impacts", np.uint8)
        n = len(self.q)
        self.doc = raw("docs", np.uint16 if len(row["docs"].as_py()) == 2 * n else np.uint32)
        self.tf = raw("tfs", np.uint16 if len(row["tfs"].as_py()) == 2 * n else np.uint32)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, reached: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) that may be among an item's first k, given that k scores of `reached` are known."""
        none = np.zeros(0, np.int64)
        held = self.at[terms] >= 0
        at, w = self.at[terms[held]], weights[held]
        if not len(at) or int((w * self.top[at]).sum()) * STEP < reached:
            return none, none
        upper, slack = np.zeros(len(self.m), np.int64), np.zeros(len(self.m), np.int64)
        for t, x in zip(at, w, strict=True):
            d = self.doc[self.start[t] : self.end[t]]
            upper[d] += x * self.q[self.start[t] : self.end[t]]
            slack[d] += x
        upper *= STEP
        lower = upper - slack * (STEP - 1)
        kth = int(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) >= k else 0
        d = np.flatnonzero(upper >= max(kth, reached, 1))
        if not len(d):
            return none, none
        score = np.zeros(len(d), np.int64)
        for t, x in zip(at, w, strict=True):
            own = self.doc[self.start[t] : self.end[t]]
            p = np.minimum(np.searchsorted(own, d), len(own) - 1)
            hit = own[p] == d
            score[hit] += x * impact(self.tf[self.start[t] : self.end[t]][p[hit]].astype(np.int64), self.m[d[hit]])
        return d, score


def _searched(asked, k: int, item_type: pa.DataType, id_type: pa.DataType):
    """Blocks to (item, doc, score): a task's first k of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, of, first, weight = asked.value
        words = pa.array(terms, pa.string())
        found: list[list[tuple[int, bool, object]]] = [[] for _ in items]  # (-score, whether the id is null, id), the first k
        for b in batches:
            for r in range(b.num_rows):
                block = _Block({c: b.column(c)[r] for c in b.schema.names}, words)
                for i in range(len(items)):
                    t = of[first[i] : first[i + 1]]
                    d, score = block.best(t, weight[t], k, -found[i][-1][0] if len(found[i]) == k else 0)
                    if len(d) > 4 * k:
                        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                        d, score = d[keep], score[keep]
                    if len(d):
                        ids = block.ids.take(pa.array(d)).to_pylist()
                        new = [(-s, x is None, x if x is not None else 0) for s, x in zip(score.tolist(), ids, strict=True) if s > 0]
                        found[i] = sorted([*found[i], *new])[:k]
        out = [(items[i], None if null else x, -s) for i, rows in enumerate(found) for s, null, x in rows]
        if out:
            item, doc, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, item_type), pa.array(doc, id_type), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])
        trim()

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(spark: SparkSession, index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents."""
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item", item_type), T.StructField("term", T.StringType())])
    wanted = materialize(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).mapInArrow(_item_terms, schema).distinct(), "asked")
    groups = -(-wanted.count() // ASKED)
    result = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", index.id_type), T.StructField("score", T.LongType())])
    rows = spark.createDataFrame([], result)
    for g in range(groups):  # a group's terms have a bound, so that they can go to all tasks
        mine = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).orderBy("item", "term").toArrow()
        coded = mine.column("item").to_pylist()
        starts = [j for j in range(len(coded)) if j == 0 or coded[j] != coded[j - 1]]
        terms = mine.column("term").combine_chunks().dictionary_encode()
        terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
        told = spark.sparkContext.broadcast(terms.dictionary.to_pylist())
        df = index.rows(spark).select("terms", "postings").mapInArrow(_frequencies(told), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        w = np.zeros(len(terms.dictionary), np.int64)
        w[df.column("term").to_numpy()] = [weight(index.n, x) for x in df.column("df").to_pylist()]
        asked = spark.sparkContext.broadcast(([coded[j] for j in starts], told.value, terms.indices.to_numpy().astype(np.int64), [*starts, len(coded)], w))
        found = index.rows(spark).mapInArrow(_searched(asked, k, to_arrow_type(item_type), to_arrow_type(index.id_type)), result)
        rows = rows.unionByName(found)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM benchmark),
d AS (SELECT doc_id, row_number() OVER () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
g AS (SELECT count(*) n, sum(len(w))::BIGINT l FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, n_words, term, count(*) tf FROM (SELECT r, doc_id, len(w) n_words, unnest(w) term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) df FROM t GROUP BY term),
x AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n_words * n) // l)) impact FROM t, g),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) w FROM f, g),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * impact) AS BIGINT) score FROM q JOIN w USING (term) JOIN x USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
