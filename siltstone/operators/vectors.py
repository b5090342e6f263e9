"""Vectors in blocks, and a vector index on disk whose cells are chosen before anything of them is read.

`nearest` compares all vectors with a stated set of queries, block by block, as products of matrices. The index deals
vectors to cells around centres, one folder for each cell. The centres are fitted on a bounded sample, `SAMPLE` vectors
with the lowest hash of their id; every vector is in the index. A query is compared with the centres and then with the
vectors of its nearest cells; other cells' files stay unread. How many cells that takes for a wished recall is measured
on the sample, whose own neighbours are known.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.search import topk
from siltstone.operators.steps import read_file, spread

#: Vectors that centres are fitted on, cells at most, rounds of fitting, and sampled queries that the number of probes is measured with.
SAMPLE, MOST_CELLS, ROUNDS, MEASURED = 20_000, 4096, 8, 256
#: Queries that are compared with a block of vectors at a time, and bytes of queries that go to all tasks together.
AT_A_TIME, QUERY_BYTES = 256, 64 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column's vectors, all of one width, scaled to length 1; a vector of zeros stays."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _width(queries: DataFrame, vector: str) -> int:
    dims = queries.select(F.max(F.size(vector)), F.min(F.size(vector))).first()
    if dims[0] != dims[1]:
        raise ValueError("queries differ in width")
    return dims[0] or 0


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, query_id: str, query_vector: str, k: int = 10, min_score: float | None = None, allowed: DataFrame | None = None, cell: str = "cell", by: str | None = None) -> DataFrame:
    """(query, id, score, rank): the k nearest vectors by cosine, ties by id; a batch passes on its first k of each query.

    With `by`, a column of `vectors`, each of its values has k of its own and the column comes along. With `allowed`, rows (query, cell), a query meets only the vectors of its cells. Queries go to all tasks in groups of
    at most `QUERY_BYTES`. Vectors of another width than the queries' are left out.
    """
    spark, width = vectors.sparkSession, _width(queries, query_vector)
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    groups = max(1, -(-q.count() * width * 8 // QUERY_BYTES))
    kinds = vectors.schema[id_col].dataType, queries.schema[query_id].dataType
    out = T.StructType([T.StructField(query_id, kinds[1]), T.StructField(id_col, kinds[0]), T.StructField("score", T.DoubleType()), *([vectors.schema[by]] if by else [])])
    rows = spread(vectors.where(F.size(vector) == width).select(F.col(id_col), F.col(vector), *([cell] if allowed is not None else []), *([by] if by else [])))
    found = spark.createDataFrame([], out)
    for g in range(groups):
        mine = q.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g).toArrow()
        if not mine.num_rows:
            continue
        cells: dict[object, list[int]] = {}
        if allowed is not None:
            place = {x: j for j, x in enumerate(mine.column("q").to_pylist())}
            for r in allowed.collect():  # queries times probes
                if r[query_id] in place:
                    cells.setdefault(r[cell], []).append(place[r[query_id]])
        told = spark.sparkContext.broadcast((mine.column("q").combine_chunks(), _matrix(mine.column("v").combine_chunks()), cells))
        found = found.unionByName(rows.mapInArrow(_compared(told, k, min_score, allowed is not None, by is not None, [f.name for f in out]), out))
    return topk(found, [query_id, *([by] if by else [])], [F.desc("score"), F.asc(id_col)], k)


def _compared(told, k: int, min_score: float | None, by_cell: bool, grouped: bool, names: list[str]):
    """Batches (id, vector, cell, group) to a batch's first k of each query, or of each of its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, cells = told.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            order = np.lexsort((np.arange(b.num_rows), pc.rank(b.column(0), "ascending").to_numpy()))  # ties by id
            parts = [(order, np.arange(len(matrix)))]
            if by_cell:
                cell = np.array(b.column(2).to_pylist())[order]
                parts = [(order[cell == c], np.array(cells[c])) for c in np.unique(cell) if c in cells]
            if grouped:
                group = b.columns[-1].dictionary_encode().indices.fill_null(-1).to_numpy()
                parts = [(rows[group[rows] == g], wanted) for rows, wanted in parts for g in np.unique(group[rows])]
            for rows, wanted in parts:
                for a in range(0, len(wanted), AT_A_TIME):
                    qs = wanted[a : a + AT_A_TIME]
                    s = np.rint(matrix[qs] @ x[rows].T * 1e6).astype(np.int64)
                    own = s * len(rows) + np.arange(len(rows))[::-1]  # score, then the place by id: no two are equal
                    best = own >= np.partition(own, len(rows) - k, axis=1)[:, [-k]] if len(rows) > k else np.ones(s.shape, bool)
                    if min_score is not None:
                        best &= s / 1e6 >= min_score
                    qi, di = np.nonzero(best)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(qs[qi])), b.column(0).take(at := pa.array(rows[di])), pa.array(s[qi, di] / 1e6), *([b.columns[-1].take(at)] if grouped else [])], names)

    return run


@dataclass
class CellIndex:
    """A stored index: its folder, the centres, the number of cells that a search probes unless told otherwise, the schema of its rows."""

    path: str
    centres: np.ndarray
    probes: int
    schema: T.StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/cells")


def _centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means over a sample."""
    c = x[np.random.default_rng(5).choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        some = np.bincount(near, minlength=cells) > 0
        c = np.where(some[:, None], total, c)
        c = c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-300)
    return c


def _probes(x: np.ndarray, centres: np.ndarray, recall: float, k: int = 10) -> int:
    """Cells that have to be probed so that `recall` of the sample's own k nearest neighbours is found."""
    own = (x @ centres.T).argmax(1)
    rank = []
    for q in x[:: max(1, len(x) // MEASURED)]:
        near = np.argsort(-(x @ q))[1 : k + 1]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(-(centres @ q))] = np.arange(len(centres))
        rank.append(place[own[near]])
    rank = np.sort(np.concatenate(rank)) if rank else np.zeros(1, np.int64)
    return int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1


def build(vectors: DataFrame, path: str, id_col: str, vector: str, cells: int | None = None, recall: float = 0.97) -> CellIndex:
    """Writes the index of all vectors of the most frequent width to `path`. By default about as many cells as the square root of the vectors."""
    spark = vectors.sparkSession
    widths = vectors.groupBy(F.size(vector).alias("w")).agg(F.count(F.lit(1)).alias("n")).where("w > 0").orderBy(F.desc("n"), "w").limit(1).collect()
    width, n = (widths[0].w, widths[0].n) if widths else (0, 0)
    v = vectors.where(F.size(vector) == width).select(F.col(id_col), F.col(vector))
    low = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, SAMPLE / max(1, n))))
    x = _matrix(v.where(low).select(vector).limit(2 * SAMPLE).toArrow().column(0).combine_chunks()) if n else np.zeros((0, 1))  # the hash bounds it, the limit holds for repeated ids
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, len(x)))
    centres = _centres(x, cells) if len(x) else np.zeros((1, max(1, width)))
    told = spark.sparkContext.broadcast(centres)
    schema = T.StructType([vectors.schema[id_col], vectors.schema[vector], T.StructField("cell", T.IntegerType())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((_matrix(b.column(1)) @ told.value.T).argmax(1).astype(np.int32))], [f.name for f in schema])

    v.mapInArrow(dealt, schema).repartition("cell").sortWithinPartitions("cell").write.partitionBy("cell").option("compression", "zstd").parquet(f"{path}/cells")
    facts = {"centres": centres.tolist(), "probes": _probes(x, centres, recall) if len(x) else 1, "schema": schema.json()}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/facts")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> CellIndex:
    """The index at `path`; ValueError if there is none."""
    if read_file(spark, f"{path}/facts/_SUCCESS") is None:
        raise ValueError(f"no index at {path}")
    facts = json.loads(spark.read.text(f"{path}/facts").first().value)
    return CellIndex(path, np.array(facts["centres"]), facts["probes"], T.StructType.fromJson(json.loads(facts["schema"])))


def search(spark: SparkSession, index: CellIndex, queries: DataFrame, id_col: str, vector: str, query_id: str, query_vector: str, k: int = 10, probes: int | None = None) -> tuple[DataFrame, float]:
    """(query, id, score, rank) from each query's nearest cells, and the share of the cells' folders that is read."""
    if _width(queries, query_vector) not in (0, index.centres.shape[1]):
        raise ValueError("queries are of another width than the index")
    probes, told = min(probes or index.probes, len(index.centres)), spark.sparkContext.broadcast(index.centres)
    schema = T.StructType([queries.schema[query_id], T.StructField("cell", T.IntegerType())])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.argsort(-(_matrix(b.column(1)) @ told.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), probes))), pa.array(near.ravel())], [f.name for f in schema])

    pairs = queries.select(query_id, query_vector).mapInArrow(chosen, schema)
    used = sorted(r.cell for r in pairs.select("cell").distinct().collect())  # at most MOST_CELLS
    rows = index.rows(spark).where(F.col("cell").isin(used))
    return nearest(rows, queries, id_col, vector, query_id, query_vector, k, allowed=pairs), len(used) / len(index.centres)
