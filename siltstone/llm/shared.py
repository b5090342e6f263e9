"""Helpers shared by the operators: size checks, and word and byte arithmetic on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.steps import materialize, work_dir  # noqa: F401


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of `df`, for the number of fragments; files are not read for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def n_fragments(df: DataFrame, per: int = 2 << 20) -> int:
    """Fragments for work over `df`, so that each stays within a task's memory however large the input is."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(parts, min(input_bytes(df) // per + 1, 1 << 22)))


#: Id lists are broadcast up to this many rows (about 16 bytes each).
BROADCAST_IDS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """`df`, which must be materialized, with a broadcast hint if it has at most `rows` rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def lowest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The `n` rows with the lowest hashes of `key`. A bound that the count implies leaves little more than them before anything is sorted."""
    total = df.count()
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > n:
        df = df.where(h < F.lit(int((1 << 40) * min(1.0, (n + 8 * n**0.5 + 16) / total))))
    return df.orderBy(h, key).limit(n)


def one_text(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (by, text, ...) that agree in `by`, the one whose text has the lowest hash: as many rows as `by` has values, whatever they repeat."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.xxhash64("text")).alias("_x")).select(*by, *[F.col(f"_x.{c}") for c in rest])


U = np.uint64
#: Fixed random constants of the hashes; results don't depend on their values.
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
RADIX = U(int(_RNG.integers(1 << 61, 1 << 63)) | 5)
LANE = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def trim() -> None:
    """Gives memory that is free back to the system: a worker that is reused would hold the most it ever needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def texts(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about `most` bytes (one row at least): (first row, end row, bytes, offsets from 0).

    A null counts as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    trim()


_POWERS = _INVERSES = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and its inverse modulo 2**64 for i below n."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, 1 << 21)
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, RADIX, np.uint64)]), dtype=np.uint64)
            inv = U(pow(int(RADIX), -1, 1 << 64))
            _INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inv, np.uint64)]), dtype=np.uint64)
    return _POWERS, _INVERSES


def words_of(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: starts, ends, and for each row the index of its first word (n+1 values). Words don't cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~gap[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    at = off[:-1][off[:-1] < off[1:]]
    start[at] = solid[at]
    last = off[1:][off[:-1] < off[1:]] - 1
    end[last] = solid[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


#: A longer text is hashed stretch by stretch, so that its numbers need not all be held at once.
STRETCH = 4 << 20


def word_hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word low[s:e], which depends on its bytes only; the words are in order."""
    if len(low) > STRETCH and len(s) > 1:
        out, a = np.empty(len(s), np.uint64), 0
        while a < len(s):
            z = max(a + 1, int(np.searchsorted(s, s[a] + STRETCH)))
            begin = s[a]
            out[a:z] = word_hashes(low[begin : e[z - 1]], s[a:z] - begin, e[a:z] - begin) if z - a < len(s) else _word_hashes(low, s, e)
            a = z
        return out
    return _word_hashes(low, s, e)


def _word_hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    pw, inv = powers(len(low) + 1)
    with np.errstate(over="ignore"):
        p = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(BYTE_CODE[low] * pw[: len(low)], out=p[1:])
        return mix((p[e] - p[s]) * inv[s] + (e - s).astype(np.uint64))


def grouped(batches: Iterator[pa.RecordBatch], key: int = 0, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables cut where the key column, by which the batches are sorted, changes; whole groups, several to a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        if held and k[0] == held[-1].column(key)[-1]:
            cut = 0
            changed = np.flatnonzero(k.to_numpy(zero_copy_only=False) != k[0].as_py())
            cut = int(changed[0]) if len(changed) else b.num_rows
            held.append(b.slice(0, cut))
            b = b.slice(cut)
            if not b.num_rows:
                continue
        if held and sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def one_by_one(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[object, pa.Table]]:
    """(key, its rows) for batches sorted by an integer key without nulls."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z == a:
                continue
            if held and k[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = k[a]
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)
    trim()


def joined(column: pa.ChunkedArray | pa.Array, dtype: np.dtype | type) -> np.ndarray:
    """A binary column's values, one after another, as numbers of `dtype`."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def blobs(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """Binary values: values[start[i]:start[i+1]], the last to the end."""
    raw = np.ascontiguousarray(values)
    ends = np.concatenate([start, [len(raw)]]) * raw.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def dealt(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """`df` with the rows of each value of `column` together and in order of it; without `parts`, Spark joins small partitions."""
    return (df.repartition(parts, column) if parts else df.repartition(column)).sortWithinPartitions(column)


def shuffles(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for steps whose tasks are heavy however few bytes they read."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to add to `df` that none of its columns has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
