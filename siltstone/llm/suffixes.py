"""Suffix-array dedup: repeated byte strings of a threshold length, found by a depth-limited radix sort of suffixes.

A position's suffix is ordered only through `LENGTH` bytes (its window), by digits of eight bytes, the most
significant one first; groups that are equal through all digits are exactly the repeated windows, and every byte that
goes was compared with the bytes of an earlier document. Anchors keep what can't repeat away from the sort: a window's
anchor is the 20-byte string in it with the smallest hash, which equal windows have at the same place; so one entry per
anchor, about one for 16 positions, stands for the run of windows that it rules. Hashes only pick and route.

1. In a block of documents, runs with equal hashes whose bytes are equal are settled at once, so that a passage in most
   documents costs an entry for each block, not for each document.
2. Entries are dealt by anchor to fragments of the hash range. An anchor in one document only is done with.
3. What is left is spelled out and dealt by anchor again. Radix passes over whole runs, digit by digit, settle the runs
   whose bytes are equal; then radix passes over the windows of the others settle what agrees in part, at edits and
   at the ends of shared passages.

An anchor that a task meets in more than `HOT_BLOCKS` blocks, or that has more than `HOT_GROUP` entries, is hot: its
runs and windows are dealt by their own bytes, and smallest documents are found by sums that Spark begins before it
shuffles, so that no task gets all of a passage that most documents share. Texts are shuffled twice, compressed, to
meet their open entries and then their spans; both joins are the same at every size. Later copies of a whole text are
found beforehand by SHA-256, and covered as a whole.

A byte goes if a window that covers it also starts in a document with a smaller doc_id. Defined results: a null text
has no bytes; rows with a null doc_id are kept as they are and are no source for others; rows that repeat a doc_id
don't remove one another, and what goes from one of them stays in another with other text (a tag, 0 where a doc_id has
one text and a hash of the text elsewhere, goes with the doc_id); texts below `LENGTH` bytes are never touched; a very
long text is cut into pieces of `PIECE` bytes, which overlap; an empty table gives no rows; other columns, whatever
their names, are ignored by `repeats_report` and kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.shared import BYTE_CODE, U, blobs, dealt, fresh, grouped, joined, materialize, mix, n_fragments, one_by_one, powers, shuffles, small, texts

LENGTH, GRAM, PIECE = 50, 20, 4 << 20
#: Bytes of texts whose anchors are found at a time: their numbers stay in a core's cache.
PART = 1 << 17
HOT_BLOCKS, HOT_GROUP = 32, 200_000


def _eights(x: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each position as a number; positions near the end read zeros."""
    a = np.zeros(len(x) + 8, np.uint64)
    a[: len(x)] = x
    for step in (1, 2, 4):
        a[:-step] |= a[step:] << U(8 * step)
    return a[: len(x)]


def _slide(a: np.ndarray, width: int, fn: np.ufunc, left: bool) -> np.ndarray:
    """fn over [i, i+width) for each i, or over (i-width, i] if left; past the ends, only what is there."""
    a, have = a.copy(), 1
    while have < width:
        step = min(have, width - have)
        if left:
            a[step:] = fn(a[step:], a[:-step])
        else:
            a[:-step] = fn(a[:-step], a[step:])
        have += step
    return a


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor in a block of texts: anchor hash, hash of the covered bytes, text, first start, number of windows."""
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return empty
    pw, inv = powers(len(data) + 1)
    h, p = np.zeros(len(data), np.uint64), np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[data] * pw[: len(data)], out=p[1:])
        h[: len(data) - GRAM + 1] = mix((p[GRAM:] - p[:-GRAM]) * inv[: len(data) - GRAM + 1]) | U(1)
    valid = np.zeros(len(data), bool)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    valid[: len(data) - length + 1] = row[: len(data) - length + 1] == row[length - 1 :]
    span = length - GRAM + 1
    low = _slide(h, span, np.minimum, False)
    low[~valid] = 0
    is_anchor = _slide(low, span, np.maximum, True) == h
    at = np.flatnonzero(is_anchor)
    starts = np.flatnonzero(valid)
    if not len(starts):
        return empty
    before = np.cumsum(is_anchor) - is_anchor
    k = before[starts]
    off_by = np.flatnonzero(h[at[k]] != low[starts])
    while len(off_by):
        k[off_by] += 1
        off_by = off_by[h[at[k[off_by]]] != low[starts[off_by]]]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff([*first, len(k)])
    q, a = at[k[first]], starts[first]
    with np.errstate(over="ignore"):
        u = mix((p[a + n + length - 1] - p[a]) * inv[a] + mix((q - a).astype(np.uint64) * U(64) + n.astype(np.uint64)))
    return h[q], u, row[a], a - off[row[a]], n


def _anchors_by_parts(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """`anchors` of a block, some texts at a time."""
    cuts = [0]
    while cuts[-1] < len(off) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(off, off[cuts[-1]] + PART, side="right")) - 1))
    found = [anchors(data[off[a] : off[z]], off[a : z + 1] - off[a], length) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    m, u, row, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
    return m, u, row + np.repeat(cuts[:-1], [len(x[0]) for x in found]), at, n


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching [start, end) of each document merged: documents, rows of (start, end); sorted by both."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, np.zeros((0, 2), np.int32)
    shift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 33  # so that the running maximum starts anew
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], np.column_stack([start[at], reach[last] - shift[last]]).astype(np.int32)


def _by_row(row: np.ndarray, values: np.ndarray, ids: np.ndarray, tags: np.ndarray, kind: int | None = None) -> pa.RecordBatch:
    """A row (doc_id, tag, kind, body) for each index into `ids` and `tags`, of values that are sorted by it."""
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    values = values.reshape(len(row), -1) if len(row) else values.reshape(0, 1)
    cols = [pa.array(ids[row[start]], pa.int64()), pa.array(tags[row[start]], pa.int64()), blobs(values.reshape(-1), start * values.shape[1])]
    if kind is None:
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "tag", "body"])
    return pa.RecordBatch.from_arrays([*cols[:2], pa.array(np.full(len(start), kind, np.int32)), cols[2]], ["doc_id", "tag", "kind", "body"])


def _numbered(doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An index for each (doc, tag), in their order, and what it stands for."""
    order = np.lexsort((tag, doc))
    d, t = doc[order], tag[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    index = np.empty(len(d), np.int64)
    index[order] = np.cumsum(new) - 1
    return index, d[new], t[new]


def _same(e: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes at a and at b are equal; e: `_eights` of the bytes."""
    ok = np.ones(len(a), bool)
    last = len(e) - 1
    for k in range(0, int(size.max(initial=0)), 8):
        x = e[np.minimum(a + k, last)] ^ e[np.minimum(b + k, last)]
        ok &= (x & _low_bytes(size - k)) == 0
    return ok


def _low_bytes(n: np.ndarray) -> np.ndarray:
    """Masks for the first n bytes of a number, of at most eight."""
    n = np.clip(n, 0, 8).astype(np.uint64)
    return np.where(n == 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (U(8) * n)) - U(1))


def _blocks(column: pa.Array, length: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Blocks of texts, and overlapping pieces of long ones: first row, end row, bytes, offsets, place of the piece."""
    for a, z, data, off in texts(column):
        if z == a + 1 and len(data) > 2 * size:
            for begin in range(0, len(data) - length + 1, size):
                piece = data[begin : begin + size + length - 1]
                yield a, z, piece, np.array([0, len(piece)]), begin
        else:
            yield a, z, data, off, 0


OPEN = np.dtype([("m", "<u8"), ("at", "<u4"), ("n", "u1")])
#: Rows between the steps: entries of documents without and with tags, spans, anchors that are hot, entries that are open, open entries of hot anchors.
ENTRY, SPANS, TAGGED, MARKS, OPENED, HOT = range(6)


def _entries(fragments: int, length: int):
    """Texts to rows (fragment, kind, ids, body), packed. Spans and hot entries have the document's id and tag in `ids`."""

    def of_docs(row: np.ndarray, values: np.ndarray, ids: np.ndarray, tags: np.ndarray, kind: int) -> pa.RecordBatch:
        rows = _by_row(row, values, ids, tags)
        who = np.column_stack([rows.column(k).to_numpy() for k in (0, 1)])
        return pa.RecordBatch.from_arrays([pa.array(who[:, 0] % fragments), pa.array(np.full(rows.num_rows, kind, np.int32)), blobs(who.reshape(-1), 2 * np.arange(rows.num_rows)), rows.column(2)], ["fragment", "kind", "ids", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = np.zeros(1 << 22, np.uint8)  # of this task, in how many an anchor with that part of the hash occurred
        hot = np.zeros(0, np.uint64)
        for b in batches:
            ids_all, tags_all = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for a, z, data, off, begin in _blocks(b.column(1), length, PIECE):
                ids, tags = ids_all[a:z], tags_all[a:z]
                m, u, row, at, n = _anchors_by_parts(data, off, length)
                if not len(m):
                    continue
                order = np.lexsort((ids[row], u, m))
                m, u, row, at, n = (x[order] for x in (m, u, row, at, n))
                doc, place = ids[row], off[row] + at
                new_m = np.concatenate([[True], m[1:] != m[:-1]])
                new = new_m | np.concatenate([[True], u[1:] != u[:-1]])
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = np.flatnonzero(doc > doc[lead])
                if len(later):
                    later = later[(n[later] == n[lead[later]]) & _same(_eights(data), place[later], place[lead[later]], n[later] + length - 1)]
                known = np.zeros(len(m), bool)
                known[later] = True
                at = at + begin
                if known.any():
                    yield of_docs(*_spans(row[known], at[known], at[known] + n[known] + length - 1), ids, tags, SPANS)
                m, row, at, n = (x[~known] for x in (m, row, at, n))
                m = _routed(m, fragments)
                each = np.unique(m)
                slot = (mix(each) & U(len(blocks) - 1)).astype(np.int64)
                blocks[slot] += blocks[slot] < 255
                often = each[blocks[slot] > HOT_BLOCKS]
                if len(often):
                    fresh_ = often[~np.isin(often, hot)]
                    if len(fresh_):  # the fragment is told, once for each task
                        hot = np.union1d(hot, fresh_)
                        f = (fresh_ >> U(32)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.full(len(f), MARKS, np.int32)), pa.array([b""] * len(f), pa.binary()), blobs(fresh_, np.arange(len(f)))], ["fragment", "kind", "ids", "body"])
                    is_hot = np.isin(m, often)
                    pick = np.flatnonzero(is_hot)[np.argsort(row[is_hot], kind="stable")]
                    yield of_docs(row[pick], _opened(m[pick], at[pick], n[pick]), ids, tags, HOT)
                    m, row, at, n = (x[~is_hot] for x in (m, row, at, n))
                if not len(m):
                    continue
                frag = m >> U(32)
                order = np.argsort(frag, kind="stable")
                frag = frag[order]
                start = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
                bodies, id_parts, kinds = [], [], []
                for i, j in zip(start, [*start[1:], len(frag)], strict=True):
                    pick = order[i:j]
                    docs, ordinal = np.unique(row[pick], return_inverse=True)
                    bodies.append(b"".join([m[pick].astype(np.uint32).tobytes(), ordinal.astype(np.uint16 if len(docs) < 65536 else np.uint32).tobytes(), at[pick].astype(np.uint32).tobytes(), n[pick].astype(np.uint8).tobytes()]))
                    tagged = tags[docs].any()
                    kinds.append(TAGGED if tagged else ENTRY)
                    id_parts.append(ids[docs].astype(np.int64).tobytes() + (tags[docs].astype(np.int64).tobytes() if tagged else b""))
                yield pa.RecordBatch.from_arrays([pa.array(frag[start].astype(np.int64)), pa.array(kinds, pa.int32()), pa.array(id_parts, pa.binary()), pa.array(bodies, pa.binary())], ["fragment", "kind", "ids", "body"])

    return run


def _routed(m: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of an anchor's hash, and 32 bits of it that tell anchors of a fragment apart. What agrees by chance is only compared in vain."""
    m = m >> U(16)
    return (m % U(fragments)) << U(32) | (m // U(fragments)) & U(0xFFFFFFFF)


def _opened(m: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = np.zeros(len(m), OPEN)
    x["m"], x["at"], x["n"] = m, at, n
    return x


def _unpack(fragment: int, kind: np.ndarray, ids: pa.ChunkedArray, body: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """Routed anchor, index of the document, first start and number of windows of each entry; ids and tags of the documents."""
    parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
    begin = 0
    for tagged, i, x in zip(kind == TAGGED, ids.to_pylist(), body.to_pylist(), strict=True):
        docs = np.frombuffer(i, np.int64)
        docs, tags = np.split(docs, 2) if tagged else (docs, np.zeros(len(docs), np.int64))
        wide = len(docs) >= 65536
        n, w = len(x) // (13 if wide else 11), 4 if wide else 2
        parts[0].append(U(fragment << 32) | np.frombuffer(x, np.uint32, n).astype(np.uint64))
        parts[1].append(np.frombuffer(x, np.uint32 if wide else np.uint16, n, 4 * n).astype(np.int64) + begin)
        parts[2].append(np.frombuffer(x, np.uint32, n, (4 + w) * n).astype(np.int64))
        parts[3].append(np.frombuffer(x, np.uint8, n, (8 + w) * n).astype(np.int64))
        parts[4].append(docs)
        parts[5].append(tags)
        begin += len(docs)
    return tuple(np.concatenate(p) for p in parts)


def _settle(hot_group: int):
    """In each fragment: rows (doc_id, tag, kind, body) of spans, and of the entries whose anchors occur in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, t in one_by_one(batches):
            kind = t.column("kind").to_numpy()
            passed = t.filter(pa.array((kind == SPANS) | (kind == HOT)))
            if passed.num_rows:
                who = joined(passed.column("ids"), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(who[:, 0].copy()), pa.array(who[:, 1].copy()), passed.column("kind").combine_chunks(), passed.column("body").combine_chunks()], ["doc_id", "tag", "kind", "body"])
            marks = np.unique(joined(t.filter(pa.array(kind == MARKS)).column("body"), np.uint64))
            packed = (kind == ENTRY) | (kind == TAGGED)
            t = t.filter(pa.array(packed))
            if not t.num_rows:
                continue
            m, row, at, n, ids, tags = _unpack(int(fragment), kind[packed], t.column("ids"), t.column("body"))
            order = np.argsort(m, kind="stable")
            m, row, at, n = (x[order] for x in (m, row, at, n))
            doc = ids[row]
            new = np.concatenate([[True], m[1:] != m[:-1]])
            start, group = np.flatnonzero(new), np.cumsum(new) - 1
            hot = np.isin(m[start], marks) | (np.diff([*start, len(m)]) > hot_group)
            several = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
            for kind_, which in ((OPENED, several & ~hot), (HOT, hot)):
                pick = np.flatnonzero(which[group])
                if len(pick):
                    pick = pick[np.argsort(row[pick], kind="stable")]
                    yield _by_row(row[pick], _opened(m[pick], at[pick], n[pick]), ids, tags, kind_)

    return run


def _raw(text: str | bytes | None) -> bytes | None:
    """A text's bytes, whether it comes as it is or compressed by `_compressed`."""
    if text is None or isinstance(text, str):
        return None if text is None else text.encode()
    size = int.from_bytes(text[:4], "little")
    return pa.decompress(text[4:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _compressed(docs: DataFrame) -> DataFrame:
    """`docs` with `text` compressed, for a shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = (x if x is None or not x else len(x).to_bytes(4, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in b.column(at).cast(pa.binary()).to_pylist())
            cols = list(b.columns)
            cols[at] = pa.array([bytes(4) if x == b"" else x for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields]))


def _spell(length: int):
    """Open entries with their texts to rows (fragment, m, doc_id, tag, at, body): the covered bytes of each. A fifth column has entries of hot anchors, whose fragment is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, tag, text, *each in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = _raw(text)
                for hot, packed in enumerate(each):
                    x = np.frombuffer(b"".join(packed), OPEN)
                    for k in range(0, len(x), 1 << 16):
                        y = x[k : k + (1 << 16)]
                        body = [raw[a : a + n + length - 1] for a, n in zip(y["at"].tolist(), y["n"].tolist(), strict=True)]
                        m = y["m"].astype(np.uint64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(y), -1) if hot else (m >> U(32)).astype(np.int64)), pa.array(m.astype(np.int64)),
                            pa.array(np.full(len(y), i, np.int64)), pa.array(np.full(len(y), tag, np.int64)), pa.array(y["at"].astype(np.int64)), pa.array(body, pa.binary()),
                        ], ["fragment", "m", "doc_id", "tag", "at", "body"])

    return run


SPELLED = "fragment long, m long, doc_id long, tag long, at long, body binary"


def _groups(group: np.ndarray, digit: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A radix pass: the order by (group, digit), of what is in a group of several documents; and the new group of each."""
    order = np.lexsort((digit, group))
    g, x, d = group[order], digit[order], d[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])]) if len(g) else np.zeros(0, bool)
    start, ids = np.flatnonzero(new), np.cumsum(new) - 1
    if not len(start):
        return order, ids
    keep = (np.minimum.reduceat(d, start) < np.maximum.reduceat(d, start))[ids]
    return order[keep], ids[keep]


def _later(group: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of sorted groups, the members whose document isn't the smallest of their group."""
    if not len(group):
        return np.zeros(0, bool)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    return d > np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]


#: Windows that are sorted at a time.
WINDOWS = 1 << 19


def _unaligned(column: pa.ChunkedArray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and size of each value among the bytes of all, and the eight bytes at each place as a number, without a copy for each."""
    column = pa.concat_arrays(column.chunks)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(off[-1] - off[0] + length + 8, np.uint8)
    data[: off[-1] - off[0]] = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return off[:-1] - off[0], np.diff(off), np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))


def _equal_windows(entries: np.ndarray, group: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, digits: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, place in it) of the windows that also start in an earlier document, of entries sorted by their anchor's group. Many are taken in parts, by their first digit."""
    n = size[entries] - length + 1
    entry, group = np.repeat(entries, n), np.repeat(group, n)
    inner = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    parts = -(-len(entry) // (2 * WINDOWS))
    part = mix(digits[begin[entry] + inner]) % U(parts) if parts > 1 else None
    for k in range(parts):
        e, i, g = (entry, inner, group) if part is None else (x[part == U(k)] for x in (entry, inner, group))
        for depth in range(0, length, 8):
            digit = digits[begin[e] + i + depth]
            if depth + 8 > length:
                digit = digit & U((1 << (8 * (length - depth))) - 1)
            order, g = _groups(g, digit, doc[e])
            e, i = e[order], i[order]
            if not len(e):
                break
        hit = _later(g, doc[e])
        if hit.any():
            yield e[hit], i[hit]


def _radix(length: int):
    """In each fragment the radix passes over runs and then over windows; rows (doc_id, tag, kind, body) of spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in one_by_one(batches):
            m, doc, at = (t.column(c).to_numpy() for c in ("m", "doc_id", "at"))
            row, docs, tags = _numbered(doc, t.column("tag").to_numpy())
            begin, size, digits = _unaligned(t.column("body"), length)
            # Runs: equal ones have the same anchor and length, and are compared through their whole length.
            left, group = np.arange(len(m)), m.astype(np.uint64) * U(256) + size.astype(np.uint64)  # a fragment's anchors differ in the low 32 bits
            covered = np.zeros(len(m), bool)
            for depth in range(0, int(size.max()), 8):
                digit = digits[begin[left] + depth] & _low_bytes(size[left] - depth)
                order, group = _groups(group, digit, doc[left])
                left = left[order]
            covered[left[_later(group, doc[left])]] = True
            if covered.any():
                c = np.flatnonzero(covered)
                yield _by_row(*_spans(row[c], at[c], at[c] + size[c]), docs, tags, SPANS)
            # Windows of the other runs, some anchors at a time.
            left = np.flatnonzero(~covered)
            order, group = _groups(m[left], np.zeros(len(left), np.int64), doc[left])
            left = left[order]
            count = np.cumsum(size[left] - length + 1)
            ends = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]])) + 1 if len(left) else np.zeros(0, np.int64)
            a = 0
            while a < len(left):
                z = ends[max(np.searchsorted(ends, a, side="right"), np.searchsorted(count[ends - 1], (count[a - 1] if a else 0) + WINDOWS, side="right") - 1)]
                for entry, start in _equal_windows(left[a:z], group[a:z], begin, size, doc, digits, length):
                    yield _by_row(*_spans(row[entry], at[entry] + start, at[entry] + start + length), docs, tags, SPANS)
                a = z

    return run


def _packed_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tag, start, end) to rows (doc_id, tag, kind, body)."""
    for b in batches:
        doc, tag, start, end = (c.to_numpy() for c in b.columns)
        row, docs, tags = _numbered(doc, tag)
        if len(row):
            yield _by_row(*_spans(row, start, end), docs, tags, SPANS)


def _hot_spans(spelled: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, tag, kind, body) of spans in the runs of hot anchors: grouped by their bytes, whole runs first and then windows."""
    runs = materialize(spelled.select("doc_id", "tag", "at", "body"), "hot-runs")
    first = materialize(runs.groupBy("body").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("body", "first"), "hot-first")
    marked = runs.join(small(first), "body", "left")
    whole = marked.where("doc_id > first").select("doc_id", "tag", F.col("at").alias("start"), (F.col("at") + F.octet_length("body")).alias("end"))
    rest = marked.where("first IS NULL OR doc_id = first").select("doc_id", "tag", "at", "body")
    windows = rest.select("doc_id", "tag", "at", "body", F.explode(F.sequence(F.lit(0), F.octet_length("body") - length)).alias("i"))
    windows = materialize(windows.select("doc_id", "tag", (F.col("at") + F.col("i")).alias("start"), F.substring("body", F.col("i") + 1, F.lit(length)).alias("w")), "hot-windows")
    least = windows.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w", "first")
    inside = windows.join(small(materialize(least, "hot-least")), "w").where("doc_id > first").select("doc_id", "tag", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(inside).mapInArrow(_packed_spans, "doc_id long, tag long, kind int, body binary")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tag, body) sorted by document to one row for each document and tag."""
    for t in grouped(batches, rows=1 << 14):
        lens = np.array([len(x) // 8 for x in t.column("body").to_pylist()])
        spans = joined(t.column("body"), np.int32).reshape(-1, 2)
        row, ids, tags = _numbered(t.column("doc_id").to_numpy(), t.column("tag").to_numpy())
        row, merged = _spans(np.repeat(row, lens), spans[:, 0], spans[:, 1])
        yield _by_row(row, merged, ids, tags)


def _with_body(docs: DataFrame, found: DataFrame, how: str, key: tuple[str, ...]) -> DataFrame:
    """`docs`, their texts compressed, joined with narrow rows of bytes that fit a task's memory many times."""
    return _compressed(docs).join(found.hint("shuffle_hash"), list(key), how)


def _tagged(docs: DataFrame, twice: DataFrame | None, key: str = "doc_id", name: str = "_tag") -> DataFrame:
    """`docs` with a tag: a hash of the text where the document's id is in `twice`, else 0."""
    if twice is None:
        return docs.withColumn(name, F.lit(0).cast("long"))
    (mark,) = fresh(docs, "_twice")
    known = small(twice.select(F.col("doc_id").alias(mark)))
    return docs.join(known, docs[key] == F.col(mark), "left").withColumn(name, F.when(F.col(mark).isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop(mark)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame | None]:
    """(_id, _tag, body): packed int32 pairs [start, end) of what is to be removed, for the documents where anything is; and the doc_ids that have several texts, if any do. Materialized."""
    slim = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = slim.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
    marks = materialize(marks, "marks")
    again = marks.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialize(again.select("doc_id", F.expr("a <> b").alias("several")), "again")
    twice = again.where("several").select("doc_id")
    twice = twice if twice.limit(1).count() else None
    marks = marks.withColumn("tag", F.lit(0).cast("long")) if twice is None else marks.join(small(twice.withColumn("_several", F.lit(True))), "doc_id", "left").withColumn("tag", F.when(F.col("_several"), F.col("h")).otherwise(F.lit(0).cast("long")))
    firsts = marks.groupBy("k").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = materialize(marks.join(firsts, "k").where("doc_id > first").select("doc_id", "tag", "size").distinct(), "copies")
    fragments = max(2 * shuffles(docs), n_fragments(docs, 6 << 20))
    # A doc_id may repeat with other texts; what goes from one of them stays in the others.
    rest = _tagged(slim, twice).withColumnRenamed("_tag", "tag").join(small(copies), ["doc_id", "tag"], "left_anti").select("doc_id", "text", "tag")
    if again.limit(1).count():  # one of the rows that agree in id and text is enough
        rest = rest.dropDuplicates(["doc_id", "tag"])
    entries = rest.mapInArrow(_entries(fragments, length), "fragment long, kind int, ids binary, body binary")
    settled = materialize(dealt(entries, "fragment", shuffles(docs)).mapInArrow(_settle(HOT_GROUP), "doc_id long, tag long, kind int, body binary"), "settled")

    # Texts meet their open entries once, those of hot anchors with the others.
    of_kind = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("body")))
    found = settled.where(F.col("kind").isin(OPENED, HOT)).groupBy("doc_id", "tag").agg(of_kind(OPENED).alias("body"), of_kind(HOT).alias("hot"))
    spelled = _with_body(rest, found, "inner", ("doc_id", "tag")).select("doc_id", "tag", "text", "body", "hot").mapInArrow(_spell(length), SPELLED)
    hot = settled.where(F.col("kind") == HOT).limit(1).count() > 0
    if hot:
        spelled = materialize(spelled, "spelled")
    rows = dealt(spelled.where("fragment >= 0"), "fragment", shuffles(docs)).mapInArrow(_radix(length), "doc_id long, tag long, kind int, body binary")
    if hot:
        rows = rows.unionByName(_hot_spans(spelled.where("fragment < 0"), length))
    whole = copies.select("doc_id", "tag", F.lit(SPANS).alias("kind"), F.unhex(F.concat(F.lit("00000000"), *[F.lpad(F.hex(F.shiftright(F.col("size"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])).alias("body"))
    spans = settled.where(F.col("kind") == SPANS).unionByName(rows).unionByName(whole)
    merged = dealt(spans.select("doc_id", "tag", "body"), "doc_id").mapInArrow(_merged, "doc_id long, tag long, body binary")
    return materialize(merged, "spans").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("body")), twice


def _cut(raw: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed, runs removed."""
    if not spans:
        return raw, 0, 0
    left, end, gone, runs = [], 0, 0, 0
    for a, z in np.frombuffer(spans, np.int32).reshape(-1, 2).tolist():
        z = min(z, len(raw))
        if a < z:
            left.append(raw[end:a])
            gone, runs, end = gone + z - a, runs + 1, z
    return b"".join([*left, raw[end:]]), gone, runs


def repeats_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of `docs`."""
    spans, twice = repeated_spans(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = _raw(text) or b""
                left, gone, runs = _cut(raw, s if len(raw) >= length else None)
                rows.append((len(raw), gone, runs, hashlib.sha256(left).hexdigest()))
            n, g, r, h = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(g, pa.int64()), pa.array(r, pa.int64()), pa.array(h, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    both = _with_body(_tagged(docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("_id")), twice, "_id"), spans, "left", ("_id", "_tag")).select("doc_id", "text", "body")
    return both.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with the repeated bytes cut out of `text`; a character of which a part went goes as a whole. Columns may have any names."""
    spans, twice = repeated_spans(docs, length)
    i, tag, body = fresh(docs, "_id", "_tag", "_body")
    spans = spans.select(F.col("_id").alias(i), F.col("_tag").alias(tag), F.col("body").alias(body))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                raw = _raw(text)
                out.append(None if raw is None else _cut(raw, s if len(raw) >= length else None)[0].decode("utf8", "ignore"))
            cols = list(b.columns[:-1])
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    both = _tagged(docs.withColumn(i, F.col("doc_id").cast("long")), twice, i, tag)
    both = _with_body(both, spans, "left", (i, tag))
    return both.select(*docs.columns, body).mapInArrow(run, docs.schema)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) p FROM d)),
m AS (SELECT k, min(doc_id) first_doc FROM w GROUP BY k),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) p FROM w JOIN m USING (k) WHERE doc_id > first_doc),
r AS (SELECT doc_id, count(*) n, count(*) FILTER (WHERE before IS NULL OR before < p - 1) s FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) before FROM x) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) kept FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) p FROM d) a ANTI JOIN x USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) n_bytes, CAST(coalesce(n, 0) AS BIGINT) n_removed, CAST(coalesce(s, 0) AS BIGINT) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
