"""N-gram Jaccard join by vertical partitioning.

A document's set holds its distinct shingles of five words. Two documents link when their sets' Jaccard similarity
is at least the threshold. The global order of shingles is cut into fragments; whatever is counted about shingles is
counted for each fragment by itself and then summed: first the shingles that a document shares with any other, at
last the partial overlaps of each pair.

1. Equal sets form a class, which counts as one document from there on.
2. A link needs most of any part of a set to be shared. Of each set the head of the hash order goes to its fragments,
   which tell what also occurs elsewhere; sets that share too little of their head can't link and are done with.
   Within a block of documents a shingle is sent once, however many of them hold it.
3. For what is left, the fragments count in how many sets a shingle occurs. In rare-first order the first shingle that two
   linked sets share stands in the first fifth of the larger one and, since as much must follow it, in the first ninth
   of the smaller one (a prefix filter with positions: the set holds it strongly there). Shingles that some set holds
   strongly connect the sets that have them among their first ones to a cluster. So pages that share a template link
   to nobody by it, as long as what is their own fills the first ninth.
4. Sets are dealt to cells of about `BLOCK` sets: small clusters share a cell, larger ones have several. In a cluster
   of more than `SPAN` cells, the cells hold sets with the same leading shingle (that with the smallest hash among
   those held strongly, else among the first ones), and two cells with different ones meet only if one of them holds
   strongly what is a first shingle of the other. Sets that hold nothing strongly don't meet one another. Inside a cell
   and between cells with the same leading shingle all pairs of sets are compared: the links of n near copies of one
   text are n**2 / 2, and `jaccard_links`, which counts them, takes that long.
5. Pairs of cells go to tasks fragment by fragment; a task counts the partial overlaps of all pairs of its two cells
   as one packed matrix. Matrices are summed for each pair of cells. `jaccard_links` compares all these pairs and adds
   up, for each set, the documents that it links with. Where only components are asked for, links that join something
   (a spanning forest) are enough: in wide clusters cells with the same leading shingle meet themselves and the next
   one first; after that only sets outside their cluster's largest component meet the other cells, since links within
   a component add nothing.

Comparisons are exact on 64-bit shingle hashes; ids of classes have 63 bits, so that among n different sets about
n**2 / 2**64 pairs are taken for equal (0.05 at 10**9). Defined results: null and empty texts have an empty set and
link with nothing; a text below five words has its whole word sequence as only shingle; a very long text is cut into
overlapping pieces of `PIECE` bytes, which gives the same set; a null doc_id sorts below all others; rows that repeat
a doc_id are judged one by one, and a link with each counts; equal sizes and ties need no order; an empty table gives
an empty result; other columns, whatever their names, are ignored by `jaccard_report` and `jaccard_links` and kept by
`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import connected
from siltstone.llm.shared import LANE, LOWER, SPACE, U, blobs, dealt, fresh, joined, materialize, mix, n_fragments, one_by_one, shuffles, small, texts, word_hashes, words_of

WIDTH, PERCENT, HEAD, BLOCK, CUTS, SPAN, FEW, PIECE = 5, 80, 0.4, 256, 4, 8, 16, 8 << 20
#: A shingle that a task has met in so many blocks is known to be shared, and isn't sent again.
HOT_BLOCKS = 24
NO_ID = -(1 << 63)


def _pieces(data: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Stretches of a long text that overlap by `width` - 1 words: each run of `width` words lies in one of them. None for a text with fewer words."""
    starts = ~SPACE[data]
    starts[1:] &= SPACE[data[:-1]]
    s = np.flatnonzero(starts)
    a, last = 0, len(s) - width
    while a <= last:
        z = min(max(int(np.searchsorted(s, s[a] + PIECE)), a + 1), last + 1)
        yield data[s[a] : s[z + width - 1] if z + width - 1 < len(s) else len(data)]
        a = z


def shingles(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, ascending within a text: hashes, first index of each text (n+1 values)."""
    n = len(off) - 1
    if n == 1 and len(data) > 2 * PIECE:
        h = np.zeros(0, np.uint64)
        for piece in _pieces(data, width):
            h = np.union1d(h, shingles(piece, np.array([0, len(piece)]), width)[0])
        if len(h):
            return h, np.array([0, len(h)])
    low = LOWER[data]
    s, e, first = words_of(low, off)
    w = word_hashes(low, s, e)
    count = np.diff(first)
    row = np.repeat(np.arange(n), count)
    with np.errstate(over="ignore"):
        if len(w) >= width:
            h = np.zeros(len(w) - width + 1, np.uint64)
            for j in range(width):
                h += w[j : len(w) - width + 1 + j] * LANE[j]
            whole = row[: len(h)] == row[width - 1 :]
            h, r = mix(h[whole]), row[: len(h)][whole]
        else:
            h, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((count > 0) & (count < width))
        if len(few):
            x = [mix(np.sum(w[first[k] : first[k + 1]] * LANE[: count[k]], dtype=np.uint64, keepdims=True) + U(int(count[k])))[0] for k in few]
            h, r = np.concatenate([h, np.array(x, np.uint64)]), np.concatenate([r, few])
    order = np.argsort(h)
    order = order[np.argsort(r[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(n + 1))


def class_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 63-bit id of each text's set; 0 for an empty one."""
    out = np.zeros(len(first) - 1, np.uint64)
    some = first[1:] > first[:-1]
    if some.any():
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(h ^ LANE[11]), first[:-1][some])
            out[some] = (mix(sums * LANE[12] + np.diff(first)[some].astype(np.uint64)) >> U(1)) | U(1)
    return out.astype(np.int64)


def missing(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many shingles of a set of n a linked set may lack."""
    return n - (percent * n + 99) // 100


def missing_strongly(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many shingles of a set of n a linked set that isn't smaller may lack."""
    return n - (2 * percent * n + 99 + percent) // (100 + percent)


META = np.dtype([("id", "<i8"), ("h", "<i8"), ("cid", "<i8"), ("n", "<i8"), ("need", "<i8"), ("local", "<i8")])


def _heads(fragments: int, percent: int):
    """Texts to rows (fragment, kind, ids, body): what each document is (kind 1), and the head of its set (kind 0).

    A shingle that is common in a task is sent from its first blocks only, at last with a mark that it is shared; from
    there on its documents count it themselves. What shares a counter with it by chance is taken for shared too, and compared in vain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, hot = np.zeros(1 << 22, np.uint8), np.zeros(0, np.uint64)
        for b in batches:
            ids_all, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for a, z, data, off in texts(b.column(1)):
                h, first = shingles(data, off)
                n = np.diff(first)
                cid = class_ids(h, first)
                head = np.where(n > 0, np.minimum(n, (HEAD * n).astype(np.int64) + 1), 0)
                meta = np.zeros(len(n), META)
                meta["id"], meta["h"], meta["cid"], meta["n"], meta["need"] = ids_all[a:z], keys[a:z], cid, n, head - missing(n, percent)
                _, lead = np.unique(cid, return_index=True)  # of a class, one document of the block is enough
                lead = lead[n[lead] > 0]
                pick = np.repeat(first[:-1][lead], head[lead]) + np.arange(head[lead].sum()) - np.repeat(np.cumsum(head[lead]) - head[lead], head[lead])
                v, doc = h[pick], np.repeat(lead, head[lead])
                order = np.argsort(v, kind="stable")
                v, doc = v[order], doc[order]
                new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
                start = np.flatnonzero(new)
                times = np.diff([*start, len(v)])
                each = v[start]
                slot = (mix(each) & U(len(blocks) - 1)).astype(np.int64)
                blocks[slot] += blocks[slot] < 255
                known, often = np.isin(each, hot), blocks[slot] > HOT_BLOCKS
                hot = np.union1d(hot, each[often & ~known])
                both = np.repeat((times > 1) | often | known, times)
                meta["local"] = np.bincount(doc[both], minlength=len(n))
                order = np.argsort(meta["id"].view(np.uint64) % U(fragments), kind="stable")
                f = (meta["id"].view(np.uint64) % U(fragments)).astype(np.int64)[order]
                at = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                none = pa.array([b""] * len(at), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(f[at]), pa.array(np.ones(len(at), np.int32)), none, blobs(meta[order], at)], ["fragment", "kind", "ids", "body"])
                if not len(v):
                    continue
                v, who, once = each[~known], doc[start][~known], ((times == 1) & ~often)[~known]
                if not len(v):
                    continue
                f = (v % U(fragments)).astype(np.int64)
                order = np.argsort(f, kind="stable")
                f = f[order]
                at = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                bodies, idb = [], []
                for s, t in zip(at, [*at[1:], len(f)], strict=True):
                    p = order[s:t]
                    docs, ordinal = np.unique(who[p], return_inverse=True)
                    ordinal = np.where(once[p], ordinal, 0xFFFFFFFF).astype(np.uint32)
                    bodies.append(v[p].tobytes() + (ordinal if len(docs) >= 65535 else ordinal.astype(np.uint16)).tobytes())
                    idb.append(cid[docs].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(f[at]), pa.array(np.zeros(len(at), np.int32)), pa.array(idb, pa.binary()), pa.array(bodies, pa.binary())], ["fragment", "kind", "ids", "body"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each fragment: (cid, id, h, n, need, shared) with either what a document is or how much of a set's head occurs elsewhere."""
    names = ["cid", "id", "h", "n", "need", "shared"]
    for _, t in one_by_one(batches):
        kind = t.column("kind").to_numpy()
        meta = joined(t.filter(pa.array(kind == 1)).column("body"), META)
        if len(meta):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(meta[c])) for c in ("cid", "id", "h", "n", "need", "local")], names)
        t = t.filter(pa.array(kind == 0))
        vs, cs, many = [], [], []
        for ids, x in zip(t.column("ids").to_pylist(), t.column("body").to_pylist(), strict=True):
            docs = np.frombuffer(ids, np.int64)
            wide = len(docs) >= 65535
            n = len(x) // (12 if wide else 10)
            o = np.frombuffer(x, np.uint32 if wide else np.uint16, n, 8 * n).astype(np.int64)
            multi = o == (0xFFFFFFFF if wide else 0xFFFF)
            vs.append(np.frombuffer(x, np.uint64, n))
            cs.append(docs[np.where(multi, 0, o)])
            many.append(multi)
        if not vs:
            continue
        v, c, multi = np.concatenate(vs), np.concatenate(cs), np.concatenate(many)
        order = np.argsort(v, kind="stable")
        v, c, multi = v[order], c[order], multi[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        shared = (np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)) | np.logical_or.reduceat(multi, start)
        c, times = np.unique(c[shared[group] & ~multi], return_counts=True)
        zero = pa.array(np.zeros(len(c), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(len(c), pa.int64()), zero, zero, zero, pa.array(times.astype(np.int64))], names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, cid) to (cid, n, body) where the text is of that class: its whole set, packed."""
    for b in batches:
        want = b.column(1).to_numpy(zero_copy_only=False)
        for a, z, data, off in texts(b.column(0)):
            h, first = shingles(data, off)
            ok = class_ids(h, first) == want[a:z]
            body = blobs(h, first[:-1]).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([pa.array(want[a:z][ok]), pa.array(np.diff(first)[ok]), body], ["cid", "n", "body"])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets gathered into blocks of about 2 MB: (block, cids, body); a block is named by its first class."""

    def packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        cids = np.array([r[0] for r in rows], np.int64)
        lens = np.array([len(r[1]) // 8 for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([np.column_stack([cids, lens]).tobytes()], pa.binary()), pa.array([b"".join(r[1] for r in rows)], pa.binary())], ["block", "cids", "body"])

    held, size = [], 0
    for b in batches:
        for cid, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.append((cid, body))
            size += len(body)
            if size > 2 << 20:
                yield packed(held)
                held, size = [], 0
    if held:
        yield packed(held)


def _tokens(fragments: int):
    """Blocks to (fragment, block, body): their distinct shingles and in how many of their sets each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v, c = np.unique(np.frombuffer(body, np.uint64), return_counts=True)
                f = (v % U(fragments)).astype(np.int64)
                order = np.argsort(f, kind="stable")
                f, v, c = f[order], v[order], c[order].astype(np.uint32)
                at = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                out = [v[s:t].tobytes() + c[s:t].tobytes() for s, t in zip(at, [*at[1:], len(f)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f[at]), pa.array([block] * len(at), pa.int64()), pa.array(out, pa.binary())], ["fragment", "block", "body"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each fragment: the number of sets that hold a shingle, back to each block that sent it: (block, fragment, body)."""
    for f, t in one_by_one(batches):
        bodies = t.column("body").to_pylist()
        lens = [len(x) // 12 for x in bodies]
        v = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(bodies, lens, strict=True)])
        c = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(bodies, lens, strict=True)])
        values, inverse = np.unique(v, return_inverse=True)
        total = np.bincount(inverse, weights=c, minlength=len(values)).astype(np.uint32)[inverse]
        at = np.cumsum([0, *lens[:-1]])
        yield pa.RecordBatch.from_arrays([t.column("block").combine_chunks(), pa.array([f] * len(lens), pa.int64()), blobs(total, at)], ["block", "fragment", "body"])


def _prefixes(fragments: int, percent: int):
    """Blocks with the frequencies of their shingles to rows (fragment, body).

    The sets of a block that share a token of their prefixes, which one of them holds strongly, have one label. Packed are
    (token, label, strong) for each fragment; under fragment -1 (cid, label, leading token, strong) of all sets; under -2
    the tokens of each set's prefix, those held strongly first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cids, body, replies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                meta = np.frombuffer(cids, np.int64).reshape(-1, 2)
                cid, lens = meta[:, 0], meta[:, 1]
                h = np.frombuffer(body, np.uint64)
                v, inverse = np.unique(h, return_inverse=True)
                f = (v % U(fragments)).astype(np.int64)
                order = np.argsort(f, kind="stable")
                df = np.zeros(len(v), np.int64)
                df[order] = np.concatenate([np.frombuffer(r["body"], np.uint32) for r in sorted(replies, key=lambda r: r["fragment"])])
                row = np.repeat(np.arange(len(cid)), lens)
                d = df[inverse]
                order = np.lexsort((h, d, row))
                place = np.arange(len(h)) - np.repeat(np.cumsum(lens) - lens, lens)
                first = place < np.repeat(missing(lens, percent) + 1, lens)
                lead, strong = order[first], (place < np.repeat(missing_strongly(lens, percent) + 1, lens))[first]
                strong, lead = strong[d[lead] > 1], lead[d[lead] > 1]
                token, who = inverse[lead], row[lead]
                joins = np.zeros(len(v), bool)
                joins[token[strong]] = True
                label = _connect(len(cid), who[joins[token]], token[joins[token]])
                name = np.full(len(cid), np.iinfo(np.int64).max)
                np.minimum.at(name, label, cid)
                mine = name[label]
                pair = np.unique(np.column_stack([token, label[who], strong]), axis=0) if len(token) else np.zeros((0, 3), np.int64)
                ff = f[pair[:, 0]]
                order = np.argsort(ff, kind="stable")
                ff, tv, tl, ts = ff[order], v[pair[order, 0]], name[pair[order, 1]], pair[order, 2].astype(np.uint8)
                at = np.flatnonzero(np.concatenate([[True], ff[1:] != ff[:-1]])) if len(ff) else np.zeros(0, np.int64)
                out = [tv[s:t].tobytes() + tl[s:t].tobytes() + ts[s:t].tobytes() for s, t in zip(at, [*at[1:], len(ff)], strict=True)]
                times, strongly = np.bincount(who, minlength=len(cid)), np.bincount(who[strong], minlength=len(cid))
                leading = np.zeros(len(cid), np.uint64)
                if len(who):  # they are in order of their sets
                    among = strong | (strongly[who] == 0)
                    many = np.bincount(who[among], minlength=len(cid))
                    leading[many > 0] = np.minimum.reduceat(v[token[among]], (np.cumsum(many) - many)[many > 0])
                of_sets = np.int64(len(cid)).tobytes() + np.column_stack([cid, times, strongly]).tobytes() + v[token].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ff[at], [-1, -2]])), pa.array([*out, np.column_stack([cid, mine, leading.view(np.int64), strongly > 0]).tobytes(), of_sets], pa.binary())], ["fragment", "body"])

    return run


def _connect(n: int, a: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Label of each of n rows, rows with a common token alike: the smallest row of its component."""
    label = np.arange(n)
    if not len(a):
        return label
    _, token = np.unique(token, return_inverse=True)
    while True:
        low = np.full(token.max() + 1, n)
        np.minimum.at(low, token, label[a])
        new = label.copy()
        np.minimum.at(new, a, low[token])
        np.minimum.at(new, label, new)  # the whole component follows
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _token_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each fragment: edges from each label that holds a token to the token's smallest label, if one of them holds it strongly."""
    for _, t in one_by_one(batches):
        bodies = t.column("body").to_pylist()
        sizes = [len(x) // 17 for x in bodies]
        v = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(bodies, sizes, strict=True)])
        label = np.concatenate([np.frombuffer(x, np.int64, n, 8 * n) for x, n in zip(bodies, sizes, strict=True)])
        strong = np.concatenate([np.frombuffer(x, np.uint8, n, 16 * n) for x, n in zip(bodies, sizes, strict=True)])
        order = np.lexsort((label, v))
        v, label, strong = v[order], label[order], strong[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        low, joins = label[start][group], (np.maximum.reduceat(strong, start) > 0)[group]
        e = np.unique(np.column_stack([label, low])[(label != low) & joins], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], ["a", "b"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = joined(b.column(0), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)), pa.array(x[:, 3] > 0)], ["cid", "label", "lead", "strong"])


def _set_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for body in b.column(0).to_pylist():
            x = np.frombuffer(body, np.int64)
            sets, tokens = x[1 : 1 + 3 * x[0]].reshape(-1, 3), x[1 + 3 * x[0] :]
            at = np.concatenate([[0], np.cumsum(sets[:, 1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(sets[:, 0])), pa.array(np.ascontiguousarray(sets[:, 2])), pa.ListArray.from_arrays(pa.array(at), pa.array(tokens))], ["cid", "strongly", "tokens"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right, side, cid, comp, n, k, body) to rows with one fragment's segment each."""
    for b in batches:
        for cut in range(CUTS):
            out = []
            for x in b.column(7).to_pylist():
                h = np.frombuffer(x, np.uint64)
                lo, hi = np.searchsorted(h, [U(cut << 62), U((cut + 1 << 62) - 1)], side="left") if cut < CUTS - 1 else (np.searchsorted(h, U(cut << 62)), len(h))
                out.append(h[lo:hi].tobytes())
            cut_no = pa.array(np.full(b.num_rows, cut, np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:7], cut_no, pa.array(out, pa.binary())], ["left", "right", "side", "cid", "comp", "n", "k", "cut", "body"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each fragment of each pair of cells: the partial overlaps of all pairs of sets, as one packed matrix."""
    for _, t in one_by_one(batches, 0):
        t = t.sort_by([("left", "ascending"), ("right", "ascending"), ("cut", "ascending"), ("side", "ascending"), ("cid", "ascending")])
        key = np.column_stack([t.column(c).to_numpy() for c in ("left", "right", "cut")])
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        for s, e in zip(cuts, [*cuts[1:], len(key)], strict=True):
            p = t.slice(s, e - s)
            side = p.column("side").to_numpy()
            bodies = [np.frombuffer(x, np.uint64) for x in p.column("body").to_pylist()]
            v = np.concatenate(bodies)
            row = np.repeat(np.arange(len(bodies)), [len(x) for x in bodies])
            _, token, times = np.unique(v, return_inverse=True, return_counts=True)
            token, row = token[times[token] > 1], row[times[token] > 1]
            a = int((side == 0).sum())
            one = a == len(side)
            m = np.zeros((a, a if one else len(side) - a), np.float32)
            if len(token):
                _, token = np.unique(token, return_inverse=True)
                for k in range(0, token.max() + 1, 2048):
                    part = (token >= k) & (token < k + 2048)
                    x = np.zeros((len(side), 2048), np.float32)
                    x[row[part], token[part] - k] = 1
                    m += x[:a] @ (x if one else x[a:]).T
            left, right, cut = key[s].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([left], pa.int64()), pa.array([right], pa.int64()), pa.array([cut], pa.int32()), pa.array([np.column_stack([p.column(x).to_numpy() for x in ("cid", "comp", "n", "side", "k")]).astype(np.int64).tobytes() if cut == 0 else b""], pa.binary()), pa.array([m.astype(np.uint32).tobytes()], pa.binary())], ["left", "right", "cut", "sets", "body"])


def _links(percent: int, count: bool):
    """Partial overlaps summed for each pair of sets: edges (a, b) of a spanning forest of the links.

    With `count` also a row (a, a, links) for each set that links: with how many documents of the other cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in one_by_one(batches, 0):
            t = t.sort_by([("left", "ascending"), ("right", "ascending"), ("cut", "ascending")])
            key = np.column_stack([t.column(c).to_numpy() for c in ("left", "right")])
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            for s, e in zip(cuts, [*cuts[1:], len(key)], strict=True):
                p = t.slice(s, e - s)
                sets = np.frombuffer(p.column("sets").to_pylist()[0], np.int64).reshape(-1, 5)
                left, right = sets[sets[:, 3] == 0], sets[sets[:, 3] == 1]
                one = not len(right)
                right = left if one else right
                m = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in p.column("body").to_pylist()).reshape(len(left), len(right))
                ok = 100 * m >= percent * (left[:, 2][:, None] + right[:, 2][None] - m)
                ok &= left[:, 1][:, None] != right[:, 1][None]  # already in one component
                if count:
                    cid, links = left[:, 0], ok @ right[:, 4]
                    if not one:
                        cid, links = np.concatenate([cid, right[:, 0]]), np.concatenate([links, left[:, 4] @ ok])
                    cid, links = cid[links > 0], links[links > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(cid), pa.array(links)], ["a", "b", "links"])
                i, j = np.nonzero(ok)
                if len(i):
                    a, b = left[i, 0], right[j, 0]
                    ids, x = np.unique(np.concatenate([a, b]), return_inverse=True)
                    edge = np.arange(len(a))
                    label = _connect(len(ids), x, np.concatenate([edge, edge]))
                    far = np.flatnonzero(label != np.arange(len(ids)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]]), pa.array(np.zeros(len(far), np.int64))], ["a", "b", "links"])

    return run


def _compare(pairs: DataFrame, percent: int, count: bool = False) -> DataFrame:
    """Rows (left, right, side, cid, comp, n, k, body) to (a, b, links): a spanning forest of the links, and with `count` a row (a, a) with what each set links with."""
    cut = pairs.mapInArrow(_segments, "left long, right long, side int, cid long, comp long, n long, k long, cut int, body binary")
    rows = dealt(cut.select(F.xxhash64("left", "right", "cut").alias("task"), "*"), "task")
    sums = rows.mapInArrow(_partial, "left long, right long, cut int, sets binary, body binary")
    rows = dealt(sums.select(F.xxhash64("left", "right").alias("task"), "*"), "task")
    return rows.mapInArrow(_links(percent, count), "a long, b long, links long")


ROW = ("left", "right", "side", "cid", "comp", "n", "k", "body")


def _cell(i: Column) -> Column:
    """The id of a group's cell number i."""
    return F.xxhash64("grp", i.cast("int"))


@dataclass
class Candidates:
    meta: DataFrame  # _id, h (hash of the text), n, cid of each row of the table
    sets: DataFrame  # cid, n, body
    placed: DataFrame  # cid, k (documents of the class), cluster, wide, strong, grp, cells (of the group), i and cell for the sets of each cluster
    tokens: DataFrame  # cid, tokens of the prefix, of which the first `strongly`
    any_wide: bool

    def held(self) -> DataFrame:
        """(grp, cell, cid, token, strong) of the sets of wide clusters."""
        rows = self.placed.where("wide").join(self.tokens, "cid").select("grp", "cell", "cid", "strongly", F.posexplode("tokens").alias("at", "token"))
        return rows.select("grp", "cell", "cid", "token", (F.col("at") < F.col("strongly")).alias("strong"))


def candidates(docs: DataFrame, percent: int = PERCENT) -> Candidates:
    """Classes, clusters and cells of `docs`, all materialized."""
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "text", F.xxhash64("text").alias("_h"))
    fragments = max(2 * shuffles(docs), n_fragments(docs, 6 << 20))
    heads = slim.mapInArrow(_heads(fragments, percent), "fragment long, kind int, ids binary, body binary")
    told = materialize(dealt(heads, "fragment", shuffles(docs)).mapInArrow(_shared, "cid long, id long, h long, n long, need long, shared long"), "shared")
    meta = told.where(F.col("id").isNotNull()).select(F.col("id").alias("_id"), "h", "n", "cid")
    judged = told.groupBy("cid").agg(F.min("id").alias("_id"), F.max("need").alias("need"), F.sum("shared").alias("shared"), F.count("id").alias("k"))
    alive = materialize(judged.where("cid <> 0 and shared >= need").select("_id", "cid", "k"), "alive")
    sets = slim.join(small(alive.select("_id", "cid")), "_id").select("text", "cid").mapInArrow(_sets, "cid long, n long, body binary").dropDuplicates(["cid"])
    sets = materialize(sets, "sets")
    blocks = materialize(sets.select("cid", "body").mapInArrow(_blocked, "block long, cids binary, body binary"), "blocks")
    tokens = blocks.select("block", "body").mapInArrow(_tokens(fragments), "fragment long, block long, body binary")
    replies = dealt(tokens, "fragment").mapInArrow(_frequencies, "block long, fragment long, body binary")
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("fragment", "body")).alias("replies"))
    prefixes = blocks.join(replies, "block").select("cids", "body", "replies").mapInArrow(_prefixes(fragments, percent), "fragment long, body binary")
    prefixes = materialize(prefixes, "prefixes")
    edges = dealt(prefixes.where("fragment >= 0"), "fragment").mapInArrow(_token_edges, "a long, b long")
    roots = connected(edges)
    labels = prefixes.where("fragment = -1").select("body").mapInArrow(_labels, "cid long, label long, lead long, strong boolean")
    clusters = labels.join(roots, labels.label == roots.node, "left").select("cid", "lead", "strong", F.coalesce("root", "label").alias("cluster"))
    clusters = materialize(clusters, "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    told = clusters.join(sizes, "cluster").join(alive.select("cid", "k"), "cid")
    seen = sizes.agg(F.coalesce(F.sum(F.when(F.col("size") <= FEW, F.col("size"))), F.lit(0)).alias("few"), F.coalesce(F.max("size"), F.lit(0)).alias("most")).first()
    any_wide = seen.most > max(SPAN * BLOCK, FEW)
    # Small clusters share cells; they have no token in common, so that comparing them costs little and finds nothing.
    bundle = F.xxhash64(F.lit("few"), F.pmod(F.xxhash64("cluster"), F.lit(max(1, seen.few // (2 * FEW)))))
    wide = F.col("size") > max(SPAN * BLOCK, FEW)
    told = told.withColumn("wide", wide).withColumn("grp", F.when(F.col("size") <= FEW, bundle).when(wide, F.xxhash64("cluster", "lead", "strong")).otherwise(F.col("cluster")))
    if any_wide:
        told = materialize(told, "groups")
        told = told.join(told.where("wide").groupBy("grp").agg(F.count(F.lit(1)).alias("members")), "grp", "left")
    else:
        told = told.withColumn("members", F.lit(None).cast("long"))
    cells = F.when(F.col("size") <= FEW, F.lit(1)).otherwise(F.ceil(F.coalesce("members", "size") / BLOCK)).cast("int")
    placed = told.withColumn("cells", cells).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("cells")).cast("int")).withColumn("cell", _cell(F.col("i")))
    placed = materialize(placed.select("cid", "k", "cluster", "wide", "strong", "grp", "cells", "i", "cell"), "placed")
    return Candidates(meta, sets, placed, prefixes.where("fragment = -2").select("body").mapInArrow(_set_tokens, "cid long, strongly long, tokens array<long>"), any_wide)


def _within(found: Candidates, every: bool) -> DataFrame:
    """Rows for `_compare`: each cell with each of its group, or, in wide clusters without `every`, with itself and the next one; sets of wide clusters that hold nothing strongly don't meet."""
    i, cells = F.col("i"), F.col("cells")
    pair = lambda j, side: F.struct(_cell(F.least(i, j)).alias("left"), _cell(F.greatest(i, j)).alias("right"), side.cast("int").alias("side"))
    near = F.sequence(F.greatest(i - 1, F.lit(0)), F.least(i + 1, cells - 1))
    others = F.sequence(F.lit(0), cells - 1) if every else F.when(F.col("wide"), near).otherwise(F.sequence(F.lit(0), cells - 1))
    rows = found.placed.where("strong or not wide").withColumn("at", F.explode(F.transform(others, lambda j: pair(j, i > j)))).join(found.sets, "cid").withColumn("comp", F.col("cid"))
    return rows.select("at.left", "at.right", "at.side", "cid", "comp", "n", "k", "body")


def _facing(pairs: DataFrame, left: DataFrame, right: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows for `_compare` of pairs (left, right) of cells; the sides have cell, cid, comp, k."""
    sides = [pairs.join(x.withColumnRenamed("cell", c), c).select("left", "right", F.lit(k).alias("side"), "cid", "comp", "k") for k, (c, x) in enumerate((("left", left), ("right", right)))]
    return sides[0].unionByName(sides[1]).join(sets, "cid").select(*ROW)


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (token, left, lg, right, rg) of cells, with their groups, that share a token which one of them holds strongly."""
    side = lambda x, cell, g: x.groupBy("token", F.col("cell").alias(cell), F.col("grp").alias(g)).agg(F.max("strong").alias(f"{g}_strong"))
    a, b = side(left, "left", "lg"), side(right, "right", "rg")
    return a.where("lg_strong").join(b, "token").unionByName(a.where("not lg_strong").join(b.where("rg_strong"), "token"))


def set_links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(_id, h, n, cid) for each row of `docs`; (cid, root), and (cid, links) with the documents of other classes that link, for the sets that link with others. Every pair of cells that can hold a link is compared."""
    found = candidates(docs, percent)
    links = _compare(_within(found, every=True), percent, count=True)
    if found.any_wide:
        cells = materialize(found.held(), "cells")
        pairs = _meeting(cells, cells).where("left < right and lg <> rg").select("left", "right").distinct()
        side = found.placed.where("wide").select("cell", "cid", F.col("cid").alias("comp"), "k")
        links = links.unionByName(_compare(_facing(materialize(pairs, "pairs"), side, side, found.sets), percent, count=True))
    links = materialize(links, "links")
    counts = links.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    return found.meta, connected(links).select(F.col("node").alias("cid"), "root"), counts


def set_components(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(_id, h, n, cid) for each row of `docs` and (cid, root) for the sets that link with others; both materialized."""
    found = candidates(docs, percent)
    links = _compare(_within(found, every=False), percent)
    if found.any_wide:
        links = materialize(links, "links")
        roots = connected(links)
        wide = found.placed.where("wide")
        comp = materialize(wide.join(roots, wide.cid == roots.node, "left").select("cid", "k", "cluster", "cell", F.coalesce("root", "cid").alias("comp")), "comp")
        per = comp.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("size"))
        largest = per.groupBy("cluster").agg(F.max_by("comp", F.struct("size", "comp")).alias("giant"))
        asking = materialize(comp.join(largest, "cluster").where("comp <> giant").select("cell", "cid", "comp", "k"), "asking")
        cells = materialize(found.held(), "cells")
        asks = cells.join(asking.select("cid"), "cid", "left_semi")
        pairs = _meeting(asks, cells).where("left <> right").select("left", "right").distinct()
        more = _compare(_facing(materialize(pairs, "pairs"), asking, comp.select("cell", "cid", "comp", "k"), found.sets), percent)
        links = links.unionByName(more)
    return found.meta, connected(links).select(F.col("node").alias("cid"), "root")


def with_components(docs: DataFrame, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """_id, h (hash of the text), n, cid, root (of the component), component (its smallest _id) and, with `links`, links for each row of `docs`; materialized."""
    meta, roots, *counts = set_links(docs, percent) if links else set_components(docs, percent)
    classes = meta.where("cid <> 0").groupBy("cid").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("k"))
    grouped = classes.join(roots, "cid").select("cid", "root", "least")
    whole = grouped.groupBy("root").agg(F.min("least").alias("whole"))
    told = ["links"] if links else []
    for found in counts:
        classes = classes.join(found, "cid", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("k") - 1)
    classes = classes.join(grouped.select("cid", "root"), "cid", "left").join(whole, "root", "left").select("cid", "root", F.coalesce("whole", "least").alias("component"), *told)
    out = meta.join(classes, "cid", "left").select("_id", "h", "n", "cid", F.coalesce("root", "cid").alias("root"), F.coalesce("component", "_id").alias("component"), *[F.coalesce(c, F.lit(0)).alias(c) for c in told])
    return materialize(out, "components")


def jaccard_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`."""
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return with_components(docs, percent).select(known("_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def jaccard_links(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of `docs`: with how many other rows it links."""
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return with_components(docs, percent, links=True).select(known("_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"), F.col("links").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, all columns: that with the smallest doc_id (a null is smallest); of several, that whose set and text have the smallest hash.

    Rows are judged one by one, whatever ids they repeat. Of rows that agree in id and text, one stays, whichever it
    is. Rows without words link with nothing and all stay.
    """
    rows = with_components(docs, percent).where("cid <> 0")
    first = rows.groupBy("root").agg(F.min(F.struct("_id", "cid", "h")).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "x._id", "x.h")
    first = materialize(first, "first")
    gone = rows.join(first.select("root"), "root", "left_semi").join(first, ["root", "_id", "h"], "left_anti").select("_id", "h").distinct()
    again = rows.join(first.select("_id", "h"), ["_id", "h"]).groupBy("_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id", "h")
    gone, again = materialize(gone, "gone"), materialize(again, "again")
    i, h, more = fresh(docs, "_id", "_h", "_again")
    key = lambda x: x.select(F.col("_id").alias(i), F.col("h").alias(h))
    out = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), h: F.xxhash64("text")}).join(small(key(gone)), [i, h], "left_anti")
    if again.limit(1).count():
        out = out.join(small(key(again).withColumn(more, F.lit(True))), [i, h], "left")
        out = out.where(F.col(more).isNull()).unionByName(out.where(more).dropDuplicates([i, h]))
    return out.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) i FROM w)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id root FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) n_shingles, component_id FROM (SELECT doc_id, min(root) component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

_WITH, _REST = ORACLE.rsplit("\nSELECT", 1)
#: The same with the number of links of each document.
LINKS_ORACLE = f"""{_WITH},
c AS (SELECT a doc_id, count(*) n_links FROM e GROUP BY a)
SELECT j.doc_id, n_shingles, component_id, coalesce(n_links, 0) n_links FROM (SELECT{_REST}) j LEFT JOIN c USING (doc_id)
"""
