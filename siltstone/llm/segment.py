"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

The lattice of a text has its byte places as nodes and vocabulary pieces as edges; a blank stands for the piece mark,
one is put before the text, and characters that are no piece are spelled in byte pieces. A segmentation's probability
is the product of its pieces'. The vocabulary is a BPE one, whose scores are merge ranks, so piece weights follow
Zipf's law in the rank, 1 / (rank + `SHIFT`); nothing is trained.

Since no piece has a mark behind another character, the lattice is a chain of one lattice for each word, and equal
words of a block of texts share theirs. Forward sums give the exact mass of every node.

Sampling goes from the text's end to its start. The root gets a Gumbel value, and every set of segmentations below a
node the maximum of its members' values, sampled top down (truncated at the parent's value). Best-first search (A*,
with the exact value as its bound) then pops segmentations in falling order: the first is an ancestral sample; each
further one is the best of all alternatives left along the paths so far. So the samples are distinct and drawn
without replacement. The value of the next one left, kappa, gives each sample its inclusion score
1 - exp(-exp(log_prob - kappa)). All randomness is a hash of the row key, the sample number and the place.

Defined results: a null or empty text has one segmentation, without pieces, of log-probability 0; a text with fewer
than k segmentations gives all it has, with inclusion 1, but for those whose place gives them less than 1e-13 of its
mass or which lie `REACH` below the best (in logarithms): such a one is not drawn, though it would be about once in
10**13 times; equal keys and texts give equal samples, ties of values go to the earlier sample and place; repeated rows
are sampled one by one; a null key counts as the word null; an empty table gives no rows; a text of any length is one
lattice, at some 100 bytes of memory for each of its bytes; decoding gives back every text exactly. Other columns,
whatever their names, are ignored by `sampled` and `sample_report` and kept by `encoded`, whose own column takes the
place of one with the same name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.files import opened
from siltstone.llm.shared import BYTE_CODE, LANE, U, mix, powers, texts, trim

SAMPLES, SHIFT, SEED, BLOCK_BYTES = 2, 10.0, 0, 1 << 19
#: Log values further below the best than this can't win: -log(-log(u)) of a 53-bit u stays below it.
REACH = 40.0
MARK = "▁"
#: Bytes of the character that a byte begins; 0 inside a character.
LEAD = np.repeat(np.array([1, 0, 2, 3, 4], np.int8), [128, 64, 32, 16, 16])


class Vocabulary:
    """Pieces as byte strings with the mark as a blank, their weights, and a table of the hashes of all their beginnings."""

    def __init__(self, model: bytes):
        import sentencepiece  # only these operators need it

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        spelled: dict[bytes, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(sp.id_to_piece(i)[3:5], 16)] = i
                self.bytes.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(sp.id_to_piece(i).replace(MARK, " ").encode())
                spelled[self.bytes[-1]] = i
        self.size = np.array([len(x) for x in self.bytes])
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        rank = np.full(n, float(n))
        for r, i in enumerate(sorted(spelled.values(), key=lambda i: (-sp.get_score(i), i))):
            rank[i] = r
        weight = 1 / (rank + SHIFT)
        self.logp = np.log(weight / weight.sum())
        self.chain = not any(b" " in p.lstrip(b" ") for p in spelled)  # words can be cut apart
        beginnings: dict[bytes, int] = {}
        for p in spelled:
            for k in range(1, len(p) + 1):
                beginnings.setdefault(p[:k], -1)
        for p, i in spelled.items():
            beginnings[p] = i
        keys = list(beginnings)
        self.hashes = np.array([self._hash(k) for k in keys], np.uint64)
        self.piece = np.array([beginnings[k] for k in keys], np.int32)
        self.most = max(map(len, spelled))
        # Beginnings of one and two bytes have tables of their own: index among the beginnings, -1 if it is none.
        self.single, self.double = np.full(256, -1, np.int32), np.full(65536, -1, np.int32)
        for k, b in enumerate(keys):
            if len(b) == 1:
                self.single[b[0]] = k
            elif len(b) == 2:
                self.double[b[0] | b[1] << 8] = k
        self.tables = []
        left = np.arange(len(keys))
        while len(left):  # each table holds the first key of a slot; the others go to the next one
            shift = U(44 - 9 * (len(self.tables) % 4))
            slot = self._slot(self.hashes[left], shift)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << 20, -1, np.int32)
            table[slot[first]] = left[first]
            self.tables.append((shift, table))
            left = np.delete(left, first)
            if len(self.tables) > 12:
                raise ValueError("equal hashes")

    @staticmethod
    def _slot(h: np.ndarray, shift: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * LANE[9]) >> shift) & U((1 << 20) - 1)

    @staticmethod
    def _hash(piece: bytes) -> int:
        x = np.frombuffer(piece, np.uint8)
        with np.errstate(over="ignore"):
            p = np.sum(BYTE_CODE[x] * powers(64)[0][: len(x)], dtype=np.uint64, keepdims=True)
            return int((p + U(len(x)))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the beginnings, -1 if it is none."""
        out = np.full(len(h), -1, np.int32)
        todo = None
        for shift, table in self.tables:
            x = h if todo is None else h[todo]
            at = table[self._slot(x, shift)]
            hit = (at >= 0) & (self.hashes[at] == x)
            if todo is None:
                out[hit] = at[hit]
                todo = np.flatnonzero(~hit & (at >= 0))
            else:
                out[todo[hit]] = at[hit]
                todo = todo[~hit & (at >= 0)]
            if not len(todo):
                break
        return out


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    found = Vocabulary(model)
    trim()
    return found


def model_bytes(path: str) -> bytes:
    """A model file, which the driver reads and sends to the workers; about 1 MB."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        return f.read()


class Lattice:
    """The lattices of the distinct words of a block. Nodes are numbered level by level (bytes from a word's start), longer words first; edges are sorted by the node they end in."""

    def __init__(self, voc: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        order = np.argsort(start - end, kind="stable")  # longer words first
        lens = (end - start)[order]
        self.words = np.empty(len(order), np.int64)  # each word's place within a level; its first node too
        self.words[order] = np.arange(len(order))
        most = int(lens[0])
        width = np.searchsorted(-lens, -np.arange(most + 1), side="right")  # words that reach each level
        self.level = np.concatenate([[0], np.cumsum(width)])
        n_nodes, size = int(self.level[-1]), int(lens.sum())
        self.length = end - start
        # Bytes in the order of the nodes they begin at: level by level, without the words' last nodes.
        per = np.searchsorted(-lens, -np.arange(1, most + 1), side="right")
        depth = np.repeat(np.arange(most), per)
        who = (np.arange(size) - np.repeat(np.cumsum(per) - per, per)).astype(np.int32)
        flat = np.cumsum(lens) - lens
        src = (flat[who] + depth).astype(np.int32)  # places in x, where each word's bytes are together
        x = data[np.arange(size) + np.repeat(start[order] - flat, lens)]
        level = self.level.astype(np.int32)
        depth = depth.astype(np.int32)
        room = lens[who].astype(np.int32) - depth
        pw, inv = powers(size + 1)
        lead = LEAD[x]
        known = np.zeros(size, bool)  # a character that begins here and is a piece
        tails, heads, ids = [], [], []
        with np.errstate(over="ignore"):
            p = np.zeros(size + 1, np.uint64)
            np.cumsum(BYTE_CODE[x] * pw[:size], out=p[1:])
            alive = np.arange(size, dtype=np.int32)
            for n in range(1, voc.most + 1):
                if n > 1:
                    alive = alive[room[alive] >= n]
                if not len(alive):
                    break
                at = src[alive]
                if n == 1:
                    found = voc.single[x[at]]
                elif n == 2:
                    found = voc.double[x[at].astype(np.int32) | x[at + 1].astype(np.int32) << 8]
                else:
                    found = voc.find((p[at + n] - p[at]) * inv[at] + U(n))
                ok = found >= 0
                alive = alive[ok]
                piece = voc.piece[found[ok]]
                hit = alive[piece >= 0]
                tails.append(level[depth[hit]] + who[hit])
                heads.append(level[depth[hit] + n] + who[hit])
                ids.append(piece[piece >= 0])
                if n <= 4:
                    hit = src[hit]
                    known[hit[lead[hit] == n]] = True
        # Bytes of characters that are no piece; a byte inside a character belongs to the one that began before it.
        if not known[lead > 0].all():
            raw = np.flatnonzero(~known[np.maximum.accumulate(np.where(lead > 0, np.arange(size), 0))[src]])
            tails.append(level[depth[raw]] + who[raw])
            heads.append(level[depth[raw] + 1] + who[raw])
            ids.append(voc.byte_id[x[src[raw]]].astype(np.int32))
        # Each run is sorted by its ends, so a stable sort merges them; of a place, the longest piece comes first, which is mostly the likeliest.
        head = np.concatenate(heads[::-1])
        order = np.argsort(head, kind="stable")
        self.tail, self.piece = np.concatenate(tails[::-1])[order], np.concatenate(ids[::-1])[order]
        count = np.bincount(head, minlength=n_nodes)
        self.ptr = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        self.head = np.repeat(np.arange(n_nodes, dtype=np.int32), count)
        logp = voc.logp[self.piece]
        self.cond = np.full(len(order), -np.inf)
        alpha = np.full(n_nodes, -np.inf)
        alpha[: self.level[1]] = 0
        for d in range(1, most + 1):
            a, z = int(self.level[d]), int(self.level[d + 1])
            lo, hi = int(self.ptr[a]), int(self.ptr[z])
            if lo == hi:
                continue
            v = alpha[self.tail[lo:hi]] + logp[lo:hi]
            k = count[a:z]
            some = k > 0
            seg, k = self.ptr[a:z][some] - lo, k[some]
            top = np.maximum.reduceat(v, seg)
            top[np.isinf(top)] = 0
            with np.errstate(divide="ignore", invalid="ignore"):
                total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, k)), seg))
                alpha[a:z][some] = total
                self.cond[lo:hi] = np.where(np.isinf(v), -np.inf, v - np.repeat(total, k))
        self.share = np.cumsum(np.exp(self.cond))
        self.share -= np.repeat(np.concatenate([[0], self.share])[self.ptr[:-1]], count)
        self.share[self.ptr[1:][count > 0] - 1] = 2  # the last one takes what rounding leaves
        # Edges that nothing reaches have no share; a last one of that kind leaves its place to the one before it.
        dead = np.flatnonzero(np.isinf(self.cond) & (self.share == 2))
        while len(dead):
            dead = dead[dead > self.ptr[self.head[dead]]] - 1
            self.share[dead] = 2
            dead = dead[np.isinf(self.cond[dead])]

    def ends(self, word: np.ndarray) -> np.ndarray:
        """The last node of each word."""
        return self.level[self.length[word]] + self.words[word]

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An incoming edge of each node, by its probability."""
        e = self.ptr[node].astype(np.int64)
        more = np.flatnonzero(self.share[e] <= u)
        while len(more):
            e[more] += 1
            more = more[self.share[e[more]] <= u[more]]
        return e


def _uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from a hash of the parts."""
    with np.errstate(over="ignore"):
        h = np.asarray(parts[0], np.uint64)
        for k, x in enumerate(parts[1:]):
            h = h + np.asarray(x).astype(np.uint64) * LANE[k + 3]
        h = mix(h)
    return ((h >> U(11)).astype(np.float64) + 0.5) / (1 << 53)


def _gumbel_below(phi: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values at locations phi, truncated at top."""
    return phi - np.log(np.exp(np.minimum(phi - top, 700)) - np.log(u))


def _walk(lat: Lattice, key: np.ndarray, state: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled edges of each occurrence of a word, from `state` down to its start: number of edges, edges in text order, one occurrence after another."""
    first = lat.level[1]  # the words' starts are the nodes below it
    active = np.flatnonzero(state >= first)
    key, place, state = key[active], place[active], state[active]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(int(active[-1]) + 1 if len(active) else 0, np.int64)
    while len(active):
        e = lat.choose(state, _uniform(key, place, len(steps), sample))
        steps.append((active, e))
        count[active] += 1
        state = lat.tail[e]
        on = state >= first
        active, key, place, state = active[on], key[on], place[on], state[on]
    stop = np.cumsum(count)
    edges = np.zeros(stop[-1] if len(stop) else 0, np.int64)
    for k, (who, e) in enumerate(steps):
        edges[stop[who] - 1 - k] = e
    return count, edges


def _word_at(lat: Lattice, path: np.ndarray, stop: int) -> int:
    """The occurrence of a word in which the step after `path` lies: a word is done where an edge begins at its start."""
    return stop - 1 - int((lat.tail[path] < lat.level[1]).sum())


def sample_block(voc: Vocabulary, keys: np.ndarray, data: np.ndarray, off: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text of a block its samples: (ids, log-probability, perturbed value, inclusion score)."""
    n, lens = len(off) - 1, np.diff(off)
    full = lens > 0
    at = np.cumsum(lens + full) - (lens + full)  # a blank goes before each text that isn't empty
    x = np.full(int((lens + full).sum()), 0x20, np.uint8)
    row = np.repeat(np.arange(n), lens)
    x[np.arange(len(data)) - off[row] + at[row] + 1] = data
    rows = np.repeat(np.arange(n), lens + full)
    begin = np.zeros(len(x), bool)
    begin[at[full]] = True
    if voc.chain:
        begin[1:] |= (x[1:] == 0x20) & (x[:-1] != 0x20)
    s = np.flatnonzero(begin)
    e = np.concatenate([s[1:], [len(x)]]).astype(np.int64)
    out: list[list[tuple[np.ndarray, float, float, float]]] = [[(np.zeros(0, np.int32), 0.0, 0.0, 1.0)] if not f else [] for f in full]
    if not len(s):
        return out
    pw, inv = powers(len(x) + 1)
    with np.errstate(over="ignore"):
        p = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(BYTE_CODE[x] * pw[: len(x)], out=p[1:])
        h = mix((p[e] - p[s]) * inv[s] + (e - s).astype(np.uint64))
    _, first, word = np.unique(h, return_index=True, return_inverse=True)
    lat = Lattice(voc, x, s[first], e[first])
    doc = rows[s]
    tokens = np.searchsorted(doc, np.arange(n + 1))
    place = tokens[doc + 1] - 1 - np.arange(len(s))  # from the text's end
    ends = lat.ends(word)
    key = keys[doc]
    count, edges = _walk(lat, key, ends, place, 0)
    cuts = np.zeros(len(s) + 1, np.int64)  # occurrences behind the last one with edges have none
    cuts[1 : len(count) + 1] = np.cumsum(count)
    cuts[len(count) + 1 :] = cuts[len(count)]
    path_at = cuts[tokens]
    root = -np.log(-np.log(_uniform(keys, np.uint64(0xFFFF), np.uint64(0xFFFF), 0)))
    paths: list[list[tuple[np.ndarray, float]]] = [[] for _ in range(n)]
    heaps: list[list[tuple]] = [[] for _ in range(n)]

    def alternatives(docs: np.ndarray, path: np.ndarray, cut: np.ndarray, since: np.ndarray, phi: np.ndarray, value: np.ndarray, sample: int) -> None:
        """Puts the best of what leaves each document's path (edges from the text's end, at step `since` and later) on its heap; phi: log-mass before it."""
        m = np.diff(cut)
        some = m > 0
        docs, since, phi, value, m = docs[some], since[some], phi[some], value[some], m[some]
        if not len(docs):
            return
        at = np.cumsum(m) - m
        seg = np.repeat(np.arange(len(docs)), m)
        c = np.minimum(lat.cond[path], 0)
        total = np.cumsum(c) - c
        before = total - (total[at] - phi)[seg]
        # What lies further below the value than REACH can be no rival to the values that are kept, but for one in e**REACH.
        ok = np.flatnonzero((c < -1e-13) & (before > (value - REACH)[seg]))
        if not len(ok):
            return
        seg, before, path = seg[ok], before[ok], path[ok]
        step = ok - at[seg] + since[seg]
        g = _gumbel_below(before + np.log(-np.expm1(c[ok])), value[seg], _uniform(keys[docs][seg], step, sample, 7))
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        group = np.cumsum(np.concatenate([[False], seg[1:] != seg[:-1]]))
        for _ in range(k + 1):  # no more can be popped
            top = np.maximum.reduceat(g, first)
            hit = np.flatnonzero((g == top[group]) & (g > -np.inf))
            hit = hit[np.unique(group[hit], return_index=True)[1]]
            for d, v, t, b, e in zip(docs[seg[hit]].tolist(), g[hit].tolist(), step[hit].tolist(), before[hit].tolist(), path[hit].tolist(), strict=True):
                heapq.heappush(heaps[d], (-v, sample, t, b, (e,)))
            g[hit] = -np.inf

    which = np.flatnonzero(full)
    flat = edges[::-1]  # from the last text's end to the first one's start
    for d in which.tolist():
        paths[d].append((edges[path_at[d] : path_at[d + 1]][::-1], float(root[d])))
    lens_ = np.diff(path_at)[which][::-1]
    alternatives(which[::-1], flat, np.concatenate([[0], np.cumsum(lens_)]), np.zeros(len(which), np.int64), np.zeros(len(which)), root[which][::-1], 0)
    for sample in range(1, k):
        # Pop the best alternative of each text, pick the edge that leaves, and sample the words before it anew.
        docs, fixed, begun = [], [], []
        state_of, place_of, key_of = [], [], []
        for d in np.flatnonzero(full).tolist():
            if not heaps[d]:
                continue
            g, parent, t, phi, gone = heapq.heappop(heaps[d])
            path = paths[d][parent][0]
            node = int(lat.head[path[t]])
            choice = [j for j in range(int(lat.ptr[node]), int(lat.ptr[node + 1])) if j not in gone and lat.cond[j] > -np.inf]
            prob = np.exp(lat.cond[choice])
            u = float(_uniform(keys[d : d + 1], np.uint64(t), np.uint64(sample), 11)[0])
            pick = choice[min(int(np.searchsorted(np.cumsum(prob), u * prob.sum(), side="right")), len(choice) - 1)]
            rest = float(prob.sum() - np.exp(lat.cond[pick]))
            if len(choice) > 1 and rest > 1e-300:
                loc = phi + np.log(rest)
                v = float(_gumbel_below(np.array([loc]), -g, _uniform(keys[d : d + 1], np.uint64(t), np.uint64(sample), 13))[0])
                heapq.heappush(heaps[d], (-v, parent, t, phi, (*gone, pick)))
            # The word that holds the node, and those before it.
            last = _word_at(lat, path[:t], int(tokens[d + 1]))
            w = np.arange(tokens[d], last + 1)
            st = ends[w].copy()
            st[-1] = lat.tail[pick]
            docs.append(d)
            fixed.append(np.concatenate([path[:t], [pick]]))
            begun.append((len(w), phi + float(lat.cond[pick]), -g))
            state_of.append(st)
            place_of.append(place[w])
            key_of.append(key[w])
        if not docs:
            break
        count, edges = _walk(lat, np.concatenate(key_of), np.concatenate(state_of), np.concatenate(place_of), sample)
        cuts = np.zeros(sum(len(x) for x in state_of) + 1, np.int64)
        cuts[1 : len(count) + 1] = np.cumsum(count)
        cuts[len(count) + 1 :] = cuts[len(count)]
        token, news = 0, []
        for d, head, (m, phi, g) in zip(docs, fixed, begun, strict=True):
            new = edges[cuts[token] : cuts[token + m]][::-1]
            token += m
            news.append((new, len(head), phi, g))
            paths[d].append((np.concatenate([head, new]), g))
        new, since, phi, g = zip(*news, strict=True)
        alternatives(np.array(docs), np.concatenate(new), np.concatenate([[0], np.cumsum([len(x) for x in new])]), np.array(since), np.array(phi), np.array(g), sample)
    for d in np.flatnonzero(full).tolist():
        kappa = -heaps[d][0][0] if heaps[d] else -np.inf
        for path, g in paths[d][:k]:
            log_prob = float(lat.cond[path].sum())
            inclusion = 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(log_prob - kappa, 50.0))))
            out[d].append((lat.piece[path][::-1].astype(np.int32), log_prob, g, inclusion))
    return out


def decoded(voc: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of a segmentation in UTF-8: the blank that was put before it is taken off."""
    size = voc.size[ids]
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return voc.flat[np.arange(total) + np.repeat(voc.at[ids] - stop + size, size)][1:].tobytes()


def row_keys(ids: list, seed: int = SEED) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed} {'null' if i is None else i}".encode(), digest_size=8).digest(), "little") for i in ids], np.uint64)


def sampled(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """A row for each sample: doc_id, sample, ids, log_prob, perturbed, inclusion, decoded."""
    held = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(held.value)
        for b in batches:
            for a, z, data, off in texts(b.column(1), BLOCK_BYTES):
                names = b.column(0)[a:z].to_pylist()
                rows = [(i, j, ids, lp, g, q) for i, found in zip(names, sample_block(voc, row_keys(names, seed), data, off, k), strict=True) for j, (ids, lp, g, q) in enumerate(found)]
                cols = list(zip(*rows, strict=True))
                size = np.cumsum([0, *map(len, cols[2])])
                packed = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(cols[2]), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), packed, *(pa.array(c, pa.float64()) for c in cols[3:]), pa.array([decoded(voc, x).decode() for x in cols[2]], pa.string())], ["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion", "decoded"])

    id_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"doc_id {id_type}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, decoded string")


def sample_report(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """A row for each document and sample: n_pieces, digests of the ids and of the decoded text, scores, and whether decoding gave the text back."""
    held = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(held.value)
        for b in batches:
            for a, z, data, off in texts(b.column(1), BLOCK_BYTES):
                names = b.column(0)[a:z].to_pylist()
                rows = []
                for d, found in enumerate(sample_block(voc, row_keys(names, seed), data, off, k)):
                    raw = data[off[d] : off[d + 1]].tobytes()
                    for j, (ids, lp, g, q) in enumerate(found):
                        back = decoded(voc, ids)
                        rows.append((names[d], j, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == raw, lp, g, q))
                cols = list(zip(*rows, strict=True))
                kinds = [b.column(0).type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "sample", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip", "log_prob", "perturbed", "inclusion"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, sample int, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean, log_prob double, perturbed double, inclusion double")


def encoded(docs: DataFrame, model: str, seed: int = SEED, ids: str = "piece_ids", samples: str = "piece_samples", k: int = 2) -> DataFrame:
    """`docs` with `k` distinct sampled segmentations of each text (fewer if it has fewer) in the column `samples`, as structs of ids and inclusion score, and the ids of the first in the column `ids`; each is decoded and compared before it is returned, and a null text has null in both."""
    docs = docs.drop(ids, samples)
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")
    held = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(held.value)
        for b in batches:
            for a, z, data, off in texts(b.column(at), BLOCK_BYTES):
                part = b.slice(a, z - a)
                found = sample_block(voc, row_keys(part.column(key).to_pylist(), seed), data, off, k)
                raw = [data[off[d] : off[d + 1]].tobytes() for d in range(z - a)]
                for d, drawn in enumerate(found):
                    if any(decoded(voc, x[0]) != raw[d] for x in drawn):
                        raise ValueError("decoding doesn't give the text back")
                null = np.array([not v.is_valid for v in part.column(at)])
                every = [[] if null[d] else drawn for d, drawn in enumerate(found)]
                first = _lists([[] if null[d] else drawn[0][0] for d, drawn in enumerate(found)], null)
                flat = [x for drawn in every for x in drawn]
                each = pa.StructArray.from_arrays([_lists([x[0] for x in flat], np.zeros(len(flat), bool)), pa.array([x[3] for x in flat], pa.float64())], ["ids", "inclusion"])
                at_doc = pa.array(np.cumsum([0, *map(len, every)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, first, pa.ListArray.from_arrays(at_doc, each, mask=pa.array(null))], [*b.schema.names, ids, samples])

    one = T.ArrayType(T.IntegerType())
    of = T.ArrayType(T.StructType([T.StructField("ids", one), T.StructField("inclusion", T.DoubleType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, one), T.StructField(samples, of)]))


def _lists(values: list, null: np.ndarray) -> pa.ListArray:
    """Arrays of ids as a list column."""
    size = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values or [np.zeros(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null))
