"""SentencePiece sampling: distribution, distinctness, inclusion scores, round trips."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from siltstone.llm import segment
from siltstone.llm.queries import PIECES
from tests.llm.conftest import texts


@pytest.fixture(scope="module")
def voc():
    return segment.vocabulary(segment.model_bytes(PIECES))


def block(strings):
    raw = [s.encode() for s in strings]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def all_segmentations(voc, text):
    pieces = {p: i for i, p in enumerate(voc.bytes) if p and i not in set(voc.byte_id)}
    raw = b" " + text.encode()

    def at(k):
        if k == len(raw):
            yield ()
        for n in range(1, voc.most + 1):
            if k + n <= len(raw) and raw[k : k + n] in pieces:
                for rest in at(k + n):
                    yield (pieces[raw[k : k + n]], *rest)

    found = list(at(0))
    logp = np.array([voc.logp[list(s)].sum() for s in found])
    p = np.exp(logp - np.logaddexp.reduce(logp))
    return dict(zip(found, p, strict=True))


def test_without_replacement(voc):
    text, n = "abc de", 6000
    p = all_segmentations(voc, text)
    out = segment.sample_block(voc, segment.row_keys(list(range(n))), *block([text] * n), 3)
    first = collections.Counter(tuple(o[0][0].tolist()) for o in out)
    pairs = collections.Counter((tuple(o[0][0].tolist()), tuple(o[1][0].tolist())) for o in out)
    for s, c in first.items():
        assert abs(c / n - p[s]) < 5 * np.sqrt(p[s] * (1 - p[s]) / n) + 2 / n
    for (a, b), c in pairs.items():
        q = p[a] * p[b] / (1 - p[a])
        assert abs(c / n - q) < 5 * np.sqrt(q * (1 - q) / n) + 2 / n
    for o in out:
        assert len({tuple(x[0].tolist()) for x in o}) == 3 and o[0][2] >= o[1][2] >= o[2][2]
        for ids, lp, _, _ in o:
            assert lp == pytest.approx(np.log(p[tuple(ids.tolist())]), abs=1e-9)
    assert np.mean([sum(np.exp(x[1]) / x[3] for x in o) for o in out]) == pytest.approx(1, abs=0.01)  # the scores weigh without bias


def test_all_segmentations_of_a_short_text(voc):
    p = all_segmentations(voc, "ab")
    (out,) = segment.sample_block(voc, segment.row_keys([1]), *block(["ab"]), 50)
    assert {tuple(x[0].tolist()) for x in out} == set(p) and all(x[3] == 1.0 for x in out)


@pytest.mark.parametrize("text", ["", " ", "   a  b ", "\n\t", "日本 ▁ é́ 🎉", "x" * 300, "ab\0c", "▁▁a"])
def test_round_trip(voc, text):
    (out,) = segment.sample_block(voc, segment.row_keys(["k"]), *block([text]), 3)
    assert out and all(segment.decoded(voc, x[0]).decode() == text for x in out)


def test_seeded_by_key_not_by_neighbours(voc):
    one = segment.sample_block(voc, segment.row_keys([5]), *block(["some words here"]), 2)[0]
    many = segment.sample_block(voc, segment.row_keys([4, 5, 6]), *block(["other text", "some words here", "words"]), 2)[1]
    assert [x[0].tolist() for x in one] == [x[0].tolist() for x in many]
    other = segment.sample_block(voc, segment.row_keys([5], seed=9), *block(["some words here"]), 2)[0]
    assert [x[2] for x in one] != [x[2] for x in other]


def test_query(spark, docs, empty):
    got = segment.sample_report(docs, PIECES).collect()
    assert all(r.round_trip for r in got)
    per = collections.Counter(r.sample for r in got)
    assert per[0] == len(texts())
    blank = {r.doc_id: (r.n_pieces, r.inclusion) for r in got if r.doc_id in (0, 1)}
    assert blank == {0: (0, 1.0), 1: (0, 1.0)}
    assert segment.sample_report(empty, PIECES).count() == 0
    rows = segment.sampled(docs.where("doc_id = 3"), PIECES).collect()
    assert len(rows) == 2 and {r.decoded for r in rows} == {"one two"}


def test_encoded(docs, empty):
    out = segment.encoded(docs, PIECES)
    assert out.columns == [*docs.columns, "piece_ids"] and out.count() == docs.count()
    assert {(r.doc_id, r.piece_ids is None) for r in out.where("doc_id IN (0, 1)").collect()} == {(0, True), (1, False)}
    assert segment.encoded(empty, PIECES).count() == 0
