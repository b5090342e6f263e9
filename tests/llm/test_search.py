"""Collocations, lexical search and license scans against brute force."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest

from siltstone.llm import collocations, lexical, licenses, queries
from tests.llm.conftest import edge, words
from tests.oracle import DATA, assert_same

A = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
QUERIES = ["op11_collocations", "op12_lexical", "op13_licenses"]


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, name):
    assert_same(queries.queries()[name](spark, f"{DATA}/sf0.001"), f"{DATA}/sf0.001", queries.oracle_sql()[name])


def brute_collocations(rows, least, first, percent=80):
    """rows: (lang, text). lang, rank, phrase, a, l, r, n, score."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(A)):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = collections.defaultdict(list)
    candidates = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    for (lang, p), a in candidates.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= percent * a and inside(p, q) for (g, q), b in candidates.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for lang, every in out.items() for i, (s, a, p, le, ri) in enumerate(sorted(every)[:first]))


def spoken(rng, n=400):
    """Texts of few words, so that phrases recur, in three languages and none; copies, nulls and odd separators."""
    vocabulary = ["new", "New", "york", "city", "of", "the", "ÉA", "x-y", "|", "日本", "l'a"]
    rows = []
    for k in range(n):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" "] * 6 + ["  ", "\t", ", ", ".", "!?", "\n", "\x0b", " ; "]) for w in parts)
        rows.append((rng.choice(["en", "en", "en", "fr", "", None, "und"]), text))
    return [*rows, *rows[:40], ("en", None), ("en", ""), (None, " \t.,"), ("en", "in new york city " * 300), ("zz", "alone " * 29), ("fr", "tie one. tie two. " * 40)]


@pytest.mark.parametrize("sizes", [(24 << 20, 6 << 20), (200, 500)])
def test_collocations(spark, monkeypatch, sizes):
    monkeypatch.setattr(collocations, "HELD_BYTES", sizes[0])
    monkeypatch.setattr(collocations, "CHUNK_BYTES", sizes[1])
    rows = spoken(random.Random(8))
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, weight int, phrase string").repartition(5)
    got = sorted(map(tuple, collocations.collocations(docs, least=12, first=25).collect()))
    assert got == brute_collocations(rows, 12, 25) and len(got) > 40
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocations_by_a_full_filter(spark, monkeypatch):
    """A filter that is too small lets all through, and nothing changes."""
    monkeypatch.setattr(collocations, "MOST_BITS", collocations.PART)
    monkeypatch.setattr(collocations, "BITS_EACH", 0)
    rows = spoken(random.Random(9), 150)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, least=5, first=10**6).collect())) == brute_collocations(rows, 5, 10**6)


def brute_search(docs, items, k):
    split = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").translate(A))
    bags = [(i, split(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    tfs = [(i, len(w), collections.Counter(w)) for i, w in bags]
    df = collections.Counter(t for _, _, c in tfs for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(split(text))
    out = []
    for item, terms in asked.items():
        found = []
        for i, size, c in tfs:
            m = 10 + 90 * size * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "asked"), [(6 << 20, 500_000), (3000, 20)])
def test_lexical(spark, docs, monkeypatch, block, asked):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "ASKED", asked)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(k, " ".join((rows[j][1] or "").split(" ")[:12])) for k, j in enumerate(range(9, 60, 3))] + [(100, None), (101, "?!"), (102, "zzzzzz"), (103, "one"), (103, "two ONE"), (None, "three four"), (104, rows[-4][1])]
    index = lexical.build_index(docs)
    frame = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, score int")
    got = sorted((tuple(r) for r in lexical.search(spark, index, frame, 7).collect()), key=repr)
    assert got == brute_search(rows, items, 7) and len(got) > 80


def test_lexical_on_nothing(spark, empty):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    index = lexical.build_index(empty)
    assert lexical.search(spark, index, items).count() == 0 and lexical.search(spark, index, items.limit(0)).count() == 0


def test_lexical_rescoring_is_needed_rarely(spark, docs):
    """Most documents are told apart by their bytes."""
    import numpy as np
    import pyarrow as pa

    rows = [(k, " ".join(random.Random(k).choices(["the", "of", "and", *(f"w{j}" for j in range(200))], k=80))) for k in range(2000)]
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    table = index.rows(spark).toArrow().combine_chunks()
    block = lexical._Block({c: table.column(c)[0] for c in table.column_names}, pa.array(["the", "w3", "w7"]))
    d, score = block.best(np.arange(3), np.array([300, 3000, 3000]), 10, 0)
    assert 10 <= len(d) < 200 and len(block.best(np.arange(3), np.array([300, 3000, 3000]), 10, 2 * int(score.max()))[0]) == 0


def brute_base(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").translate(A))
    at = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def licensed(rng):
    """Phrases at every border, whole and damaged passages, and what only looks like them."""
    mit, isc = licenses.TEXTS[0][0], licenses.TEXTS[1][0]
    damaged = lambda t, n: " ".join(x for x in t.split() if rng.random() > n / 100)
    rows = [(1, "under the MIT license"), (2, "it is Under\nthe--mit  license under the mit license, cc by nc cc by nc by nc"), (3, "under the mit"), (4, "Apache License, Version 2.0"), (5, "apache license version 20")]
    rows += [(6, mit), (7, words(rng, 50) + " " + isc + " " + words(rng, 50)), (8, damaged(mit, 4)), (9, damaged(mit, 60)), (10, mit[:60]), (11, f"{mit} {mit} {isc} under the mit license"), (12, "of the software " * 400)]
    rows += [(13, None), (14, ""), (None, "cc by nc"), (15, "cc by nc"), (15, "cc by"), (16, "é" * 5 + " cc by nc ñ"), (17, words(rng, 20_000) + " cc by nc"), (18, mit.replace("copies", "copies or parts").replace("sell", "sell or lend"))]
    return rows


def test_licenses(spark):
    rows = licensed(random.Random(3))
    got = licenses.license_report(edge(spark, rows).repartition(3)).collect()
    base = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    assert base == collections.Counter((i, *brute_base(t)) for i, t in rows)
    labels = {r.doc_id: r.labels for r in got}
    assert {k: labels[k] for k in (6, 7, 8, 9, 10, 11, 12, 18)} == {6: "mit", 7: "isc", 8: "mit", 9: "", 10: "", 11: "isc,mit", 12: "", 18: "mit"}
    assert all(0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.license_report(edge(spark, [])).count() == 0


def test_license_spans(spark):
    isc = licenses.TEXTS[1][0]
    rows = [(1, "a b " + isc + " c"), (2, "x cc by nc")]
    docs = edge(spark, rows)
    got = {r.doc_id: r for r in licenses.license_spans(docs, ("doc_id", "positions")).collect()}
    n = len(re.findall("[a-z0-9]+", isc.lower()))
    assert [tuple(s) for s in got[1].spans] == [("isc", 2, 2 + n, 1.0, True)] and [tuple(p) for p in got[2].places] == [("cc-by-nc", 1, 4)] and got[1].positions == 2
    with pytest.raises(ValueError, match="can't be kept"):
        licenses.license_spans(docs, ("n_words",))
    with pytest.raises(Exception, match="too few words"):
        licenses.license_spans(docs, phrases=[("a b", "x")]).collect()


def test_licenses_run_without_python(spark):
    plan = licenses.license_report(edge(spark, licensed(random.Random(3))))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
