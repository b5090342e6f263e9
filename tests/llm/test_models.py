"""Quality, language and toxicity: held-out accuracy, and edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language, quality, shared, toxicity
from tests.oracle import DATA


def real(spark, name, sf="sf0.1"):
    return spark.read.parquet(f"{DATA}/{sf}/{name}.parquet")


def test_quality_held_out(spark):
    got = quality.quality_report(real(spark, "documents"), real(spark, "labels")).join(real(spark, "labels"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.quality).mean()) > 0.97
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in (10, 12, 13, 14, 15, 16, 17, 40, 41, 60, 61)] + [(10, None), (None, 1), (999, 1)], "doc_id long, quality int")
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_text = docs.groupBy("text").count().where("count > 1").count()
    assert by_text > 0
    scored = quality.score_quality(docs, quality.train_quality(docs, labels), "q")
    assert scored.columns == [*docs.columns, "q"]
    assert scored.groupBy("text").agg(F.countDistinct("q").alias("k")).where("k > 1").count() == 0
    with pytest.raises(ValueError):
        quality.score_quality(docs, quality.QualityModel(), "score")
    assert {r.score for r in quality.quality_report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_report(empty, labels).count() == 0


def test_isotonic():
    x, y = np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1])
    knots, values = quality.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and np.interp(4, knots, values) == 1 and np.interp(2.5, knots, values) == pytest.approx(1 / 3)


def rows_of(spark, sf, name):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{sf}/{name}.parquet").collect()]


def crc(text):
    return zlib.crc32(str(text).encode())


def plain_statistics(text):
    """The statistics of a text, one after another."""
    raw = (text or "").encode()
    classes = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"\n", b".,;:'\"()-", b"!?", b"#$%&*+/<=>@[]\\^_`{|}~", bytes(range(128, 256))]
    n = max(1, len(raw))
    out = [sum(x in c for x in raw) / n for c in classes]
    counts = collections.Counter(raw)
    out.append(-sum(c / n * math.log2(c / n) for c in counts.values()))
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    lines = re.findall(rb"[^\n]+", raw)
    out += [math.log1p(len(raw)), math.log1p(len(lines))]
    m = max(1, len(words))
    mean = sum(map(len, words)) / m
    out += [mean, math.sqrt(max(0.0, sum(len(w) ** 2 for w in words) / m - mean**2))]
    low = [w.lower() for w in words]
    out += [len(set(low)) / m, sum(a == b for a, b in zip(low[1:], low[:-1], strict=True)) / m, sum(w[-1] in classes[6] + classes[7] for w in words) / m, len(set(lines)) / max(1, len(lines))]
    return out


def plain_isotonic(x, y, at):
    """The greatest of the least means, for each value; between values a line."""
    xs = sorted(set(x))
    groups = [[b for a, b in zip(x, y, strict=True) if a == v] for v in xs]
    sums, ns = [sum(g) for g in groups], [len(g) for g in groups]
    mean = lambda a, z: sum(sums[a : z + 1]) / sum(ns[a : z + 1])
    values = [max(min(mean(a, z) for z in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    return np.interp(at, xs, values)


def test_quality_like_a_dense_solution(spark):
    docs = rows_of(spark, "sf0.01", "documents")
    by_id = {r[0]: r[1] for r in docs}
    train = [(i, q) for i, q, _ in rows_of(spark, "sf0.01", "labels") if i in by_id and q is not None and crc(i) % 4 != 2]
    fit = [(by_id[i], q) for i, q in train if crc(f"calibrate{i}") % 5]
    cal = [(by_id[i], q) for i, q in train if crc(f"calibrate{i}") % 5 == 0]
    x = np.array([plain_statistics(t) for t, _ in fit])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    rng = np.random.default_rng(quality.SEED)
    w = rng.normal(size=(x.shape[1], quality.FEATURES)) / math.sqrt(x.shape[1])
    b = rng.uniform(0, 2 * math.pi, quality.FEATURES)

    def kernel(rows):
        z = np.clip((np.array(rows) - mean) / scale, -8, 8)
        return np.column_stack([math.sqrt(2 / quality.FEATURES) * np.cos(z @ w + b), np.ones(len(z))])

    z = kernel(x)
    ridge = np.diag([quality.RIDGE * len(x) / quality.FEATURES] * quality.FEATURES + [quality.RIDGE * len(x) * 1e-6 / quality.FEATURES])
    weights = np.linalg.solve(z.T @ z + ridge, z.T @ np.array([q for _, q in fit], float))
    raw = kernel([plain_statistics(t) for t, _ in cal]) @ weights
    want = plain_isotonic(raw.tolist(), [q for _, q in cal], kernel([plain_statistics(t) for _, t, *_ in docs]) @ weights)
    got = {r.doc_id: r for r in quality.quality_report(real(spark, "documents", "sf0.01"), real(spark, "labels", "sf0.01")).collect()}
    assert len(got) == len(docs)
    far = [abs(got[r[0]].score - v) for r, v in zip(docs, want, strict=True)]
    assert max(far) < 1e-4
    assert all(got[r[0]].held_out == (crc(r[0]) % 4 == 2) for r in docs)


def plain_grams(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode())
    raw = re.sub(b" +", b" ", b" " + raw)
    return [raw[k : k + 4] for k in range(len(raw) - 3)]


def test_language_like_sets(spark):
    docs = rows_of(spark, "sf0.01", "documents")
    seen, size = collections.defaultdict(collections.Counter), collections.Counter()
    for i, text, lang, *_ in docs:
        if lang is not None and crc(i) % 3 != 1:
            size[lang] += 1
            seen[lang].update(set(plain_grams(text)))
    top = collections.defaultdict(float)
    for lang, c in seen.items():
        for g, n in c.items():
            top[g] = max(top[g], n / size[lang])
    members = {lang: {g for g, n in c.items() if n >= 2 and n / size[lang] >= language.LEAST and n / size[lang] >= language.SHARE * top[g]} for lang, c in seen.items()}
    names = sorted(members)
    slots = lambda g: [int(s[0]) for s in language._slots(np.array([int.from_bytes(g, "little")], np.uint32), language.ROWS)]
    filled = {lang: {s for g in members[lang] for s in [(k, v) for k, v in enumerate(slots(g))]} for lang in names}
    rows = {lang: {v for _, v in filled[lang]} for lang in names}  # both probes look into one table
    rate = {lang: (len(rows[lang]) / language.ROWS) ** language.PROBES for lang in names}
    held = {}
    got = {r.doc_id: r for r in language.predict_language(real(spark, "documents", "sf0.01"), language.train_language(real(spark, "documents", "sf0.01"))).collect()}
    for i, text, *_ in docs[::5]:
        counts = dict.fromkeys(names, 0)
        grams = plain_grams(text)
        for g in grams:
            if g not in held:
                held[g] = [lang for lang in names if all(s in rows[lang] for s in slots(g))]
            for lang in held[g]:
                counts[lang] += 1
        right = {lang: max(counts[lang] - len(grams) * rate[lang], 0) / (1 - rate[lang]) for lang in names}
        best = max(names, key=lambda lang: (right[lang], [-ord(c) for c in lang]))
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
        else:
            assert got[i].lang_pred == best and got[i].score == pytest.approx(right[best] / max(sum(right.values()), 1e-9), abs=1e-9)


def plain_features(text, part=0, parts=1):
    from siltstone.llm.shared import word_hashes

    raw = (text or "").encode()
    words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", raw)]
    out = set()
    for k, w in enumerate(words):
        if k * parts // len(words) != part:
            continue
        for n in (0, *toxicity.BEGINNINGS):
            if n == 0 or len(w) > n:
                x = np.frombuffer(w[:n] if n else w, np.uint8)
                out.add((int(word_hashes(x, np.array([0]), np.array([len(x)]))[0]) + n) % 2**64)
    return out


def plain_logistic(x, y):
    """Newton's method until nothing moves, each sum by itself."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.array([toxicity.RIDGE] * (x.shape[1] - 1) + [1e-4])
    for _ in range(40):
        p = np.array([1 / (1 + math.exp(-max(-30, min(30, float(r @ w))))) for r in x])
        curve = sum(max(v * (1 - v), 1e-6) * np.outer(r, r) for r, v in zip(x, p, strict=True)) + np.diag(penalty)
        step = np.linalg.solve(curve, sum((t - v) * r for r, v, t in zip(x, p, y, strict=True)) - penalty * w)
        w = w + step
        if abs(step).max() < 1e-10:
            break
    return w


def test_toxicity_like_a_loop_of_models(spark):
    docs = rows_of(spark, "sf0.01", "documents")
    by_id = {r[0]: r[1] for r in docs}
    labels = [(i, int(t > 0)) for i, _, t in rows_of(spark, "sf0.01", "labels") if t is not None and i in by_id]
    texts = [by_id[i] for i, _ in labels]
    y = np.array([t for _, t in labels], float)
    fold = np.array([zlib.crc32(f"fold{hashlib.sha256((t or '').encode()).hexdigest()}".encode()) % toxicity.FOLDS for t in texts])
    found = [plain_features(t) for t in texts]
    pos, neg = collections.Counter(), collections.Counter()
    for f, t in zip(found, y, strict=True):
        (pos if t else neg).update(f)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    z = {h: (math.log((c + 0.5) / (y.sum() + 1)) - math.log((neg[h] + 0.5) / (len(y) - y.sum() + 1))) * math.sqrt(c) for h, c in pos.items() if c >= 3}
    kept = sorted(sorted((h for h in z if z[h] > 0), key=lambda h: (-z[h], signed(h)))[: toxicity.FEATURES])
    bits = lambda f: [float(h in f) for h in kept]
    x = np.array([bits(f) for f in found])
    by_part = [[bits(plain_features(t, k, toxicity.PARTS)) for k in range(toxicity.PARTS)] for t in texts]
    sure = lambda v, w: 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(v, w[:-1]) + w[-1])))))
    severe, out = np.zeros(len(y)), np.zeros(len(y))
    for k in range(toxicity.FOLDS):
        w = plain_logistic(x[fold != k], y[fold != k])
        for i in np.flatnonzero(fold == k):
            out[i] = sure(x[i], w)
            severe[i] = y[i] * (sum(sure(v, w) >= 0.5 for v in by_part[i]) >= toxicity.SEVERE)
    assert 0 < severe.sum() < y.sum()  # more than the first label said again
    first, second = plain_logistic(x, y), plain_logistic(np.column_stack([x, out]), severe)
    got = {r.doc_id: r for r in toxicity.score_toxicity(real(spark, "documents", "sf0.01"), toxicity.train_toxicity(real(spark, "documents", "sf0.01"), real(spark, "labels", "sf0.01"))).collect()}
    for i, text, *_ in docs:
        v = bits(plain_features(text))
        p = sure(v, first)
        assert got[i].p_toxic == pytest.approx(p, abs=1e-3) and got[i].p_severe == pytest.approx(sure([*v, p], second), abs=1e-3)


def test_normal_equations_fit():
    rng = np.random.default_rng(1)
    m = quality.QualityModel()
    x = rng.normal(size=(2000, quality.STATISTICS))
    y = (x[:, 0] > 0).astype(float)
    z = m.fourier(x)
    m.weights = np.linalg.solve(z.T @ z + 1e-3 * np.eye(z.shape[1]), z.T @ y)
    assert ((m.raw(x) > 0.5) == y).mean() > 0.9


def test_language_held_out(spark):
    d = real(spark, "documents")
    got = language.predict_language(d, language.train_language(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_edges(spark, docs, empty):
    got = language.predict_language(docs, language.train_language(docs)).collect()
    assert len(got) == docs.count()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {0, 1, 2, 5} <= und and 6 not in und and 10 not in und
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in language.predict_language(docs, language.train_language(empty)).collect()} == {"und"}
    assert language.predict_language(empty, language.train_language(docs)).count() == 0


def test_filter_returns_all_languages_of_a_gram():
    f = language.LanguageFilter.build({f"l{k:02}": np.array([k, 1000], np.uint32) for k in range(70)})
    assert f.masks.shape[1] == 2
    a, b = language._slots(np.array([1000], np.uint32), len(f.masks))
    assert sum(int(m).bit_count() for m in (f.masks[a[0]] & f.masks[b[0]])) == 70
    assert (f.rates() < 0.01).all()


def test_toxicity_held_out(spark):
    """Learned from three quarters of the labels, judged on the texts of the rest that aren't among them."""
    labels, docs = real(spark, "labels"), real(spark, "documents")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    known = docs.join(labels.where(~out), "doc_id").select("text")
    got = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels.where(~out)))
    unseen = docs.join(labels.where(out).select("doc_id", F.col("toxic").alias("y")), "doc_id").join(known, "text", "left_anti")
    got = got.join(unseen.select("doc_id", "y"), "doc_id").toPandas()
    hit, wrong = got[got.y == 1].toxic.mean(), got[got.y == 0].toxic.mean()
    print("held out:", len(got), "toxic", int(got.y.sum()), "found", hit, "clean ones taken for toxic", wrong)
    assert hit > 0.85 and wrong < 0.01
    assert ((got.severe == 1) <= (got.toxic == 1)).all()


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(60 <= i < 70)) for i in range(10, 70)] + [(10, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.p_toxic <= 1 for r in got)
    none = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels.limit(0))).collect()
    assert {(r.p_toxic, r.p_severe, r.toxic) for r in none} == {(0.0, 0.0, 0)}
    assert toxicity.score_toxicity(empty, toxicity.train_toxicity(docs, labels)).count() == 0


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(3)
    bits = rng.random((600, 4)) < 0.3
    a = bits[:, 0].astype(float)
    b = a * (bits[:, 1] | bits[:, 2])
    chain = toxicity.fit_chain(np.arange(4, dtype=np.uint64), bits, {"a": a, "b": b}, np.arange(600) % toxicity.FOLDS)
    p = chain.predict(bits)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert ((p[:, 0] > 0.5) == a).all() and ((p[:, 1] > 0.5) == b).mean() > 0.97


def test_a_labelled_id_in_many_rows(spark, monkeypatch):
    """A training set has one row for each sampled id, however many rows repeat it."""
    rows = [(i, f"good words number {i} stand here") for i in range(40)] + [(7, f"bad text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    one = shared.one_text(docs.join(labels, "doc_id"), ["doc_id"])
    assert one.count() == 40 and set(one.columns) == {"doc_id", "text", "lang", "quality", "toxic"}
    seen = []
    real = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda hashes, bits, *a: seen.append(len(bits)) or real(hashes, bits, *a))
    toxicity.train_toxicity(docs, labels, sample=10)
    assert seen in ([], [10])
    quality.train_quality(docs, labels, sample=10)
    language.train_language(docs, sample=10)
