"""The pipeline's stages one by one, each against what its own operator or a brute-force version says."""

from __future__ import annotations

import collections
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import decontaminate, ngrams, quality, segment, suffixes
from siltstone.llm.queries import PIECES
from tests.llm.conftest import words
from tests.llm.test_dedup import brute_components
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, inputs[-1], SF).write.parquet(f"{tmp_path}/{k}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(d.columns == docs.columns for d in inputs[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in inputs]
    report = quality.quality_report(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in report.where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in inputs[1].collect()]
    assert ids[2] == {d for d, _, c in brute_components(rows) if d == c}
    assert ids[3] == ids[2]
    assert suffixes.repeats_report(inputs[3]).agg(F.sum("n_removed")).first()[0] <= suffixes.repeats_report(inputs[2]).agg(F.sum("n_removed")).first()[0]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = decontaminate.digest(decontaminate.hits(inputs[3], bench))
    assert ids[4] == {r.doc_id for r in found.where("NOT contaminated").collect()}
    assert ids[5] == ids[4]
    voc = segment.vocabulary(segment.model_bytes(PIECES))
    for r in inputs[5].collect():
        assert segment.decoded(voc, np.array(r.piece_ids)).decode() == r.text
    assert ngrams.jaccard_report(inputs[2]).where("doc_id <> component_id").count() == 0


def odd(spark):
    """Null and repeated ids, null, empty and long texts, and columns whose names the stages use themselves."""
    rng = random.Random(6)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    near = a[:150] + "#" + a[151:]
    texts = [(1, a), (5, a), (5, b), (5, b), (None, near), (None, c), (None, d), (None, None), (7, ""), (8, words(rng, 40_000)), (9, "short"), (9, "short")]
    schema = "doc_id long, text string, lang string, piece_ids string, _id int, _score double, _body string, _row int, positions string, score double, n_chars long"
    return spark.createDataFrame([(i, t, None, "p", 1, 0.1, "y", 2, "z", 0.5, len(t or "")) for i, t in texts], schema), (a, b, c, d, near)


def test_each_stage_on_odd_rows(spark):
    docs, (a, b, c, d, near) = odd(spark)
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stage(spark, docs, SF) for name, stage in stages.items()}
    for name, x in out.items():
        want = docs.columns if name != "SentencePiece encoding" else [*[k for k in docs.columns if k != "piece_ids"], "piece_ids", "piece_samples"]
        assert x.columns == want, name
        assert {(r._id, r._row, r._body, r._score) for r in x.collect()} <= {(1, 2, "y", 0.1)}, name
    rows = lambda x: collections.Counter((r.doc_id, r.text) for r in x.collect())
    every = rows(docs)
    assert rows(out["quality classifier"]) <= every
    kept = rows(out["n-gram Jaccard join"])
    assert kept == every - collections.Counter([(1, a), (5, a), (5, b), (9, "short")]) and kept[(None, near)] == kept[(5, b)] == 1
    cut = {(r.doc_id, r.text) for r in out["suffix-array dedup"].collect()}
    assert {(1, a), (5, b), (None, near), (None, c), (None, d), (None, None), (7, ""), (9, "short")} <= cut and (5, "") in cut
    assert out["suffix-array dedup"].count() == docs.count()
    assert rows(out["benchmark decontamination"]) == every
    voc = segment.vocabulary(segment.model_bytes(PIECES))
    for r in out["SentencePiece encoding"].collect():
        assert (r.piece_ids is None) == (r.piece_samples is None) == (r.text is None) and (r.text is None or segment.decoded(voc, np.array(r.piece_ids, np.int64)).decode() == r.text)
        drawn = [tuple(s.ids) for s in r.piece_samples or []]
        assert len(set(drawn)) == len(drawn) <= 2 and (r.text is None or (drawn[0] == tuple(r.piece_ids) and all(0 <= s.inclusion <= 1 for s in r.piece_samples)))
        assert all(segment.decoded(voc, np.array(ids, np.int64)).decode() == r.text for ids in drawn) and (len(r.text or "") < 40 or len(drawn) == 2)
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids", "piece_samples"] and out.count() > 0
