"""Embedders that hang, fail, or give other widths."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import Observation

from siltstone.operators import extract


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)


def _got(df):
    return {r.id: (r.embedding, r.error and r.error.split(":")[0], r.provider) for r in df.collect()}


def test_a_hanging_embedder_is_left(spark):
    def hangs(texts):
        time.sleep(60 if any("slow" in t for t in texts) else 0)
        return [[1.0, float(len(t))] for t in texts]

    d = _docs(spark, "a", "slow", None, "ccc")
    began = time.time()
    assert _got(extract.embed(d, "id", "t", hangs, 2, 0.5)) == {0: ([1.0, 1.0], None, 0), 1: (None, "TimeoutError", None), 2: (None, None, None), 3: ([1.0, 3.0], None, 0)}
    second = lambda texts: [[2.0, float(len(t))] for t in texts]
    assert _got(extract.embed(d, "id", "t", hangs, 2, 0.5, 2, second)) == {0: ([2.0, 1.0], None, 1), 1: ([2.0, 4.0], None, 1), 2: (None, None, None), 3: ([1.0, 3.0], None, 0)}
    assert time.time() - began < 40


def test_what_fails_goes_to_the_second(spark):
    def first(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[1.0] for _ in texts]

    def second(texts):
        if "very bad" in texts:
            raise RuntimeError("still bad")
        return [[2.0] for _ in texts]

    counts = Observation()
    out = extract.embed_counts(extract.embed(_docs(spark, "a", "bad", "very bad", None), "id", "t", first, 8, None, 1, second), counts)
    assert _got(out) == {0: ([1.0], None, 0), 1: ([2.0], None, 1), 2: (None, "RuntimeError", None), 3: (None, None, None)}
    assert counts.get == {"embedded": 2, "fell_back": 1, "failed": 1, "without_text": 1}


def test_widths_must_agree(spark):
    with pytest.raises(ValueError, match="dims"):
        extract.embed(_docs(spark, "a"), "id", "t", len, fallback=len)
    wide, none, few = lambda texts: [[1.0] * 3 for _ in texts], lambda texts: [[] for _ in texts], lambda texts: [[1.0, 1.0]][: len(texts) - 1]
    for embedder in (wide, none, few):
        assert _got(extract.embed(_docs(spark, "a", "b"), "id", "t", embedder, dims=2)) == {0: (None, "ValueError", None), 1: (None, "ValueError", None)}
    good = lambda texts: [[0.5, 0.5] for _ in texts]
    assert _got(extract.embed(_docs(spark, "a", "b"), "id", "t", wide, dims=2, fallback=good)) == {0: ([0.5, 0.5], None, 1), 1: ([0.5, 0.5], None, 1)}


def test_no_rows(spark):
    counts = Observation()
    assert extract.embed_counts(extract.embed(_docs(spark, "a").where("id < 0"), "id", "t", len), counts).collect() == []
    assert counts.get == {"embedded": 0, "fell_back": 0, "failed": 0, "without_text": 0}
