"""Stored indexes: exact or of a stated recall, and how much of them a search reads."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import lexicon, search, vectors

TOP = ["q", "id", "score"]


def corpus(spark, n=1500):
    """Documents of frequent words, each with a few rare ones."""
    rng = random.Random(3)
    frequent, rare = ["the", "of", "and", "to", "in"], [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(rng.choices(frequent, k=rng.randint(5, 60)) + rng.choices(rare, k=3))) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, rows[0][1])], "id long, t string").repartition(4)


def test_bm25_from_a_stored_index(spark, tmp_path):
    docs = corpus(spark)
    queries = spark.createDataFrame([(1, "the w7"), (2, "of and the w3 w4 to"), (3, "in"), (4, "absent"), (5, "absent w9 W9")], "q long, text string")
    path = f"file://{tmp_path}/x"
    with pytest.raises(ValueError, match="no index"):
        lexicon.open_lexicon(spark, path)
    lexicon.build(docs, path, "id", "t", per_block=8)
    index = lexicon.open_lexicon(spark, path)
    found = lexicon.search(spark, index, queries, "q", "text")
    want = search.topk(search.bm25_scores(docs, queries, "id", "t", "q", "text"), ["q"], [F.desc("score"), F.asc("id")], 10)
    assert sorted(map(tuple, found.top.select(*TOP, "rank").collect())) == sorted(map(tuple, want.select(*TOP, "rank").collect()))
    with_stop_words = lexicon.search(spark, index, queries.where("q = 1"), "q", "text")
    assert with_stop_words.rows > 150 and with_stop_words.read < 0.25 * with_stop_words.rows  # blocks with the frequent word alone stay unread
    with pytest.raises(ValueError, match="no words"):
        lexicon.search(spark, index, spark.createDataFrame([(1, "?!")], "q long, text string"), "q", "text")


def test_a_search_reads_its_terms_folders_only(spark, tmp_path):
    index = lexicon.build(corpus(spark, 50), f"file://{tmp_path}/x", "id", "t")
    rows = index.rows(spark).where(F.col("bucket").isin(3)).select("term", "n")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "postings" not in plan.split("ReadSchema")[1]


def clustered(spark, n=3000, centres=30, dims=16):
    rng = np.random.default_rng(4)
    c = rng.normal(size=(centres, dims))
    x = c[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, dims))
    return spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "id long, v array<float>").repartition(4)


def test_cells_of_clustered_vectors(spark, tmp_path):
    v = clustered(spark)
    q = v.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    exact = {(r.q, r.id) for r in search.dense_topk(v, q, "id", "v", "q", "qv").collect()}
    near = vectors.nearest(v, q, "id", "v", "q", "qv").select("q", "id", "rank").collect()
    assert {(r.q, r.id) for r in near} == exact and max(r["rank"] for r in near) == 10
    path = f"file://{tmp_path}/x"
    vectors.build(v, path, "id", "v")
    index = vectors.open_index(spark, path)
    assert index.rows(spark).count() == 3000  # every vector is in it
    found, _ = vectors.search(spark, index, q, "id", "v", "q", "qv")
    assert len({(r.q, r.id) for r in found.collect()} & exact) >= 0.9 * len(exact)
    one, share = vectors.search(spark, index, q.limit(1), "id", "v", "q", "qv")
    assert one.count() == 10 and share < 0.25  # the other cells' files aren't read
    everything, share = vectors.search(spark, index, q, "id", "v", "q", "qv", probes=10**6)
    assert share == 1 and {(r.q, r.id) for r in everything.collect()} == exact


def test_cells_of_the_given_vectors(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    exact = {(r.q, r.vec_id) for r in search.dense_topk(v, q, "vec_id", "embedding", "q", "qv").collect()}
    index = vectors.build(v, f"file://{tmp_path}/x", "vec_id", "embedding")
    found, _ = vectors.search(spark, index, q, "vec_id", "embedding", "q", "qv")
    assert len({(r.q, r.vec_id) for r in found.collect()} & exact) >= 0.9 * len(exact)


def test_nearest_by_group_and_threshold(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 0.0], None), (5, [1.0], "a"), (6, None, "a"), (7, [1.0, 1.0], "b")], "id long, v array<double>, g string")
    q = spark.createDataFrame([("x", [2.0, 0.0])], "q string, qv array<double>")
    got = [(r.id, r.score, r.g, r["rank"]) for r in vectors.nearest(v, q, "id", "v", "q", "qv", 1, by="g").orderBy("id").collect()]
    assert got == [(1, 1.0, "a", 1), (4, 0.0, None, 1), (7, 0.707107, "b", 1)]
    assert [r.id for r in vectors.nearest(v, q, "id", "v", "q", "qv", 9, min_score=0.5).orderBy("rank").collect()] == [1, 2, 7]
    assert vectors.nearest(v.limit(0), q, "id", "v", "q", "qv").count() == 0 and vectors.nearest(v, q.limit(0), "id", "v", "q", "qv").count() == 0


def test_postings_are_stored_where_they_are_made(spark, tmp_path, monkeypatch):
    """Postings are not shuffled to be stored, and those of blocks that are read again are shuffled once, as they are stored; scores are cut in the tasks that make them."""
    docs = corpus(spark, 400)
    queries = spark.createDataFrame([(1, "the w7"), (2, "of and the w3 w4 to"), (3, "in")], "q long, text string")
    index = lexicon.build(docs, f"file://{tmp_path}/x", "id", "t", per_block=8)
    rows = index.rows(spark)
    assert rows.columns[:4] == ["term", "block", "n", "top"] and rows.where("n <> size(ids) OR n <> size(tf) OR n <> size(dl)").count() == 0
    tf = rows.select("term", F.explode(F.arrays_zip("ids", "tf", "dl")).alias("p")).select("term", "p.ids", "p.tf", "p.dl").collect()
    want = search.postings(docs, "id", "t").select("term", "id", "tf", "dl").collect()
    assert sorted(map(tuple, tf)) == sorted(map(tuple, want)) and rows.where("n > 8").count() == 0
    found = lexicon.search(spark, index, queries, "q", "text", k=3, first_blocks=1)
    last = found.top._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in last.split("\n") if "Exchange hashpartitioning" in line]
    assert not any("id#" in line for line in exchanged)  # no shuffle by document
    want = search.topk(search.bm25_scores(docs, queries, "id", "t", "q", "text"), ["q"], [F.desc("score"), F.asc("id")], 3)
    assert sorted(map(tuple, found.top.select(*TOP, "rank").collect())) == sorted(map(tuple, want.select(*TOP, "rank").collect()))
    monkeypatch.setattr(lexicon, "BROADCAST_QUERIES", 0)  # the first blocks by a shuffle too
    found = lexicon.search(spark, index, queries, "q", "text", k=3, first_blocks=1)
    assert sorted(map(tuple, found.top.select(*TOP, "rank").collect())) == sorted(map(tuple, want.select(*TOP, "rank").collect()))
