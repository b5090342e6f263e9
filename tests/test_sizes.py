"""Plans, numbers and ranks that came out otherwise, or grew too fast, on larger tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import context, extract, ingest, search
from siltstone.plans import catalog


def test_policy_plan_stays_small(spark):
    """The type of a file stands in the plan a few times, not once for each use of each use of it."""
    d = spark.createDataFrame([(1, "a/b.ts", "x" * 5000), (2, "b.json", "y" * 2000), (3, "c.unknown", "z" * 20)], "id long, path string, t string")
    x = d.withColumn("kind", ingest.file_type(ingest.language(F.col("path"))))
    out = ingest.policy_chunks(x, "id", "t", "kind").select("id", "chunk_index", "total_chunks", "content")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 32
    got = [(r.id, r.chunk_index, r.total_chunks, len(r.content)) for r in out.orderBy("id", "chunk_index").collect()]
    assert got == [(1, 0, 3, 2048), (1, 1, 3, 2048), (1, 2, 3, 5000 - 2 * 1848), (2, 0, 3, 1024), (2, 1, 3, 1024), (2, 2, 3, 2000 - 2 * 924), (3, 0, 1, 20)]


def test_relative_age_counts_parts_of_a_second(spark):
    at = ["2024-01-31 23:00:00", "2024-01-31 23:00:00.4", "2024-01-31 23:59:00.9", "2024-01-28 23:59:59.5", "2024-01-29 00:00:00.000001"]
    d = spark.createDataFrame(list(enumerate(at)), "id int, t string")
    got = [r.age for r in d.select("id", text.relative_age(F.col("t").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).alias("age")).orderBy("id").collect()]
    assert got == ["1 hour ago", "59 minutes ago", "Just now", "3 days ago", "2 days ago"]


def test_fixed_rounds_as_printf(spark):
    rng = random.Random(3)
    some = [0.0, 0.015625, 0.078125, 0.140625, -0.015625, 2.0005, 12.3455, 12.345, 1.005, 2.675, 0.125, 0.375, 0.5, 1.5, 99.995, 0.999999, -0.0000001, 1e-9, 123456.7895, 2e9 + 0.125, 1e8 + 0.015625]
    some += [rng.randrange(1, 10**8) / 10**rng.randrange(3, 8) for _ in range(3000)] + [k / 2**7 for k in range(300)] + [(k + 0.5) / 1000 for k in range(300)]
    d = spark.createDataFrame([(x,) for x in some], "x double")
    for digits in (2, 3, 5):
        for r in d.select("x", text.fixed(F.col("x"), digits).alias("told")).collect():
            assert r.told == f"{r.x:.{digits}f}", r


def test_scores_in_texts_round_as_printf(spark):
    one = [(1, 1, "p", "a.md", 3, 3, 2.0005, "en", "docs", "t")]
    d = spark.createDataFrame(one, "q int, rank int, project string, file_path string, start_line int, end_line int, score double, language string, file_type string, content string")
    assert f'score="{2.0005:.3f}"' in context.xml(d, "q").first().context
    assert context.citations(d.withColumn("score", F.lit(0.125)), "q").first().citations.endswith("(0.12)")


def corpus(spark, n=300):
    rng = random.Random(1)
    words = ["the", "of", "and", *(f"w{k}" for k in range(40))]
    rows = [(k, f"p{k % 3}" if k % 50 else None, " ".join(rng.choices(words[:3], k=rng.randint(1, 30)) + rng.choices(words, k=5))) for k in range(n)]
    docs = spark.createDataFrame([*rows, (n, "p1", None), (n + 1, "p1", ""), *((n + 2 + k, "p2", "the w1 w2") for k in range(40))], "id long, p string, t string").repartition(5)
    return docs, spark.createDataFrame([(1, "the w7"), (2, "of and the w3 w4 to"), (3, "in"), (4, "absent"), (5, "absent w9 W9 W1 w2")], "q long, x string")


@pytest.mark.parametrize("by", [None, "p"])
@pytest.mark.parametrize("small", [False, True])
def test_best_of_batches_are_the_best_of_all(spark, monkeypatch, by, small):
    if small:
        monkeypatch.setattr(search, "QUERY_WORDS", 4)
        monkeypatch.setattr(search, "QUERIES_AT_A_TIME", 2)
        monkeypatch.setattr(search, "PAIRS_AT_A_TIME", 5)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        docs, q = corpus(spark)
        every = search.lexical_scores(docs, q, "id", "t", "q", "x", by)
        best = search.lexical_best(docs, q, "id", "t", "q", "x", 3, ("score", "coverage"), by)
        group = ["q", *([by] if by else [])]
        for c in ("score", "coverage"):
            want, got = (sorted(tuple(r) for r in search.topk(x, group, [F.desc(c), F.asc("id")], 3).select(*group, "id", "score", "coverage", "rank").collect()) for x in (every, best))
            assert got == want and len(got) >= 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_are_not_shuffled(spark):
    """What a query's ranking shuffles grows with the batches, not with the pairs that share a word."""
    docs, q = corpus(spark, 3000)
    best = search.lexical_best(docs, q, "id", "t", "q", "x", 3)
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString() and best.count() <= 5 * 3 * len(best._jdf.inputFiles())
    assert search.lexical_scores(docs, q, "id", "t", "q", "x").count() > 20 * best.count()
    with pytest.raises(ValueError, match="no words"):
        search.lexical_best(docs, spark.createDataFrame([(1, "?!")], "q long, x string"), "id", "t", "q", "x", 3)
    assert search.lexical_best(docs, q.limit(0), "id", "t", "q", "x", 3).count() == 0


def test_hashed_vectors_are_not_shuffled(spark):
    d = spark.createDataFrame([(1, "Some words, some words ñ"), (2, ""), (3, None), (4, "?")], "id long, t string")
    x = extract.embed_hash(d, "id", "t")
    assert "HashAggregate" not in x._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.embedding for r in x.collect()}
    assert got[1] == extract.hashed_vectors(["Some words, some words ñ"])[0].tolist() and got[2] == got[3] == got[4] == [0.0] * 64


@pytest.mark.parametrize("name", ["bm25_topk", "metric_mrr", "context_dedupe", "context_order", "bm25_postfilter", "eval_per_query", "export_deepeval", "metric_precision"])
def test_rankings_pass_on_the_first_of_each_batch(spark, monkeypatch, name):
    """A query over rankings makes no relation of all pairs that share a word, and its result is the one from that relation."""
    best, every, passed = search.lexical_best, search.lexical_scores, []

    def told(docs, queries, *rest):
        out = best(docs, queries, *rest)
        passed.append((out.count(), queries.count() * rest[4] * len(out.inputFiles())))
        return out

    def pairs(*_):
        raise AssertionError("all pairs are made")

    monkeypatch.setattr(search, "lexical_scores", pairs)
    monkeypatch.setattr(search, "lexical_best", told)
    got = catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len(passed) == 1 and passed[0][0] <= passed[0][1]
    monkeypatch.setattr(search, "lexical_best", lambda docs, queries, *rest: every(docs, queries, *rest[:4]))
    assert got and sorted(map(str, got)) == sorted(map(str, catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()))
