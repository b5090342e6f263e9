"""Retrieval metrics, run comparison, exports of golden data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import normalize_path

METRICS = ["mrr", "precision_at_k", "recall_at_k", "hit_rate", "ndcg", "map"]
STEADY = 0.05


def distinct_paths(paths: Column) -> Column:
    """Normalised paths, the first of equal ones."""
    return F.array_distinct(F.transform(paths, normalize_path))


def _hits(got: Column, want: Column) -> Column:
    return F.transform(got, lambda p: F.array_contains(want, p).cast("int"))


def _share(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def metrics(rows: DataFrame, retrieved: str, expected: str, k: int | None = None) -> DataFrame:
    """The six metrics of each row, exact to 6 places. The reciprocal rank looks at the whole list, the others at its first k paths.

    Precision divides by k even if fewer paths came back. Without expected or retrieved paths every metric is 0.
    """
    x = rows.withColumns({"_got": distinct_paths(F.col(retrieved)), "_want": distinct_paths(F.col(expected))})
    x = x.withColumns({"_all": _hits(F.col("_got"), F.col("_want")), "_n": F.size("_want")})
    return metrics_of_hits(x, "_all", "_n", k).drop("_got", "_want", "_all", "_n")


def metrics_of_hits(rows: DataFrame, hits: str, n_expected: str, k: int | None = None) -> DataFrame:
    """The same from whether each retrieved path is expected (array of 0 and 1, in order) and the number of expected ones, however many they are."""
    kk = F.lit(k) if k is not None else F.size(hits)
    x = rows.withColumns({"_every": F.col(hits), "_k": kk})
    x = x.withColumn("_top", F.slice("_every", 1, F.greatest(F.col("_k"), F.lit(0))))
    n_want, hits = F.col(n_expected), F.aggregate("_top", F.lit(0), lambda s, v: s + v)
    first = F.array_position("_every", 1)
    gain = F.aggregate(F.transform("_top", lambda v, i: v / F.log2(i + 2)), F.lit(0.0), lambda s, v: s + v)
    ideal = F.aggregate(F.transform(F.when(F.least(n_want, F.col("_k")) > 0, F.sequence(F.lit(1), F.least(n_want, F.col("_k")))).otherwise(F.array().cast("array<int>")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda s, v: s + v)
    running = F.transform("_top", lambda v, i: F.when(v == 1, F.aggregate(F.slice("_top", 1, i + 1), F.lit(0), lambda s, y: s + y) / (i + 1)).otherwise(F.lit(0.0)))
    precise = F.aggregate(running, F.lit(0.0), lambda s, v: s + v)
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)).cast("double"), 6)
    x = x.withColumns({
        "mrr": r(F.when(first > 0, 1 / first)), "precision_at_k": r(_share(hits, F.col("_k"))), "recall_at_k": r(_share(hits, n_want)),
        "hit_rate": r((hits > 0).cast("double")), "ndcg": r(_share(gain, ideal)), "map": r(_share(precise, n_want)),
    })
    return x.drop("_every", "_top", "_k")


def macro(rows: DataFrame) -> DataFrame:
    """Means of the six metrics over all rows, 0 if there are none."""
    return rows.agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in METRICS], F.count(F.lit(1)).alias("query_count"))


def trend(runs: DataFrame, by: list[str], order: str, names: list[str], steady: float = STEADY) -> DataFrame:
    """Each run against the one before: metric, value, previous, delta, direction. A change of exactly `steady` is stable."""
    w = Window.partitionBy(*by).orderBy(order)
    x = runs.withColumns({f"_{m}": F.lag(m).over(w) for m in names})
    long = x.select(*by, order, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"_{m}").alias("previous")) for m in names])).alias("m")).select(*by, order, "m.*")
    delta = F.round(F.col("value") - F.col("previous"), 6)
    kind = F.when(F.col("previous").isNull(), "first").when(delta > steady, "improved").when(delta < -steady, "regressed").otherwise("stable")
    return long.withColumn("delta", delta).withColumn("direction", kind)


def run_notes(passed: Column, asked: Column, skipped: Column, filtered: Column) -> Column:
    """Status of a finished run: how many passed, were skipped for want of paths, and were left out by their tags."""
    told = lambda c, text: F.concat(c.cast("string"), F.lit(text))
    some = lambda c, text: F.when(c > 0, told(c, text))
    return F.concat_ws(" | ", F.lit("status:completed"), F.concat(told(passed, "/"), told(asked, " passed")), some(skipped, " skipped (no expectedFilePaths)"), some(filtered, " filtered by tags"))


def with_entries(results: DataFrame, entries: DataFrame, query: str, order: str) -> DataFrame:
    """Each result with the columns of the first golden entry, by `order`, whose query is the same text; null where there is none. Texts are compared as they are; a null query has no entry."""
    rest = [c for c in entries.columns if c not in (query, order)]
    first = entries.where(F.col(query).isNotNull()).groupBy(query).agg(F.min_by(F.struct(*rest), order).alias("_entry"))
    return results.join(first, query, "left").select(*results.columns, *[F.col(f"_entry.{c}").alias(c) for c in rest])


def ragas(rows: DataFrame) -> DataFrame:
    """question, answer (empty), contexts, ground_truths (the answer, then the paths) of rows (query, answer, expected, retrieved); rows without a query are left out."""
    answer = F.when(F.col("answer") != "", F.array("answer")).otherwise(F.array().cast("array<string>"))
    some = rows.where(F.col("query") != "")
    return some.select(F.col("query").alias("question"), F.lit("").alias("answer"), F.col("retrieved").alias("contexts"), F.concat(answer, "expected").alias("ground_truths"))


def deepeval(rows: DataFrame) -> DataFrame:
    """input, actual_output (empty), retrieval_context, expected_output (the answer, or else the paths, or nothing)."""
    expected = F.coalesce(F.when(F.col("answer") != "", F.col("answer")), F.array_join("expected", ", "))
    return rows.where(F.col("query") != "").select(F.col("query").alias("input"), F.lit("").alias("actual_output"), F.col("retrieved").alias("retrieval_context"), expected.alias("expected_output"))


def threshold_gate(rows: DataFrame, targets: dict[str, float]) -> DataFrame:
    """metric, value, target, passed; a null value has a null verdict."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("target")) for m, t in targets.items()])
    return rows.select(F.explode(pairs).alias("t")).select("t.*").withColumn("passed", F.col("value") >= F.col("target"))
