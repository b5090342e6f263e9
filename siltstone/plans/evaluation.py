"""Queries over evaluation: golden data, metrics, runs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import evaluate as E
from siltstone.operators import search as S
from siltstone.operators.steps import materialize, work_dir
from siltstone.operators.store import read_golden, save_golden, write_json
from siltstone.plans.registry import Registry, chunks, table
from siltstone.plans.search import _BM25, bm25_top, few

R = Registry()
K = 5


def holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, chunk_id): the documents that contain a benchmark item's text."""
    return S.holders(chunks(spark, sf_dir), table(spark, sf_dir, "benchmark"), "chunk_id", "content", "item_id", "text")


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items and the paths of the documents that contain their text, as a golden dataset holds them: in one row for each item."""
    paths = chunks(spark, sf_dir).select("chunk_id", "file_path").join(holding(spark, sf_dir), "chunk_id")
    hit = paths.groupBy("item_id").agg(F.array_sort(F.collect_list("file_path")).alias("expected"))
    return table(spark, sf_dir, "benchmark").join(hit, "item_id", "left").select("item_id", "text", F.coalesce("expected", F.array().cast("array<string>")).alias("expected"))


def top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, chunk_id, rank) of the ten best documents by BM25."""
    return bm25_top(spark, sf_dir, 10).select("item_id", "chunk_id", "rank")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and the paths of the ten best documents by BM25, best first."""
    paths = chunks(spark, sf_dir).select("chunk_id", "file_path").join(few(spark, sf_dir, top_ten(spark, sf_dir), 10), "chunk_id")
    return paths.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda r: r["file_path"]).alias("retrieved"))


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, expected, and the paths of the ten best documents by BM25."""
    return golden(spark, sf_dir).join(listed(spark, sf_dir), "item_id", "left").select("item_id", "text", "expected", F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, hits (whether each of the ten best documents is expected, in order) and n, the number of expected ones: counted, never listed."""
    pairs = materialize(holding(spark, sf_dir), "golden")
    n = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    marked = top_ten(spark, sf_dir).join(pairs.withColumn("hit", F.lit(1)), ["item_id", "chunk_id"], "left")
    hits = marked.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("hit", F.lit(0)).alias("hit")))), lambda r: r["hit"]).alias("hits"))
    items = table(spark, sf_dir, "benchmark").select("item_id").join(n, "item_id", "left").join(hits, "item_id", "left")
    return items.select("item_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.array().cast("array<int>")).alias("hits"))


_GOLD = "gold AS (SELECT item_id, chunk_id, lower(file_path) p FROM benchmark, chunks WHERE contains(content, text)), want AS (SELECT item_id, count(DISTINCT p) n FROM gold GROUP BY 1)"
_EVAL = f"""{_BM25}, top AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) rank FROM bm),
{_GOLD},
r AS (SELECT top.item_id, top.rank, CASE WHEN gold.chunk_id IS NULL THEN 0 ELSE 1 END rel FROM top LEFT JOIN gold USING (item_id, chunk_id) WHERE top.rank <= 10),
run AS (SELECT *, sum(rel) OVER (PARTITION BY item_id ORDER BY rank) hits FROM r),
m AS (SELECT b.item_id, coalesce(n, 0) n,
  round(coalesce(max(CASE WHEN rel = 1 THEN 1.0::DOUBLE / rank END), 0), 6) mrr,
  round(coalesce(sum(rel) FILTER (WHERE rank <= {K}), 0) / {K}.0::DOUBLE, 6) precision_at_k,
  round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE coalesce(sum(rel) FILTER (WHERE rank <= {K}), 0) / n::DOUBLE END, 6) recall_at_k,
  round(CASE WHEN coalesce(sum(rel) FILTER (WHERE rank <= {K}), 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 6) hit_rate,
  round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE coalesce(sum(rel / log2(rank + 1)) FILTER (WHERE rank <= {K}), 0) / list_sum(list_transform(range(1, least(n, {K}) + 1), lambda i: 1 / log2(i + 1))) END, 6) ndcg,
  round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE coalesce(sum(hits / rank::DOUBLE) FILTER (WHERE rel = 1 AND rank <= {K}), 0) / n::DOUBLE END, 6) map
  FROM benchmark b LEFT JOIN want USING (item_id) LEFT JOIN run USING (item_id) GROUP BY b.item_id, n)"""


def per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics_of_hits(judged(spark, sf_dir), "hits", "n", K)


def _metric(name: str, key: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return per_query(spark, sf_dir).select("item_id", key)

    R.add(name, f"WITH {_EVAL} SELECT item_id, {key} FROM m")(run)


for _name, _key in [("metric_mrr", "mrr"), ("metric_precision", "precision_at_k"), ("metric_recall", "recall_at_k"), ("metric_hit_rate", "hit_rate"), ("metric_ndcg", "ndcg"), ("metric_map", "map")]:
    _metric(_name, _key)


@R.add("eval_per_query", f"WITH {_EVAL} SELECT item_id, mrr, precision_at_k, recall_at_k, hit_rate, hit_rate = 1 passed FROM m")
def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_query(spark, sf_dir).select("item_id", "mrr", "precision_at_k", "recall_at_k", "hit_rate", (F.col("hit_rate") == 1).alias("passed"))


@R.add("eval_aggregate", f"WITH {_EVAL} SELECT " + ", ".join(f"round(coalesce(avg({m}), 0), 6) {m}" for m in E.METRICS) + ", count(*) query_count FROM m WHERE n > 0")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro(per_query(spark, sf_dir).where("n > 0"))


@R.add("eval_run_summary", f"WITH {_EVAL}, k AS (SELECT * FROM m WHERE item_id % 7 <> 3) SELECT 'status:completed | ' || count(*) FILTER (WHERE n > 0 AND hit_rate = 1) || '/' || count(*) FILTER (WHERE n > 0) || ' passed' || CASE WHEN count(*) FILTER (WHERE n = 0) > 0 THEN ' | ' || count(*) FILTER (WHERE n = 0) || ' skipped (no expectedFilePaths)' ELSE '' END || ' | ' || (SELECT count(*) FROM benchmark WHERE item_id % 7 = 3) || ' filtered by tags' notes FROM k")
def eval_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all items but those with the tag `slow`, which every seventh item has."""
    some, kept = F.col("n") > 0, F.col("item_id") % 7 != 3
    x = per_query(spark, sf_dir).agg(F.count_if(kept & some & (F.col("hit_rate") == 1)).alias("passed"), F.count_if(kept & some).alias("asked"), F.count_if(kept & ~some).alias("skipped"), F.count_if(~kept).alias("filtered"))
    return x.select(E.run_notes(*map(F.col, ("passed", "asked", "skipped", "filtered"))).alias("notes"))


@R.add("eval_hits", f"WITH {_EVAL} SELECT item_id, CAST(sum(rel) AS BIGINT) hits FROM r GROUP BY item_id")
def eval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).where(F.size("hits") > 0).select("item_id", F.aggregate("hits", F.lit(0), lambda s, v: s + v).cast("long").alias("hits"))


@R.add("threshold_gate", f"WITH {_EVAL}, a AS (SELECT round(avg(mrr), 6) mrr, round(avg(hit_rate), 6) hit_rate, round(avg(precision_at_k), 6) precision_at_k FROM m WHERE n > 0) SELECT metric, value, target, value >= target passed FROM (SELECT 'mrr' metric, mrr AS value, 0.7::DOUBLE target FROM a UNION ALL SELECT 'hit_rate', hit_rate, 0.85 FROM a UNION ALL SELECT 'precision_at_k', precision_at_k, 0.6 FROM a)")
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.threshold_gate(eval_aggregate(spark, sf_dir), {"mrr": 0.7, "hit_rate": 0.85, "precision_at_k": 0.6})


_MESSY = "(['./SRC/', '\\src\\', 'src//', '/Src/'])[doc_id % 4 + 1] || lang || '//' || doc_id % 50 || '.ts'"
_NORM = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim({0}), '\\', '/'), '/+', '/', 'g'), '^\\./', ''), '^/', ''), '/$', ''))"


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    start = F.get(F.array(F.lit("./SRC/"), F.lit("\\src\\"), F.lit("src//"), F.lit("/Src/")), (F.col("doc_id") % 4).cast("int"))
    return d.select("doc_id", "source", F.concat(start, "lang", F.lit("//"), (F.col("doc_id") % 50).cast("string"), F.lit(".ts")).alias("path"))


@R.add("normalize_path", f"SELECT doc_id, {_NORM.format(_MESSY)} path FROM documents")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messy(spark, sf_dir).select("doc_id", E.normalize_path(F.col("path")).alias("path"))


@R.add("dedupe_paths", f"WITH x AS (SELECT source, doc_id, {_NORM.format(_MESSY)} p FROM documents), f AS (SELECT source, p, min(doc_id) o FROM x GROUP BY ALL) SELECT source, string_agg(p, ',' ORDER BY o) paths, count(*) n FROM f GROUP BY source")
def dedupe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal normalised paths, in order. Paths are made distinct before they meet in a list."""
    x = _messy(spark, sf_dir).groupBy("source", E.normalize_path(F.col("path")).alias("p")).agg(F.min("doc_id").alias("o"))
    x = x.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("o", "p"))).alias("l"))
    return x.select("source", F.array_join(F.transform("l", lambda r: r["p"]), ",").alias("paths"), F.size("l").cast("long").alias("n"))


_RUNS = "runs AS (SELECT user_id % 10 project, CAST(ts AS DATE) AS \"day\", round(avg(value), 6) score, round(avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) click_rate, count(*) n FROM events GROUP BY ALL)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by project and day as evaluation runs with two metrics."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 10).alias("project"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("score"), F.round(F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)), 6).alias("click_rate"), F.count(F.lit(1)).alias("n"))


_TREND = f"""WITH {_RUNS}, l AS (SELECT *, lag(score) OVER w ps, lag(click_rate) OVER w pc FROM runs WINDOW w AS (PARTITION BY project ORDER BY "day")),
u AS (SELECT project, "day", 'score' metric, score AS value, ps previous FROM l UNION ALL SELECT project, "day", 'click_rate', click_rate, pc FROM l),
t AS (SELECT *, round(value - previous, 6) delta FROM u),
x AS (SELECT *, CASE WHEN previous IS NULL THEN 'first' WHEN delta > 0.05 THEN 'improved' WHEN delta < -0.05 THEN 'regressed' ELSE 'stable' END direction FROM t)"""


@R.add("eval_trend", f'{_TREND} SELECT project, CAST("day" AS VARCHAR) AS "day", metric, value, previous, delta, direction FROM x')
def eval_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trend(runs(spark, sf_dir), ["project"], "day", ["score", "click_rate"]).withColumn("day", F.col("day").cast("string"))


@R.add("eval_regressions", f"{_TREND} SELECT project, CAST(\"day\" AS VARCHAR) AS \"day\", metric, delta FROM x WHERE direction = 'regressed'")
def eval_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_trend(spark, sf_dir).where("direction = 'regressed'").select("project", "day", "metric", "delta")


@R.add("compare_runs", f"{_TREND} SELECT project, count(*) FILTER (WHERE direction = 'improved') improved, count(*) FILTER (WHERE direction = 'regressed') regressed, count(*) FILTER (WHERE direction = 'stable') stable FROM x GROUP BY project")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_trend(spark, sf_dir).groupBy("project").agg(*[F.count_if(F.col("direction") == d).alias(d) for d in ("improved", "regressed", "stable")])


@R.add("recent_runs", f'WITH {_RUNS} SELECT project, CAST("day" AS VARCHAR) AS "day", score, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY "day" DESC) rank FROM runs) WHERE rank <= 10')
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.topk(runs(spark, sf_dir), ["project"], [F.desc("day")], 10).select("project", F.col("day").cast("string").alias("day"), "score", "rank")


@R.add("judge_mean", "SELECT event_type metric, round(avg(value), 4) mean, count(*) n FROM events GROUP BY 1")
def judge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


_LISTED = f"{_EVAL.replace('WITH ', '')}, got AS (SELECT item_id, list(file_path ORDER BY rank) files FROM top JOIN chunks USING (chunk_id) WHERE rank <= 10 GROUP BY 1), exp AS (SELECT item_id, list(file_path ORDER BY file_path) paths FROM gold JOIN chunks USING (chunk_id) GROUP BY 1)"


#: Every third item has an answer of its own.
_ANSWER = "CASE WHEN item_id % 3 = 0 THEN 'Answer ' || item_id ELSE '' END"


def _exported(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """The export of results, each with the first golden entry of the same query, written as JSON below folders that don't exist yet and read back."""
    answer = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Answer "), F.col("item_id").cast("string"))).otherwise("").alias("answer")
    entries = golden(spark, sf_dir).select("item_id", F.col("text").alias("query"), answer, "expected")
    results = table(spark, sf_dir, "benchmark").join(listed(spark, sf_dir), "item_id", "left").select(F.col("text").alias("query"), F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"))
    rows = E.with_entries(results, entries, "query", "item_id")
    path = f"{work_dir(spark, name)}/exports/{name}"
    out = make(rows)
    write_json(out, path)
    return spark.read.schema(out.schema).json(path)


@R.add("export_ragas", f"WITH {_LISTED} SELECT text question, '' answer, array_to_string(coalesce(files, []), ',') contexts, array_to_string(list_concat(CASE WHEN first % 3 = 0 THEN [{_ANSWER.replace('item_id', 'first')}] ELSE [] END, coalesce(paths, [])), ',') ground_truths FROM benchmark b JOIN (SELECT text, min(item_id) first FROM benchmark GROUP BY 1) f USING (text) LEFT JOIN got USING (item_id) LEFT JOIN exp ON exp.item_id = first WHERE text <> ''")
def export_ragas(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _exported(spark, sf_dir, "ragas", E.ragas)
    return x.select("question", "answer", F.array_join("contexts", ",").alias("contexts"), F.array_join("ground_truths", ",").alias("ground_truths"))


@R.add("export_deepeval", f"WITH {_LISTED} SELECT text AS input, '' actual_output, array_to_string(coalesce(files, []), ',') retrieval_context, CASE WHEN first % 3 = 0 THEN {_ANSWER.replace('item_id', 'first')} ELSE coalesce(array_to_string(paths, ', '), '') END expected_output FROM benchmark b JOIN (SELECT text, min(item_id) first FROM benchmark GROUP BY 1) f USING (text) LEFT JOIN got USING (item_id) LEFT JOIN exp ON exp.item_id = first WHERE text <> ''")
def export_deepeval(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _exported(spark, sf_dir, "deepeval", E.deepeval)
    return x.select("input", "actual_output", F.array_join("retrieval_context", ",").alias("retrieval_context"), "expected_output")


@R.add("golden_capture", "SELECT min(conv_id) conv_id, lower(text) query FROM conversations WHERE role = 'user' AND lower(text) NOT IN (SELECT lower(text) FROM benchmark) GROUP BY 2")
def golden_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that are no golden query yet, each text once."""
    seen = table(spark, sf_dir, "benchmark").select(F.lower("text").alias("query"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.lower("text").alias("query")).agg(F.min("conv_id").alias("conv_id"))
    return asked.join(seen, "query", "left_anti").select("conv_id", "query")


@R.add("golden_by_tag", "SELECT item_id, array_to_string(tags, ',') tags FROM (SELECT item_id, [(['auth','api','db'])[item_id % 3 + 1], (['fast','slow'])[item_id % 2 + 1]] tags FROM benchmark) WHERE list_has_any(tags, ['auth', 'slow'])")
def golden_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda v: F.get(F.array(*map(F.lit, v)), (F.col("item_id") % len(v)).cast("int"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array(pick(["auth", "api", "db"]), pick(["fast", "slow"])).alias("tags"))
    return b.where(F.arrays_overlap("tags", F.array(F.lit("auth"), F.lit("slow")))).select("item_id", F.array_join("tags", ",").alias("tags"))


@R.add("golden_load", f"WITH {_EVAL} SELECT 'documents' \"projectName\", CAST(item_id AS VARCHAR) id, text query, CAST(coalesce(c, 0) AS INTEGER) n_expected, 'generated' \"source\" FROM benchmark LEFT JOIN (SELECT item_id, count(*) c FROM gold GROUP BY 1) USING (item_id)")
def golden_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved as a golden dataset, an entry a line, and loaded again; a set that was never saved is empty."""
    g = golden(spark, sf_dir).select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.col("expected").alias("expectedFilePaths"), F.lit("generated").alias("source"))
    path = f"{work_dir(spark, 'golden')}/sets/documents"
    save_golden(g, "documents", path)
    both = read_golden(spark, path, lines=True).unionByName(read_golden(spark, f"{path}-absent", lines=True))
    return both.select("projectName", "id", "query", F.size("expectedFilePaths").alias("n_expected"), "source")
