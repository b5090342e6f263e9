"""Queries over stored relations, projects and traces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import incremental, store, tables
from siltstone.operators.steps import delete_folder, materialize
from siltstone.plans.registry import CHUNKS, Registry, chunks, table
from siltstone.streaming import progress, sketches
from siltstone.streaming import traces as stream

R = Registry()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}_{uuid.uuid4().hex}"


@R.add("storage_stats", "SELECT count(DISTINCT source) projects, count(*) files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) chars FROM documents")
def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("projects"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@R.add("chunks_per_file", "SELECT source || '/' || lang || '/' || doc_id % 20 file_path, count(*) n FROM documents GROUP BY 1")
def chunks_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 20).cast("string"))
    return table(spark, sf_dir, "documents").groupBy(path.alias("file_path")).agg(F.count(F.lit(1)).alias("n"))


@R.add("distinct_files", f"WITH {CHUNKS} SELECT DISTINCT file_path FROM chunks")
def distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("file_path").distinct()


_PROJECTS = "p AS (SELECT c_custkey id, c_name name, c_mktsegment tag, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(max(o_orderdate) AS VARCHAR) END updated_at, CAST(min(o_orderdate) AS VARCHAR) indexed_at, count(o_orderkey) file_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment)"


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects, their orders as indexing runs."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.min("o_orderdate").alias("first"), F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer")
    show = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tag"), F.when(F.col("c_custkey") % 3 != 0, show("last")).alias("updated_at"), show("first").alias("indexed_at"), F.coalesce("n", F.lit(0)).alias("file_count"))


@R.add("project_list", f"WITH {_PROJECTS} SELECT id, name, coalesce(updated_at, indexed_at, '') sorted_by, file_count FROM p ORDER BY sorted_by DESC, id")
def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projects(spark, sf_dir).withColumn("sorted_by", F.coalesce("updated_at", "indexed_at", F.lit("")))
    return p.select("id", "name", "sorted_by", "file_count").orderBy(F.desc("sorted_by"), "id")


@R.add("project_lookup", "SELECT c_custkey id, c_name name FROM customer WHERE lower(c_name) = lower((SELECT max(c_name) FROM customer)) OR c_custkey = 7")
def project_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = c.agg(F.lower(F.max("c_name")).alias("n")).scalar()
    return c.where((F.lower("c_name") == name) | (F.col("c_custkey") == 7)).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@R.add("latest_project", f"WITH {_PROJECTS} SELECT id, name FROM p ORDER BY coalesce(updated_at, '') DESC, id LIMIT 1")
def latest_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects(spark, sf_dir).orderBy(F.desc(F.coalesce("updated_at", F.lit(""))), "id").limit(1).select("id", "name")


@R.add("project_health", f"WITH {_PROJECTS} SELECT id, concat_ws(', ', CASE WHEN file_count = 0 THEN 'no files' END, CASE WHEN updated_at IS NULL THEN 'never updated' END) issues FROM p")
def project_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects(spark, sf_dir).select("id", F.concat_ws(", ", F.when(F.col("file_count") == 0, "no files"), F.when(F.col("updated_at").isNull(), "never updated")).alias("issues"))


@R.add("project_upsert", """WITH o AS (SELECT c_custkey id, c_name name, c_mktsegment model, c_nationkey dims FROM customer WHERE c_custkey % 4 <> 0), n AS (SELECT c_custkey id, c_name || '!' name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'new' END model, CAST(NULL AS INTEGER) dims FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(o.id, n.id) id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END name, CASE WHEN n.id IS NULL THEN o.model ELSE coalesce(n.model, o.model) END model, CASE WHEN n.id IS NULL THEN o.dims ELSE coalesce(n.dims, o.dims) END dims FROM o FULL JOIN n ON o.id = n.id""")
def project_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 4 <> 0").selectExpr("c_custkey id", "c_name name", "c_mktsegment model", "c_nationkey dims")
    new = c.where("c_custkey % 3 = 0").selectExpr("c_custkey id", "c_name || '!' name", "CASE WHEN c_custkey % 2 <> 0 THEN 'new' END model", "CAST(NULL AS INT) dims")
    return store.upsert(old, new, "id", ["model", "dims"])


@R.add("delete_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What deleting the customers of a segment leaves of their orders' lines."""
    c, o = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), table(spark, sf_dir, "orders")
    gone = o.join(c, o.o_custkey == c.c_custkey, "left_semi")
    return store.without(table(spark, sf_dir, "lineitem"), gone, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@R.add("delete_counts", """WITH g AS (SELECT c_custkey id FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_custkey, o_orderkey FROM orders)
SELECT 'orders' relation, id, count(o_orderkey) n FROM g LEFT JOIN o ON o_custkey = id GROUP BY 2 UNION ALL SELECT 'events', id, count(event_id) FROM g LEFT JOIN events ON user_id = id GROUP BY 2 UNION ALL SELECT 'left', 0, count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL""")
def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with the customers of a segment, counted before, and how many customers are left."""
    c = table(spark, sf_dir, "customer")
    children = {"orders": (table(spark, sf_dir, "orders"), "o_custkey"), "events": (table(spark, sf_dir, "events"), "user_id")}
    left, _, counts = store.delete_parents(c, "c_custkey", c.where("c_mktsegment = 'BUILDING'").select("c_custkey"), children)
    return counts.unionByName(left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("left").alias("relation"), F.lit(0).cast("long").alias("id"), "n"))


@R.add("partial_update", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'X' || c_custkey ELSE c_name END c_name, CASE WHEN c_custkey % 10 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END c_acctbal FROM customer")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    change = c.where("c_custkey % 5 = 0").selectExpr("c_custkey", "'X' || c_custkey c_name", "CASE WHEN c_custkey % 10 = 0 THEN 0.0D END c_acctbal")
    return store.partial_update(c, change, "c_custkey", ["c_name", "c_acctbal"])


@R.add("validate_rows", "SELECT event_id, CASE WHEN NOT (value BETWEEN 0 AND 100) THEN 'value' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'event_type' WHEN user_id < 5 THEN 'user_id' END broken_rule FROM events")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"value": F.col("value").between(0, 100), "event_type": F.col("event_type").isin("click", "view", "purchase"), "user_id": F.col("user_id") >= 5}
    return store.validated(table(spark, sf_dir, "events"), rules).select("event_id", "broken_rule")


@R.add("traces_filter", "SELECT event_id, user_id, CAST(ts AS VARCHAR) ts FROM events WHERE user_id IN (3, 5, 8) AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100")
def traces_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("user_id").isin(3, 5, 8) & (F.col("event_type") == "click"))
    e = e.where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts <= TIMESTAMP_NTZ '2024-01-25'")
    return e.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", F.col("ts").cast("string").alias("ts"))


@R.add("traces_since", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def traces_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days, counted from the newest trace."""
    e = table(spark, sf_dir, "events")
    return e.where(F.col("ts") >= e.agg(F.max("ts")).scalar() - F.expr(store.relative_start("7d"))).select("event_id")


@R.add("trace_sample", "SELECT event_id FROM events WHERE md5(CAST(event_id AS VARCHAR)) < '1999'")
def trace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the traces, the same ones at every run: those whose digest is low."""
    return table(spark, sf_dir, "events").where(F.md5(F.col("event_id").cast("string").cast("binary")) < "1999").select("event_id")


@R.add("trace_tumbling", "SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL")
def trace_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@R.add("trace_session", "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') start, count(*) n FROM s GROUP BY user_id, k")
def trace_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(table(spark, sf_dir, "events"), "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@R.add("trace_sliding", "WITH w AS (SELECT unnest([0, 6, 12, 18]) h), e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(h) start, event_type, value FROM events, w) SELECT CAST(start AS VARCHAR) start, event_type, count(*) n, round(sum(value), 4) total FROM e GROUP BY ALL")
def trace_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sliding(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@R.add("trace_percentiles", "SELECT coalesce(event_type, 'all') event_type, coalesce(CAST(\"day\" AS VARCHAR), 'all') AS \"day\", count(*) n, round(quantile_cont(value, 0.5), 4) p50, round(quantile_cont(value, 0.9), 4) p90, round(quantile_cont(value, 0.99), 4) p99 FROM (SELECT *, CAST(ts AS DATE) AS \"day\" FROM events) GROUP BY ROLLUP (event_type, \"day\")")
def trace_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return stream.latency(e, ["event_type", "day"], "value").withColumns({c: F.coalesce(c, F.lit("all")) for c in ("event_type", "day")})


@R.add("trace_sketches", "SELECT event_type, count(*) n, TRUE p50_close, TRUE p90_close, TRUE users_close FROM events GROUP BY event_type UNION ALL SELECT 'all', count(*), TRUE, TRUE, TRUE FROM events")
def trace_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles and distinct users of each event type and of all, merged from stored sketches of the days, against exact ranks and counts: within 3 percent."""
    e = table(spark, sf_dir, "events")
    days = materialize(sketches.day_sketches(e, ["event_type"], "value", "user_id"), "days")
    found = sketches.merged(days, ["event_type"]).unionByName(sketches.merged(days, []).withColumn("event_type", F.lit("all")))
    both = e.select("event_type", "value", "user_id").unionByName(e.select(F.lit("all").alias("event_type"), "value", "user_id"))
    below = lambda c: F.avg((F.col("value") <= F.col(c)).cast("double"))
    told = both.join(F.broadcast(found), "event_type").groupBy("event_type", "n", "users").agg(below("p50").alias("r50"), below("p90").alias("r90"), F.countDistinct("user_id").alias("exact"))  # a row for each event type
    close = lambda got, want: F.abs(got - want) <= 0.03
    return told.select("event_type", "n", close(F.col("r50"), 0.5).alias("p50_close"), close(F.col("r90"), 0.9).alias("p90_close"), close(F.col("users") / F.col("exact"), 1.0).alias("users_close"))


@R.add("export_conversation", "SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) markdown FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def export_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of each conversation, system turns left out. A conversation bounds its group."""
    part = F.concat(F.lit("## "), F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit("\n\n"), "text")
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("x")))).alias("l"))
    return c.select("conv_id", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("l", lambda r: r["x"]), "\n\n---\n\n")).alias("markdown"))


@R.add("chunk_append", "SELECT source project, count(*) n FROM documents GROUP BY 1")
def chunk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "chunks")
    c = chunks(spark, sf_dir)
    tables.append(c.where("chunk_id % 2 = 0"), path, "project")
    tables.append(c.where("chunk_id % 2 = 1"), path, "project")
    out = materialize(tables.read_table(spark, path).groupBy("project").agg(F.count(F.lit(1)).alias("n")), "appended")
    tables.delete_table(spark, path)
    return out


@R.add("atomic_reindex", """WITH n AS (SELECT * FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 3 = 0), r AS (SELECT source, doc_id, text FROM documents WHERE source NOT IN (SELECT source FROM n) UNION ALL SELECT source, doc_id, text || '!' FROM n)
SELECT source project, count(*) n, CAST(sum(doc_id) AS BIGINT) ids, CAST(sum(length(text)) AS BIGINT) chars, (SELECT count(*) FROM documents WHERE source IN (SELECT source FROM n)) deleted, (SELECT count(*) FROM n) inserted FROM r GROUP BY 1""")
def atomic_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two projects indexed anew with a third of their chunks, changed; all others stay as they were."""
    path = _folder(spark, "chunks")
    c = chunks(spark, sf_dir)
    tables.append(c, path, "project")
    new = c.where("project IN ('src1', 'src2') AND chunk_id % 3 = 0").withColumn("content", F.concat("content", F.lit("!")))
    deleted, inserted = tables.swap_partitions(new, path, "project")
    left = tables.read_table(spark, path).groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_id").alias("ids"), F.sum(F.length("content")).alias("chars"))
    out = materialize(left.withColumns({"deleted": F.lit(deleted).cast("long"), "inserted": F.lit(inserted).cast("long")}), "reindexed")
    tables.delete_table(spark, path)
    return out


@R.add("incremental_reindex", """WITH o AS (SELECT 'd' || doc_id file, text FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT 'd' || doc_id file, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'more' ELSE text END text FROM documents WHERE doc_id % 11 <> 0),
s AS (SELECT coalesce(o.file, n.file) file, CASE WHEN o.file IS NULL THEN 'new' WHEN n.file IS NULL THEN 'deleted' WHEN o.text <> n.text THEN 'changed' ELSE 'same' END status FROM o FULL JOIN n ON o.file = n.file),
l AS (SELECT file, unnest(string_split(text, chr(10))) line FROM n), c AS (SELECT file, count(*) chunks, CAST(sum(length(line)) AS BIGINT) chars, md5(string_agg(md5(line), ',' ORDER BY md5(line))) digest FROM l WHERE length(trim(line, ' ')) > 0 GROUP BY 1)
SELECT n.file, s.status, coalesce(chunks, 0) chunks, coalesce(chars, 0) chars, coalesce(digest, '') digest, (SELECT count(*) FROM s WHERE status IN ('new', 'changed')) chunked_again, (SELECT count(*) FROM s WHERE status = 'deleted') deleted FROM n JOIN s USING (file) LEFT JOIN c USING (file)""")
def incremental_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents indexed by line, then a later snapshot of which only what changed is cut into chunks anew."""
    path = _folder(spark, "index")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("content"))
    incremental.reindex(d.where("doc_id % 10 <> 0").select("file", "content"), path, _lines)
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("\nmore"))).otherwise(F.col("content"))
    done = incremental.reindex(d.where("doc_id % 11 <> 0").select("file", edited.alias("content")), path, _lines)
    files = incremental.indexed_chunks(spark, path, with_files=True).groupBy("file").agg(F.count("content").alias("chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars"), F.when(F.count("content") > 0, F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("content"))), ",").cast("binary"))).otherwise("").alias("digest"))
    out = files.join(done.status.where("status <> 'deleted'"), "file").withColumns({"chunked_again": F.lit(done.new + done.changed).cast("long"), "deleted": F.lit(done.deleted).cast("long")})
    out = materialize(out.select("file", "status", "chunks", "chars", "digest", "chunked_again", "deleted"), "incremental")
    tables.delete_table(spark, path)
    return out


def _lines(files: DataFrame) -> DataFrame:
    """(file, chunk_no, content): each line that isn't blank."""
    return files.select("file", F.posexplode(F.split("content", "\n")).alias("chunk_no", "content")).where(F.length(F.trim("content")) > 0)


@R.add("run_append", """WITH e AS (SELECT event_type, user_id % 10 project, CAST(ts AS DATE) d, value FROM events WHERE user_id IS NOT NULL AND value BETWEEN 0 AND 100)
SELECT CAST(project AS VARCHAR) project, count(DISTINCT d) runs, count(DISTINCT (d, event_type)) results, (SELECT count(*) FROM events WHERE user_id IS NULL OR value IS NULL OR NOT value BETWEEN 0 AND 100) refused FROM e GROUP BY 1""")
def run_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of traces as evaluation runs, and what each measured as its results: stored in two tables, rows that break a rule refused."""
    rules = {"user_id": F.col("user_id").isNotNull(), "value": F.col("value").between(0, 100)}
    e = store.validated(table(spark, sf_dir, "events"), rules)
    good = e.where("broken_rule IS NULL").select((F.col("user_id") % 10).cast("string").alias("project"), F.to_date("ts").alias("day"), "event_type", (F.col("value") / 100).alias("score"))
    runs, results = _folder(spark, "runs"), _folder(spark, "results")
    store.append_valid(good.groupBy("project", "day").agg(F.avg("score").alias("score")), runs, "project", {"score": F.col("score").between(0, 1)})
    store.append_valid(good.groupBy("project", "day", F.col("event_type").alias("metric")).agg(F.avg("score").alias("value")), results, "project", {"metric": F.col("metric").isNotNull(), "value": F.col("value").between(0, 1)})
    n = lambda path, name: tables.read_table(spark, path).groupBy("project").agg(F.count(F.lit(1)).alias(name))
    told = n(runs, "runs").join(n(results, "results"), "project").withColumn("refused", e.agg(F.count_if(F.col("broken_rule").isNotNull())).scalar())
    out = materialize(told, "runs")
    for path in (runs, results):
        tables.delete_table(spark, path)
    return out


@R.add("trace_append", "SELECT event_type, count(*) n FROM events GROUP BY 1")
def trace_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files, appended to a table batch by batch."""
    path, checkpoint = _folder(spark, "traces"), _folder(spark, "checkpoint")
    stream.ingest(_stream(spark, sf_dir), path, checkpoint, "event_type").awaitTermination()
    out = materialize(spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "traces")
    for folder in (path, checkpoint):
        delete_folder(spark, folder)
    return out



def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")


@R.add("trace_fates", "SELECT event_type, fate, count(*) n FROM (SELECT event_type, 'new' fate FROM events UNION ALL SELECT event_type, 'repeat' FROM events WHERE event_id % 7 = 0) GROUP BY ALL")
def trace_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream in which every seventh trace comes twice: what became of each."""
    path, checkpoint = _folder(spark, "fates"), _folder(spark, "checkpoint")
    e = _stream(spark, sf_dir)
    twice = e.union(_stream(spark, sf_dir).where("event_id % 7 = 0"))
    progress.started(stream.appender(progress.fates(twice, "event_id"), path, checkpoint, "fate"), spark).awaitTermination()
    out = materialize(spark.read.parquet(path).groupBy("event_type", "fate").agg(F.count(F.lit(1)).alias("n")), "fates")
    for folder in (path, checkpoint):
        delete_folder(spark, folder)
    return out


_HOUR = 3_600_000


@R.add("trace_progress", f"""WITH e AS (SELECT user_id, ts, epoch_ms(ts) // {6 * _HOUR} * {6 * _HOUR} + {6 * _HOUR} at_ms FROM events WHERE user_id IS NOT NULL), w AS (SELECT max(epoch_ms(ts)) - {_HOUR} mark FROM e),
t AS (SELECT user_id, at_ms, count(*) n FROM e WHERE at_ms <= (SELECT mark FROM w) GROUP BY ALL),
p AS (SELECT *, lag(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms) prior FROM t),
q AS (SELECT *, sum(CASE WHEN at_ms - {6 * _HOUR} - prior <= {24 * _HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY at_ms) run FROM p),
g AS (SELECT q.*, 20 + CAST(floor(abs(c_acctbal) / 100) AS BIGINT) goal, sum(n) OVER (PARTITION BY user_id, run ORDER BY at_ms) processed, row_number() OVER (PARTITION BY user_id, run ORDER BY at_ms) k, row_number() OVER (PARTITION BY user_id, run ORDER BY at_ms DESC) b,
 list(CASE WHEN at_ms - {6 * _HOUR} - prior <= {24 * _HOUR} THEN n * 1000.0::DOUBLE / (at_ms - prior) END) OVER (PARTITION BY user_id, run ORDER BY at_ms ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) l FROM q LEFT JOIN customer ON c_custkey = user_id),
r AS (SELECT *, CASE WHEN k > 1 THEN list_reduce(list_filter(l, lambda x: x IS NOT NULL), lambda s, v: 0.3::DOUBLE * v + 0.7::DOUBLE * s) ELSE 0.0::DOUBLE END rate FROM g)
SELECT user_id, at_ms, CASE WHEN goal IS NULL OR processed < goal THEN 'running' ELSE 'done' END status, CAST(processed AS BIGINT) processed, round(rate, 9) rate, CASE WHEN goal > processed AND rate > 0 THEN CAST(ceil((goal - processed) / rate) AS BIGINT) END eta FROM r
UNION ALL SELECT user_id, at_ms + {24 * _HOUR}, 'stalled', CAST(processed AS BIGINT), 0.0, NULL FROM r WHERE b = 1 AND at_ms + {30 * _HOUR} <= (SELECT mark FROM w) """)
def trace_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream: each user's progress by six hours towards a goal that comes from customer, and where it stalls for a day."""
    path, checkpoint = _folder(spark, "progress"), _folder(spark, "checkpoint")
    goals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (20 + F.floor(F.abs("c_acctbal") / 100)).alias("goal"))
    found = progress.progress(_stream(spark, sf_dir), "user_id", goals, tick="6 hours", idle="1 day", late="1 hour")
    progress.started(found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True), spark).awaitTermination()
    out = materialize(spark.read.parquet(path).withColumn("rate", F.round("rate", 9)), "progress")
    for folder in (path, checkpoint):
        delete_folder(spark, folder)
    return out
