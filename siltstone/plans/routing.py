"""Queries over routing, context assembly, citations and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import context as C
from siltstone.operators import lookup as L
from siltstone.operators import routing as Q
from siltstone.operators import search as S
from siltstone.operators.steps import hinted
from siltstone.plans.registry import CHUNKS, Registry, chunks, table
from siltstone.plans.search import _BM25, bm25_top, few

R = Registry()

#: A question ends each conversation turn, whose own text goes before it: a third name sources, others hold phrases.
_QUESTIONS = ["How does {} work?", "Compare {} and src2 please", "Where is it?", "What is in this repo?", "Explain differences between all", "hello there", "Tell me about plain things"]
PROJECTS = ["src1", "src2", "src3", "src10"]
_SQL = f"ask AS (SELECT conv_id, turn, text || ' ' || replace(({_QUESTIONS})[(conv_id * 3 + turn) % 7 + 1], '{{}}', 'SRC' || (conv_id % 4 + 1)) q FROM conversations)".replace('"', "'")
_HAS = lambda phrases: "list_filter([" + ", ".join(f"'{p}'" for p in phrases) + "], lambda p: contains(lower(q), p))"
_NAMED = "list_filter([" + ", ".join(f"'{p}'" for p in PROJECTS) + "], lambda p: regexp_matches(lower(q), '\\b' || p || '\\b'))"
_FEATURES = f"{_SQL}, f AS (SELECT *, {_NAMED} named, {_HAS(Q.SEVERAL)} several, {_HAS(Q.CURRENT)} cur FROM ask)"
_INTENT = """i AS (SELECT *, CASE WHEN len(named) >= 2 THEN 'MULTI_PROJECT' WHEN len(several) > 0 AND len(named) > 0 THEN 'MULTI_PROJECT' WHEN len(named) = 1 THEN 'SINGLE_PROJECT' WHEN len(cur) > 0 THEN 'SINGLE_PROJECT' ELSE 'GENERAL' END intent,
CASE WHEN len(named) >= 2 THEN 0.95::DOUBLE WHEN len(several) > 0 AND len(named) > 0 THEN 0.85 WHEN len(named) = 1 THEN 0.9 WHEN len(cur) > 0 THEN 0.85 WHEN len(several) > 0 THEN 0.6 ELSE 0.5 END confidence FROM f)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    q = F.get(F.array(*map(F.lit, _QUESTIONS)), ((F.col("conv_id") * 3 + F.col("turn")) % 7).cast("int"))
    return c.select("conv_id", "turn", "text", F.concat("text", F.lit(" "), F.replace(q, F.lit("{}"), F.concat(F.lit("SRC"), (F.col("conv_id") % 4 + 1).cast("string")))).alias("q"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("_low")
    names = F.array(*map(F.lit, PROJECTS))
    x = asked(spark, sf_dir).withColumn("_low", F.lower("q"))
    return x.withColumns({"named": Q.mentions(low, names, lowered=True), "several": Q.contained(low, Q.SEVERAL, lowered=True), "cur": Q.contained(low, Q.CURRENT, lowered=True)}).drop("_low")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, sure = Q.intent(F.size("named"), F.size("several"), F.size("cur"))
    return features(spark, sf_dir).withColumns({"intent": kind, "confidence": sure})


@R.add("route_features", f"WITH {_FEATURES} SELECT conv_id, turn, array_to_string(named, ',') named, array_to_string(several, ',') several, len(cur) > 0 has_current, CAST(len(regexp_split_to_array(trim(q), '\\s+')) AS INTEGER) word_count FROM f")
def route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("conv_id", "turn", F.array_join("named", ",").alias("named"), F.array_join("several", ",").alias("several"), (F.size("cur") > 0).alias("has_current"), F.size(F.split(F.trim("q"), r"\s+")).alias("word_count"))


@R.add("route_intent", f"WITH {_FEATURES}, {_INTENT} SELECT conv_id, turn, intent, confidence FROM i")
def route_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents(spark, sf_dir).select("conv_id", "turn", "intent", "confidence")


@R.add("detect_projects", f"WITH {_SQL}, names AS (SELECT DISTINCT source project FROM documents) SELECT conv_id, turn, project FROM ask JOIN names ON regexp_matches(lower(q), '\\b' || lower(project) || '\\b')")
def detect_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projects of the table that each question names."""
    names = chunks(spark, sf_dir).select("project").where("project IS NOT NULL").distinct()
    return L.mentioned(asked(spark, sf_dir).select("conv_id", "turn", "q"), names, "q", "project").select("conv_id", "turn", "project")


#: What a model replied about each turn: good and unsure ones, ids that aren't known, braces that don't parse, no braces, no reply.
_REPLIES = ['Sure: {{"projectIds": ["src2", "nope{0}"], "confidence": 0.8}} ok', '{{"projectIds": ["src1", "src3"], "confidence": 0.{1}}}', '{{"projectIds": ["nope{0}"], "confidence": 0.9}}', '{{broken {0}', 'I would say src{0}', '{{"projectIds": [], "confidence": 0.99}}']


def _reply_sql() -> str:
    made = ", ".join("'" + r.replace("'", "''").replace("{{", "{").replace("}}", "}").replace("{0}", "' || turn || '").replace("{1}", "' || (conv_id % 10) || '") + "'" for r in _REPLIES)
    return f"CASE WHEN (conv_id + turn) % 7 = 6 THEN NULL ELSE left(text, 20) || ({'[' + made + ']'})[(conv_id + turn) % 7 + 1] END"


_SPOKEN = f"""x AS (SELECT conv_id, turn, {_reply_sql()} reply FROM conversations),
j AS (SELECT *, CASE WHEN json_valid(nullif(regexp_extract(reply, '\\{{[^}}]*\\}}'), '')) THEN regexp_extract(reply, '\\{{[^}}]*\\}}') END j FROM x),
p AS (SELECT *, list_filter(CAST(json_extract_string(j, '$.projectIds[*]') AS VARCHAR[]), lambda i: i IN ('src1', 'src2', 'src3', 'src10')) rids FROM j),
said AS (SELECT conv_id, turn, reply, rids, CASE WHEN j IS NULL THEN NULL WHEN len(rids) > 0 THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE) ELSE 0.0 END sure FROM p)"""
_ROUTE = f"""{_FEATURES}, {_INTENT}, {_SPOKEN}, h AS (SELECT i.*, rids, sure, CASE WHEN conv_id % 2 = 0 THEN 'src9' END here FROM i JOIN said USING (conv_id, turn)),
d AS (SELECT *, CASE WHEN intent = 'SINGLE_PROJECT' AND len(named) > 0 THEN named WHEN intent = 'SINGLE_PROJECT' AND here IS NOT NULL THEN [here] WHEN intent = 'MULTI_PROJECT' THEN CASE WHEN len(named) > 0 THEN named ELSE ['src1', 'src2', 'src3', 'src10'] END END ruled FROM h),
r AS (SELECT conv_id, turn, CASE WHEN ruled IS NOT NULL THEN ruled WHEN sure >= 0.7 AND len(rids) > 0 THEN rids ELSE ['src1', 'src2', 'src3', 'src10'] END ids,
CASE WHEN ruled IS NOT NULL THEN 'heuristic' WHEN sure >= 0.7 AND len(rids) > 0 THEN 'llm' ELSE 'fallback_all' END "method",
CASE WHEN ruled IS NOT NULL THEN confidence ELSE coalesce(sure, 0.5::DOUBLE) END confidence FROM d)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn and what a model replied; a turn's text leads the reply."""
    parts = [[F.lit(x) for x in r.replace("{{", "{").replace("}}", "}").split("{0}")] for r in _REPLIES]
    digit = (F.col("conv_id") % 10).cast("string")
    made = [F.replace(F.concat(*[x for k, v in enumerate(p) for x in ((F.col("turn").cast("string"), v) if k else (v,))]), F.lit("{1}"), digit) for p in parts]
    k = (F.col("conv_id") + F.col("turn")) % 7
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(k < 6, F.concat(F.substring("text", 1, 20), F.get(F.array(*made), k.cast("int")))).alias("reply"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, and for general questions the model's replies, which are joined in."""
    here = F.when(F.col("conv_id") % 2 == 0, F.lit("src9"))
    every = F.array(*map(F.lit, PROJECTS))
    ids, method, sure = Q.route(F.col("intent"), F.col("confidence"), F.col("named"), here, every, F.col("answer"))
    said = replies(spark, sf_dir).select("conv_id", "turn", Q.reply(F.col("reply"), every).alias("answer"))
    return intents(spark, sf_dir).join(said, ["conv_id", "turn"]).select("conv_id", "turn", ids.alias("ids"), method.alias("method"), sure.alias("confidence"))


@R.add("route_projects", f"WITH {_ROUTE} SELECT conv_id, turn, array_to_string(ids, ',') ids, \"method\", confidence FROM r")
def route_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).withColumn("ids", F.array_join("ids", ","))


@R.add("route_force", f"""WITH {_ROUTE}, u AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN [] ELSE ids END ids, "method", CASE WHEN "method" = 'fallback_all' THEN round(confidence * (conv_id % 10) / 10, 2) ELSE confidence END confidence FROM r)
SELECT conv_id, turn, array_to_string(CASE WHEN confidence < 0.5 AND len(ids) = 0 THEN ['src1', 'src2', 'src3', 'src10'] ELSE ids END, ',') ids, CASE WHEN confidence < 0.5 THEN 'force-rag' ELSE "method" END "method", confidence FROM u""")
def route_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of which some are unsure and some have no ids: unsure ones are searched all the same, in all projects where they have none."""
    sure = F.when(F.col("method") == "fallback_all", F.round(F.col("confidence") * (F.col("conv_id") % 10) / 10, 2)).otherwise(F.col("confidence"))
    r = routed(spark, sf_dir).withColumns({"ids": F.when(F.col("turn") % 5 == 4, F.array().cast("array<string>")).otherwise(F.col("ids")), "confidence": sure})
    ids, method = Q.forced(F.col("ids"), F.col("method"), F.col("confidence"), F.array(*map(F.lit, PROJECTS)))
    return r.select("conv_id", "turn", F.array_join(ids, ",").alias("ids"), method.alias("method"), "confidence")


@R.add("route_validate", f"WITH {_SPOKEN} SELECT conv_id, turn, coalesce(array_to_string(rids, ','), 'failed') ids, coalesce(sure, -1.0) confidence FROM said")
def route_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models' replies: the first brace block, known ids only, no confidence without them, a failure where nothing parses."""
    x = replies(spark, sf_dir).select("conv_id", "turn", Q.reply(F.col("reply"), F.array(*map(F.lit, PROJECTS))).alias("a"))
    return x.select("conv_id", "turn", F.coalesce(F.array_join("a.ids", ","), F.lit("failed")).alias("ids"), F.coalesce("a.confidence", F.lit(-1.0)).alias("confidence"))


@R.add("resolve_projects", "SELECT n_nationkey, n_name FROM nation JOIN (SELECT unnest(['nation_1', 'NATION_5', 'none', 'nation_7', 'france']) w) ON lower(n_name) = lower(w)")
def resolve_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to ids, whatever their case; names that nothing has are dropped."""
    wanted = spark.createDataFrame([(n,) for n in ("nation_1", "NATION_5", "none", "nation_7", "france")], "w string").select(F.lower("w").alias("w")).distinct()
    nation = table(spark, sf_dir, "nation").withColumn("w", F.lower("n_name"))
    return nation.join(hinted(wanted), "w").select("n_nationkey", "n_name")


_CLASS = "CASE WHEN regexp_matches(t, '^(hi|hello|hey|thanks|thank you|ok|okay|bye)\\b') THEN 'simple' WHEN regexp_matches(t, '\\b(you said|earlier|previous answer|that again|go on)\\b') THEN 'conversational' WHEN len(regexp_split_to_array(t, '\\s+')) > 20 OR regexp_matches(t, '\\b(compare|versus|why|explain|architecture|trade-?offs?)\\b') THEN 'complex' ELSE 'factual' END"


@R.add("adaptive_class", f"WITH {_SQL}, l AS (SELECT *, trim(lower(q)) t FROM ask) SELECT conv_id, turn, {_CLASS} class FROM l")
def adaptive_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("conv_id", "turn", Q.adaptive_class(F.col("q")).alias("class"))


@R.add("adaptive_plan", f"""WITH l AS (SELECT *, trim(lower(text)) t FROM conversations), c AS (SELECT conv_id, turn, {_CLASS} class FROM l)
SELECT conv_id, turn, class, class = 'simple' skipped, CASE WHEN class = 'simple' THEN 'no retrieval for a simple question' END reason, CASE class WHEN 'simple' THEN 0 WHEN 'complex' THEN 10 ELSE 5 END::INTEGER top_k, class = 'complex' rerank, class = 'conversational' with_history FROM c""")
def adaptive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is retrieved for each turn as it stands."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.adaptive_class(F.col("text")).alias("class"))
    return c.select("*", Q.retrieval_plan(F.col("class"), 5).alias("p")).select("conv_id", "turn", "class", "p.*")


_TOP = f"{_BM25}, top AS (SELECT item_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) rank FROM bm) WHERE rank <= 8), res AS (SELECT item_id, rank, score, project, file_path, language, content, chunk_id % 5 start_line, chunk_id % 5 + chunk_id % 3 end_line FROM top JOIN chunks USING (chunk_id, project) )".replace("USING (chunk_id, project) ", "USING (chunk_id)")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best chunks of each benchmark query with display columns."""
    top = bm25_top(spark, sf_dir, 8)
    x = chunks(spark, sf_dir).join(few(spark, sf_dir, top, 8), "chunk_id")
    return x.select("item_id", "rank", "score", "project", "file_path", "language", F.lit("docs").alias("file_type"), "content", (F.col("chunk_id") % 5).alias("start_line"), (F.col("chunk_id") % 5 + F.col("chunk_id") % 3).alias("end_line"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}_]+'), lambda t: t <> ''))"


@R.add("context_dedupe", f"""WITH RECURSIVE {_TOP}, w AS (SELECT item_id, rank, {_WORDS} ws FROM res),
dup AS (SELECT b.item_id, a.rank better, b.rank FROM w a JOIN w b ON a.item_id = b.item_id AND a.rank < b.rank WHERE len(list_intersect(a.ws, b.ws)) >= 0.8 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))),
g AS (SELECT item_id, CAST([] AS BIGINT[]) kept, 0::BIGINT r FROM (SELECT DISTINCT item_id FROM w)
  UNION ALL SELECT g.item_id, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.item_id = g.item_id AND w.rank = g.r + 1) AND NOT EXISTS (SELECT 1 FROM dup WHERE dup.item_id = g.item_id AND dup.rank = g.r + 1 AND list_contains(g.kept, dup.better)) THEN list_append(kept, r + 1) ELSE kept END, r + 1 FROM g WHERE r < 8)
SELECT item_id, unnest(kept) rank FROM g WHERE r = 8""")
def context_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedupe(results(spark, sf_dir), "item_id", "content").select("item_id", "rank")


@R.add("context_order", f"WITH {_TOP}, nn AS (SELECT *, count(*) OVER (PARTITION BY item_id) k FROM res) SELECT item_id, rank, CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE k - rank // 2 + 1 END sandwich, row_number() OVER (PARTITION BY item_id ORDER BY file_path, start_line, rank) chronological FROM nn")
def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("item_id")
    place = F.row_number().over(w.orderBy("file_path", "start_line", "rank")).cast("long")
    return results(spark, sf_dir).select("item_id", "rank", C.sandwich(F.col("rank"), F.count(F.lit(1)).over(w)).alias("sandwich"), place.alias("chronological"))


@R.add("context_budget", f"WITH {_TOP}, tt AS (SELECT item_id, rank, CAST(ceil(length(content) / 4.0) AS BIGINT) tokens FROM res), b AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) before FROM tt) SELECT item_id, rank, tokens, before FROM b WHERE before < 4000")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.budget(results(spark, sf_dir), "item_id", "content").select("item_id", "rank", "tokens", "before")


_ESC = "replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@R.add("context_xml", f"""WITH {_TOP} SELECT item_id, '<sources>' || chr(10) || string_agg('  <source id="' || rank || '" project="' || project || '" file="' || file_path || '" lines="' || CASE WHEN start_line = end_line THEN CAST(start_line AS VARCHAR) ELSE start_line || '-' || end_line END || '" score="' || printf('%.3f', score) || '">' || chr(10) || {_ESC} || chr(10) || '  </source>', chr(10) ORDER BY rank) || chr(10) || '</sources>' context FROM res GROUP BY item_id""")
def context_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.xml(results(spark, sf_dir), "item_id")


_LOC = "'[' || rank || '] ' || file_path || CASE WHEN start_line > 0 THEN ':' || CASE WHEN start_line = end_line OR end_line <= 0 THEN CAST(start_line AS VARCHAR) ELSE start_line || '-' || end_line END ELSE '' END"


@R.add("citations", f"""WITH {_TOP}, c AS (SELECT item_id, rank, {_LOC} m, {_LOC} || ' (' || printf('%.2f', score) || ')' c, {_LOC} || chr(10) || '    ' || upper(language[1]) || language[2:] || ' | score: ' || printf('%.2f', score) d FROM res),
a AS (SELECT item_id, list(m ORDER BY rank) m, list(c ORDER BY rank) c, list(d ORDER BY rank) d FROM c GROUP BY 1)
SELECT item_id, array_to_string(m, chr(10)) minimal, array_to_string(c[1:3], chr(10)) || CASE WHEN len(c) > 3 THEN chr(10) || '...and ' || (len(c) - 3) || ' more' ELSE '' END compact, array_to_string(d, chr(10)) detailed FROM a""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = results(spark, sf_dir)
    out = C.citations(x, "item_id", "minimal").withColumnRenamed("citations", "minimal")
    for style, limit in (("compact", 3), ("detailed", 0)):
        out = out.join(C.citations(x, "item_id", style, limit).withColumnRenamed("citations", style), "item_id")
    return out


#: Every document's text, with references behind it: few texts hold any.
_REF = "text || ' see @src/' || lang || '.ts, (@' || source || ') and a@b.c @src/' || lang || '.ts now'"
_REF_CHARS = """[^\\s@()\\[\\]{},;:!?''"]+"""


def _refs() -> object:
    return F.concat("text", F.lit(" see @src/"), "lang", F.lit(".ts, (@"), "source", F.lit(") and a@b.c @src/"), "lang", F.lit(".ts now"))


@R.add("extract_file_refs", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(' ' || {_REF}, '[^a-zA-Z0-9]@{_REF_CHARS}'), lambda x: x[3:]))), '|') refs FROM documents")
def extract_file_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.file_refs(_refs())), "|").alias("refs"))


@R.add("strip_file_refs", f"SELECT doc_id, trim(regexp_replace(regexp_replace(' ' || {_REF}, '([^a-zA-Z0-9])@{_REF_CHARS}', '\\1', 'g'), '\\s+', ' ', 'g')) question FROM documents")
def strip_file_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.without_file_refs(_refs()).alias("question"))


@R.add("xml_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') escaped FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.xml_escape(F.col("html")).alias("escaped"))


@R.add("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@R.add("safe_json", "SELECT event_id, coalesce(CAST(json_extract_string(CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT), -1) k FROM events")
def safe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broken text gives the fallback."""
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(text, "k long")["k"], F.lit(-1)).alias("k"))


@R.add("human_bytes", "WITH s AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) * CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1000 ELSE 1000000 END n FROM documents) SELECT doc_id, CASE WHEN n = 0 THEN '0 Bytes' WHEN n < 1024 THEN n || ' Bytes' WHEN n < 1048576 THEN regexp_replace(printf('%.1f', round(n / 1024.0::DOUBLE, 1)), '\\.0$', '') || ' KB' WHEN n < 1073741824 THEN regexp_replace(printf('%.1f', round(n / 1048576.0::DOUBLE, 1)), '\\.0$', '') || ' MB' ELSE regexp_replace(printf('%.1f', round(n / 1073741824.0::DOUBLE, 1)), '\\.0$', '') || ' GB' END size FROM s")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    n = F.octet_length("text").cast("long") * F.when(k == 0, 0).when(k == 1, 1).when(k == 2, 1000).otherwise(1_000_000)
    return table(spark, sf_dir, "documents").select("doc_id", T.human_bytes(n).alias("size"))


@R.add("relative_age", """WITH x AS (SELECT event_id, ts, epoch(TIMESTAMP '2024-02-01' - ts) s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || ' minute' || CASE WHEN floor(s / 60) = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || ' hour' || CASE WHEN floor(s / 3600) = 1 THEN '' ELSE 's' END || ' ago'
WHEN s < 604800 THEN CAST(floor(s / 86400) AS BIGINT) || ' day' || CASE WHEN floor(s / 86400) = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 2592000 THEN CAST(floor(floor(s / 86400) / 7) AS BIGINT) || ' week' || CASE WHEN floor(floor(s / 86400) / 7) = 1 THEN '' ELSE 's' END || ' ago' ELSE strftime(ts, '%Y-%m-%d') END age FROM x""")
def relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.relative_age(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).alias("age"))


#: An answer for each turn: its own text with citations behind it.
_CITED = "text || ' as [1] and [' || (turn + 3) || '] say, [2] [x]'"
_CITES = f"c AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all({_CITED}, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)))) cited, CAST(range(1, 5) AS INTEGER[]) given FROM conversations)"


def _cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" as [1] and ["), (F.col("turn") + 3).cast("string"), F.lit("] say, [2] [x]"))
    refs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", refs.alias("cited"))


@R.add("citation_refs", f"WITH {_CITES} SELECT conv_id, turn, array_to_string(cited, ',') refs FROM c")
def citation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cites(spark, sf_dir).select("conv_id", "turn", F.array_join(F.col("cited").cast("array<string>"), ",").alias("refs"))


@R.add("verify_citations", f"WITH {_CITES} SELECT conv_id, turn, array_to_string(list_filter(cited, lambda x: list_contains(given, x)), ',') cited_ok, array_to_string(list_sort(list_filter(given, lambda x: NOT list_contains(cited, x))), ',') uncited, array_to_string(list_filter(cited, lambda x: NOT list_contains(given, x)), ',') invalid FROM c")
def verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations of each answer against four sources."""
    cited, given = F.col("cited"), F.array(*[F.lit(k) for k in range(1, 5)])
    told = lambda a: F.array_join(F.array_sort(a).cast("array<string>"), ",")
    return _cites(spark, sf_dir).select("conv_id", "turn", told(F.array_intersect(cited, given)).alias("cited_ok"), told(F.array_except(given, cited)).alias("uncited"), told(F.array_except(cited, given)).alias("invalid"))


@R.add("array_except_demo", "SELECT c_custkey, array_to_string(list_filter(['tools', 'vision', 'json'], lambda x: x <> (['tools','vision','none'])[c_custkey % 3 + 1]), ',') lost FROM customer")
def array_except_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities that a fallback provider lacks."""
    had = F.array(F.lit("tools"), F.lit("vision"), F.lit("json"))
    has = F.array(F.get(F.array(F.lit("tools"), F.lit("vision"), F.lit("none")), (F.col("c_custkey") % 3).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_except(had, has), ",").alias("lost"))


_ABILITIES = "ability AS (SELECT DISTINCT source provider, lang ability FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"


@R.add("lost_capabilities", f"""WITH {_ABILITIES}, pair AS (SELECT a.provider, b.provider fallback FROM (SELECT provider, row_number() OVER (ORDER BY provider) k FROM (SELECT DISTINCT provider FROM ability)) a JOIN (SELECT provider, row_number() OVER (ORDER BY provider) k FROM (SELECT DISTINCT provider FROM ability)) b ON b.k = a.k + 1)
SELECT p.provider, p.fallback, coalesce(string_agg(x.ability, ',' ORDER BY x.ability), '') lost, count(x.ability) n_lost FROM pair p LEFT JOIN (SELECT a.provider, a.ability, p.fallback FROM ability a JOIN pair p USING (provider) WHERE NOT EXISTS (SELECT 1 FROM ability o WHERE o.provider = p.fallback AND o.ability = a.ability)) x ON x.provider = p.provider GROUP BY ALL""")
def lost_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as providers, their languages as what they can do: what the next provider by name, as its fallback, can't."""
    ability = table(spark, sf_dir, "documents").selectExpr("source AS provider", "lang AS ability").dropna().distinct()
    names = ability.groupBy().agg(F.array_sort(F.collect_set("provider")).alias("l"))  # a name for each source
    pair = names.select(F.explode(F.arrays_zip(F.slice("l", 1, F.size("l") - 1).alias("provider"), F.slice("l", 2, F.size("l")).alias("fallback"))).alias("p")).select("p.*")
    return Q.lost_capabilities(ability, pair)


_PATTERNS = ["12.md", "en/1", "src3", "9", "fr/100.md"]


#: The total is scaled down so that the small tables have files beyond it.
_TOTAL = 9_000


@R.add("resolve_file_refs", f"""WITH {CHUNKS}, p AS (SELECT unnest({_PATTERNS}) pattern, generate_subscripts({_PATTERNS}, 1) k), m AS (SELECT k, pattern, file_path, content, CASE WHEN split_part(file_path, '/', -1) = pattern THEN 1.0 WHEN starts_with(split_part(file_path, '/', -1), pattern) THEN 0.8 WHEN contains(split_part(file_path, '/', -1), pattern) THEN 0.6 ELSE 0.4 END::DOUBLE score FROM chunks, p WHERE contains(file_path, pattern)),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY score DESC, length(file_path), file_path) place FROM m) WHERE place <= 3),
b AS (SELECT *, {_TOTAL} - coalesce(sum(length(content)) OVER (ORDER BY k, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) room FROM n),
c AS (SELECT *, substr(content, 1, CAST(room AS BIGINT)) cut FROM b WHERE room > 0),
e AS (SELECT *, length(cut) - strpos(reverse(cut), chr(10)) at_ FROM c)
SELECT pattern, file_path, score, place, CASE WHEN length(content) <= room THEN content ELSE CASE WHEN contains(cut, chr(10)) AND at_ > room * 0.8 THEN substr(cut, 1, at_) ELSE cut END || chr(10) || chr(10) || '[... content truncated ...]' END content FROM e""")
def resolve_file_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best files of each reference with their content, within a total for all of them."""
    p = spark.createDataFrame([(x, k) for k, x in enumerate(_PATTERNS)], "pattern string, k int")
    c = chunks(spark, sf_dir).select("file_path", "content")
    found = C.match_files(p, c.select("file_path").distinct(), "pattern", "file_path")
    return C.with_content(found, c, "k", "file_path", "content", _TOTAL).select("pattern", "file_path", "score", "place", "content")


@R.add("complete_path", f"WITH {CHUNKS} SELECT file_path, CASE WHEN file_path LIKE '%/1%' THEN 0 ELSE 1 END kind FROM (SELECT DISTINCT file_path FROM chunks) WHERE lower(file_path) LIKE '%1%' ORDER BY kind, length(file_path), file_path LIMIT 15")
def complete_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = chunks(spark, sf_dir).select("file_path").distinct().where(F.contains(F.lower("file_path"), F.lit("1")))
    f = f.withColumn("kind", F.when(F.lower("file_path").like("%/1%"), 0).otherwise(1))
    return f.orderBy("kind", F.length("file_path"), "file_path").limit(15)
