"""Queries over ingest: files, classification, segments, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import estimate_tokens, fixed
from siltstone.operators import chunking, extract, ingest
from siltstone.operators.steps import delete_folder, materialize, work_dir
from siltstone.plans.registry import FILES, Registry, files, table
from siltstone.sources.files import scan_tree

R = Registry()


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_EXT = "lower(split_part(split_part(relative_path, '/', -1), '.', -1))"
_LANG = "CASE " + " ".join(f"WHEN {_EXT} IN ({_quoted(v)}) THEN '{k}'" for k, v in ingest.LANGUAGE_ENDINGS.items()) + " ELSE 'text' END"
_TYPE = "CASE " + " ".join(f"WHEN language IN ({_quoted(v)}) THEN '{k}'" for k, v in ingest.TYPE_LANGUAGES.items()) + " ELSE 'docs' END"
_BINARY = "(" + " OR ".join(f"ends_with(lower(relative_path), '.{e}')" for e in ingest.BINARY_ENDINGS) + ")"


def _ignored_sql(patterns: list[str]) -> str:
    out = "FALSE"
    for p in patterns:
        regex, back = ingest.ignore_regex(p)
        out = f"CASE WHEN regexp_matches(relative_path, '{regex}') THEN {'FALSE' if back else 'TRUE'} ELSE {out} END"
    return out


_KEPT = f"NOT ({_ignored_sql(ingest.IGNORED)}) AND NOT {_BINARY}"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.withColumn("language", ingest.language(F.col("relative_path"))).withColumn("file_type", ingest.file_type(F.col("language")))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).where(~ingest.ignored(F.col("relative_path"), ingest.IGNORED) & ~ingest.is_binary(F.col("relative_path")))


_CLASSIFIED = f"{FILES}, c AS (SELECT *, {_LANG} \"language\" FROM files), k AS (SELECT *, {_TYPE} file_type FROM c)"


@R.add("classify_language", f"WITH {_CLASSIFIED} SELECT doc_id, relative_path, language FROM k")
def classify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("doc_id", "relative_path", "language")


@R.add("classify_type", f"WITH {_CLASSIFIED} SELECT doc_id, file_type FROM k")
def classify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("doc_id", "file_type")


@R.add("ignore_filter", f"WITH {FILES} SELECT doc_id, relative_path FROM files WHERE NOT ({_ignored_sql(ingest.IGNORED)})")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(~ingest.ignored(F.col("relative_path"), ingest.IGNORED)).select("doc_id", "relative_path")


@R.add("binary_filter", f"WITH {FILES} SELECT doc_id, relative_path FROM files WHERE NOT {_BINARY}")
def binary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(~ingest.is_binary(F.col("relative_path"))).select("doc_id", "relative_path")


@R.add("parse_ignore", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex('# c' || chr(10) || ' *.log ' || chr(10) || chr(10) || lang || '/' || chr(10) || '!' || source, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')), '|') patterns FROM documents")
def parse_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# c\n *.log \n\n"), "lang", F.lit("/\n!"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ingest.parse_ignore(text), "|").alias("patterns"))


@R.add("scan_multi_root", f"WITH {_CLASSIFIED} SELECT root, relative_path, size FROM k WHERE {_KEPT}")
def scan_multi_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("root", "relative_path", "size")


@R.add("count_files", f"WITH {_CLASSIFIED} SELECT root, count(*) n FROM k WHERE {_KEPT} GROUP BY root")
def count_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@R.add("scan_stats", f"WITH {_CLASSIFIED} SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(file_type) = 0 THEN 'type' ELSE 'total' END kind, coalesce(language, file_type, '') name, count(*) n, CAST(sum(size) AS BIGINT) size FROM k WHERE {_KEPT} GROUP BY GROUPING SETS ((language), (file_type), ())")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by language, by type and of all, in one pass."""
    k = kept(spark, sf_dir).groupingSets([[F.col("language")], [F.col("file_type")], []], F.col("language"), F.col("file_type"))
    k = k.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.grouping("language").alias("gl"), F.grouping("file_type").alias("gt"))
    return k.select(F.when(F.col("gl") == 0, "language").when(F.col("gt") == 0, "type").otherwise("total").alias("kind"), F.coalesce("language", "file_type", F.lit("")).alias("name"), "n", "size")


#: What a scan keeps of the tree, written out: folders, and endings.
_SCANNED = "split_part(relative_path, '/', 1) IN ('src', 'lib', 'docs', 'test') AND regexp_matches(relative_path, '\\.(ts|py|md|json|css|sql|go|RS|txt|java|yml|lock|tsx|Dockerfile)$')"


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) to files."""
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            fs, name = FileSystem.from_uri(path)
            fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(name) as out:
                out.write(content or b"")
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])


@R.add("scan_files", f"WITH {FILES} SELECT root || '/' || relative_path relative_path, size, lower(split_part(relative_path, '.', -1)) extension FROM files WHERE {_SCANNED}")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents written as a file tree into the shared folder and scanned by the rules of an index."""
    root = work_dir(spark, "tree")
    f = files(spark, sf_dir).select(F.concat(F.lit(f"{root}/"), "root", F.lit("/"), "relative_path").alias("path"), "content")
    f.mapInArrow(_written, "n long").agg(F.sum("n")).collect()
    out = materialize(scan_tree(spark, root).select("relative_path", "size", "extension"), "scanned")
    delete_folder(spark, root)
    return out


#: Every fiftieth file holds its text as often as the limit allows, every other of them once more.
_TIMES = f"CASE WHEN doc_id % 50 = 0 AND size > 0 THEN {ingest.MOST_BYTES} // size + doc_id // 50 % 2 ELSE 1 END"


@R.add("chunk_skip_reasons", f"WITH {FILES}, g AS (SELECT repeat(content, CAST({_TIMES} AS BIGINT)) content FROM files) SELECT coalesce(CASE WHEN octet_length(encode(content)) > 512000 THEN 'too_large' WHEN trim(regexp_replace(content, '\\s+', ' ', 'g')) = '' THEN 'empty' END, 'ok') reason, count(*) n FROM g GROUP BY 1")
def chunk_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files, some of which are made larger, to either side of the limit."""
    times = F.when((F.col("doc_id") % 50 == 0) & (F.col("size") > 0), F.floor(F.lit(ingest.MOST_BYTES) / F.col("size")) + F.floor(F.col("doc_id") / 50) % 2).otherwise(1)
    f = files(spark, sf_dir).select(F.repeat("content", times.cast("int")).alias("content"))
    reason = ingest.skip_reason(F.octet_length("content"), F.col("content"))
    return f.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@R.add("estimate_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) tokens FROM documents")
def estimate_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@R.add("embed_memory", "SELECT label project, count(*) n, CAST(sum(len(embedding) * 4 + 100) AS BIGINT) bytes FROM embeddings GROUP BY 1")
def embed_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("project")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding") * 4 + 100).cast("long").alias("bytes"))


_MODELS = ["bge-large-en", "BGE-base", "bge-small", "nomic-embed-text", "mxbai-embed-large", "text-embedding-3-large", "text-embedding-3-small", "text-embedding-ada-002", "other"]


@R.add("model_dimensions", f"SELECT c_custkey, model, CAST(CASE WHEN m LIKE '%bge-large%' THEN 1024 WHEN m LIKE '%bge-base%' THEN 768 WHEN m LIKE '%bge-small%' THEN 384 WHEN m LIKE '%nomic-embed%' THEN 768 WHEN m LIKE '%mxbai-embed%' THEN 1024 WHEN m LIKE '%text-embedding-3-large%' THEN 3072 WHEN m LIKE '%text-embedding-3-small%' OR m LIKE '%text-embedding-ada%' THEN 1536 ELSE 1024 END AS INTEGER) dims FROM (SELECT *, lower(model) m FROM (SELECT c_custkey, ({_MODELS})[c_custkey % {len(_MODELS)} + 1] model FROM customer))")
def model_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _MODELS)), (F.col("c_custkey") % len(_MODELS)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("model"), ingest.model_dimensions(name).alias("dims"))


@R.add("segment_filter", "WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) content FROM documents) SELECT doc_id, content, CAST(ceil(length(content) / 4.0) AS BIGINT) tokens FROM s WHERE length(trim(content, ' ')) >= 10")
def segment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    return ingest.segment_filter(s)


_CHUNKED = """c AS (SELECT doc_id, text, unnest(CASE WHEN length(text) > 1024 THEN range(0, length(text) - 100, 924) WHEN length(text) > 0 THEN [0] ELSE [] END) a FROM documents),
n AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) total_chunks, substr(text, 1, CAST(a AS BIGINT)) head, substr(text, CAST(a AS BIGINT) + 1, 1024) content FROM c)"""


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 256, 25)


@R.add("chunk_fixed", f"WITH {_CHUNKED} SELECT doc_id, chunk_index, content FROM n")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed(spark, sf_dir).select("doc_id", "chunk_index", "content")


@R.add("chunk_numbering", f"WITH {_CHUNKED} SELECT doc_id, chunk_index, total_chunks FROM n")
def chunk_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed(spark, sf_dir).select("doc_id", "chunk_index", "total_chunks")


@R.add("chunk_lines", f"WITH {_CHUNKED} SELECT doc_id, chunk_index, CAST(1 + length(head) - length(replace(head, chr(10), '')) AS INTEGER) start_line, CAST(1 + length(head) - length(replace(head, chr(10), '')) + length(content) - length(replace(content, chr(10), '')) AS INTEGER) end_line FROM n")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed(spark, sf_dir).select("doc_id", "chunk_index", "start_line", "end_line")


def _recursive_sql(most: int, back: int) -> str:
    """Ranges (a, z) of each text, cut level by level at the separators."""
    whole, ranges = "substr(text, CAST(r.a + 1 AS BIGINT), CAST(r.z - r.a AS BIGINT))", "[{'a': 0::BIGINT, 'z': length(text)}]"
    none = "CAST([] AS STRUCT(a BIGINT, z BIGINT)[])"
    for sep, wide in (("chr(10) || chr(10)", 2), ("chr(10)", 1), ("'. '", 2), ("' '", 1)):
        start, end = "CASE WHEN c.z > c.a THEN c.a ELSE c.at_ END", "c.at_ + n"
        after = f"CASE WHEN c.z > c.a AND least({back}, c.z - c.a) + {wide} + n <= {most} THEN c.z - least({back}, c.z - c.a) ELSE c.at_ END"
        held = f"CASE WHEN c.z > c.a THEN [{{'a': c.a, 'z': c.z}}] ELSE {none} END"
        step = f"""{{'at_': c.at_ + n + {wide}, 'a': CASE WHEN {end} - {start} <= {most} THEN {start} WHEN {end} - ({after}) > {most} THEN {end} ELSE {after} END, 'z': {end},
'o': CASE WHEN {end} - {start} <= {most} THEN c.o ELSE list_concat(list_concat(c.o, {held}), CASE WHEN {end} - ({after}) > {most} THEN [{{'a': {after}, 'z': {end}}}] ELSE {none} END) END}}"""
        lengths = f"list_transform(string_split({whole}, {sep}), lambda t: length(t))"
        fold = f"list_transform([list_reduce({lengths}, lambda c, n: {step}, {{'at_': r.a, 'a': 0::BIGINT, 'z': 0::BIGINT, 'o': {none}}})], lambda e: CASE WHEN e.z > e.a AND regexp_matches(substr(text, CAST(e.a + 1 AS BIGINT), CAST(e.z - e.a AS BIGINT)), '\\S') THEN list_append(e.o, {{'a': e.a, 'z': e.z}}) ELSE e.o END)[1]"
        ranges = f"flatten(list_transform({ranges}, lambda r: CASE WHEN r.z - r.a <= {most} OR NOT contains({whole}, {sep}) THEN [{{'a': r.a, 'z': r.z}}] ELSE {fold} END))"
    ranges = f"flatten(list_transform({ranges}, lambda r: CASE WHEN r.z - r.a <= {most} THEN [{{'a': r.a, 'z': r.z}}] ELSE list_transform(range(r.a, r.z - {back}, {most - back}), lambda i: {{'a': i, 'z': least(i + {most}, r.z)}}) END))"
    return f"WITH q AS (SELECT doc_id, text, {ranges} rs FROM documents WHERE regexp_matches(text, '\\S')), x AS (SELECT doc_id, text, unnest(rs) r, generate_subscripts(rs, 1) i FROM q) SELECT doc_id, CAST(i - 1 AS INTEGER) chunk_index, {whole} content FROM x"


@R.add("chunk_recursive", _recursive_sql(4096, 400))
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_recursive(table(spark, sf_dir, "documents"), "doc_id", "text")


@R.add("chunk_semantic", """WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda t: regexp_matches(t, '\\S')) al FROM documents),
x AS (SELECT doc_id, unnest(al) t, generate_subscripts(al, 1) i FROM s),
w AS (SELECT doc_id, i, md5(unnest(list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}_]+'), lambda t: t <> ''))) h FROM x),
c AS (SELECT doc_id, i, CAST('0x' || h[1:4] AS INTEGER) % 64 k, CAST(sum(CASE WHEN h[5] < '8' THEN 1 ELSE -1 END) AS BIGINT) v FROM w GROUP BY ALL),
n AS (SELECT doc_id, i, CAST(sum(v * v) AS DOUBLE) n FROM c GROUP BY ALL),
d AS (SELECT b.doc_id, b.i, sum(a.v * b.v) dot FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i = a.i + 1 GROUP BY ALL),
e AS (SELECT x.doc_id, x.i, length(t) l, coalesce(dot >= 0.5::DOUBLE * sqrt(n.n * p.n) AND n.n * p.n > 0, FALSE) near FROM x LEFT JOIN d USING (doc_id, i) LEFT JOIN n USING (doc_id, i) LEFT JOIN n p ON p.doc_id = x.doc_id AND p.i = x.i - 1),
f AS (SELECT doc_id, list_reduce(list({'i': i, 'l': l, 'near': near} ORDER BY i), lambda c, y: CASE WHEN c.n < 0 OR (c.n >= 400 AND NOT y.near) THEN {'n': y.l, 'o': list_append(c.o, y.i)} ELSE {'n': c.n + 1 + y.l, 'o': c.o} END, {'n': -1::BIGINT, 'o': CAST([] AS BIGINT[])}).o o FROM e GROUP BY doc_id),
g AS (SELECT doc_id, o, unnest(o) a, generate_subscripts(o, 1) k FROM f)
SELECT doc_id, CAST(k - 1 AS INTEGER) chunk_index, array_to_string(al[a:coalesce(o[k + 1] - 1, len(al))], ' ') content FROM g JOIN s USING (doc_id)""")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_semantic(table(spark, sf_dir, "documents"), "doc_id", "text")


_WORD = "unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: t <> ''))"


@R.add("embed_hash", f"""WITH w AS (SELECT doc_id, md5({_WORD}) h FROM documents),
c AS (SELECT doc_id, CAST('0x' || h[1:4] AS INTEGER) % 64 k, CAST(sum(CASE WHEN h[5] < '8' THEN 1 ELSE -1 END) AS BIGINT) v FROM w GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)) norm FROM c GROUP BY 1), r AS (SELECT doc_id, i FROM documents, range(0, 64) t(i))
SELECT r.doc_id, string_agg(printf('%.5f', CASE WHEN norm > 0 THEN coalesce(v, 0) / norm ELSE 0.0::DOUBLE END), ' ' ORDER BY i) embedding FROM r LEFT JOIN c ON c.doc_id = r.doc_id AND k = i LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""")
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = extract.embed_hash(table(spark, sf_dir, "documents"), "doc_id", "text")
    return v.select("doc_id", F.array_join(F.transform("embedding", lambda x: fixed(x, 5)), " ").alias("embedding"))


def _code(spark: SparkSession, sf_dir: str, head: str, foot: str) -> DataFrame:
    """Documents dressed as source code: the whole text, as JSON writes it, stands in a small program; {"text": is cut off."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(head), F.substring(F.to_json(F.struct("text")), 9, 1 << 30), F.lit(foot)).alias("code"))


def _segments_sql(rows: list[tuple]) -> str:
    """Rows (first line, last line, content type, kind, name, SQL of the content) for each document."""
    one = ["SELECT doc_id, {0} start_line, {1} end_line, '{2}' content_type, '{3}' symbol_type, {4} symbol, {5} content FROM documents".format(a, z, t, k, f"'{n}'" if n else "CAST(NULL AS VARCHAR)", c) for a, z, t, k, n, c in rows]
    return " UNION ALL ".join(one)


@R.add("extract_js", _segments_sql([
    (1, 1, "docs", "doc", None, "'/** Doc. */'"),
    (2, 5, "code", "function", "one", "'export function one(a: number) {' || chr(10) || '  const s = {t: ' || CAST(to_json(text) AS VARCHAR) || '};' || chr(10) || '  return { s };' || chr(10) || '}'"),
    (6, 6, "code", "arrow", "two", "'export const two = (x) => { return x; }'"), (7, 7, "code", "class", "Three", "'export class Three { m() { return 1; } }'"),
    (8, 8, "code", "interface", "Four", "'export interface Four { a: string }'"), (9, 9, "code", "type", "Five", "'export type Five = string;'"),
    (10, 12, "code", "function", "six", "'function six(x) {' || chr(10) || '  return x.replace(/''/g, `a${`}`} {`) / 2 / 3;' || chr(10) || '}'"),
    (13, 13, "code", "arrow", "seven", "'const seven = (x) => x + 1'"), (14, 14, "code", "class", "Eight", "'class Eight {}'"),
]))
def extract_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir, "/** Doc. */\nexport function one(a: number) {\n  const s = {t: ", ";\n  return { s };\n}\nexport const two = (x) => { return x; };\nexport class Three { m() { return 1; } }\nexport interface Four { a: string }\nexport type Five = string;\nfunction six(x) {\n  return x.replace(/'/g, `a${`}`} {`) / 2 / 3;\n}\nconst seven = (x) => x + 1\nclass Eight {}\n")
    return extract.extract_js(code, "doc_id", "code")


_PY_F = "'def f(self):' || chr(10) || '        return {\"t\": ' || CAST(to_json(text) AS VARCHAR) || '}'"


@R.add("extract_python", _segments_sql([
    (1, 1, "docs", "docstring", None, "'Module.'"), (4, 8, "code", "class", "A", "'class A:' || chr(10) || '    \"\"\"Doc.\"\"\"' || chr(10) || chr(10) || '    ' || " + _PY_F),
    (5, 5, "docs", "docstring", "A", "'Doc.'"), (7, 8, "code", "function", "f", _PY_F),
]))
def extract_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir, '"""Module."""\n\n\nclass A:\n    """Doc."""\n\n    def f(self):\n        return {"t": ', "\n")
    return extract.extract_python(code, "doc_id", "code")


@R.add("extract_fallback", r"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || '/* ' || lang || ' */ x /* ' || source || ' */' ELSE text END code FROM documents), m AS (SELECT *, regexp_extract_all(code, '/\*[\s\S]*?\*/') s FROM c) SELECT doc_id, CASE WHEN len(s) > 0 THEN 'docs' ELSE 'code' END content_type, array_to_string(CASE WHEN len(s) > 0 THEN s ELSE [code] END, '|') segments FROM m WHERE trim(code) <> ''""")
def extract_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block comments if there are any, the whole text otherwise."""
    d = table(spark, sf_dir, "documents")
    code = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("/* "), "lang", F.lit(" */ x /* "), "source", F.lit(" */"))).otherwise(F.col("text"))
    c = d.select("doc_id", code.alias("code")).withColumn("s", F.regexp_extract_all("code", F.lit(r"/\*[\s\S]*?\*/"), F.lit(0)))
    some = F.size("s") > 0
    return c.where(F.trim("code") != "").select("doc_id", F.when(some, "docs").otherwise("code").alias("content_type"), F.array_join(F.when(some, F.col("s")).otherwise(F.array("code")), "|").alias("segments"))


@R.add("extract_markdown", r"""WITH m AS (SELECT doc_id, '# ' || lang || chr(10) || text || chr(10) || '```' || chr(10) || 'x' || chr(10) || '```' || chr(10) || '- item' || chr(10) || '## ' || source || chr(10) || '> quote' md FROM documents),
l AS (SELECT doc_id, CAST(generate_subscripts(string_split(md, chr(10)), 1) - 1 AS INTEGER) line, unnest(string_split(md, chr(10))) content FROM m),
f AS (SELECT *, sum(CASE WHEN starts_with(content, '```') THEN 1 ELSE 0 END) OVER w % 2 = 1 ins, starts_with(content, '```') fence FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
h AS (SELECT *, NOT ins AND NOT fence AND regexp_matches(content, '^#{1,6} ') heading FROM f),
k AS (SELECT *, CASE WHEN ins OR fence THEN 'code' WHEN heading THEN 'heading' WHEN regexp_matches(content, '^(---+|\*\*\*+)$') THEN 'rule' WHEN trim(content, ' ') = '' THEN 'blank' WHEN regexp_matches(content, '^\s*([-*+]|[0-9]+\.) ') THEN 'list' WHEN starts_with(content, '>') THEN 'blockquote' WHEN starts_with(content, '|') THEN 'table' WHEN starts_with(content, '<') THEN 'html' ELSE 'paragraph' END kind,
 last_value(CASE WHEN heading THEN regexp_replace(content, '^#{1,6} ', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) section FROM h)
SELECT doc_id, line, kind, section, content FROM k WHERE kind NOT IN ('blank', 'rule')""")
def extract_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("# "), "lang", F.lit("\n"), "text", F.lit("\n```\nx\n```\n- item\n## "), "source", F.lit("\n> quote"))
    return ingest.markdown_segments(table(spark, sf_dir, "documents").select("doc_id", md.alias("md")), "doc_id", "md")


_MD = "'# ' || lang || chr(10) || text || chr(10) || '```js' || chr(10) || 'x' || chr(10) || chr(10) || '# y' || chr(10) || '```' || chr(10) || '- item' || chr(10) || 'more' || chr(10) || '- other' || chr(10) || chr(10) || '| a |' || chr(10) || '| b |' || chr(10) || '## ' || source || chr(10) || '---' || chr(10) || '> quote' || chr(10) || '<p>'"


@R.add("markdown_blocks", rf"""WITH m AS (SELECT doc_id, {_MD} md FROM documents),
l AS (SELECT doc_id, CAST(generate_subscripts(string_split(md, chr(10)), 1) - 1 AS INTEGER) line, unnest(string_split(md, chr(10))) content FROM m),
f AS (SELECT *, sum(CASE WHEN starts_with(content, '```') THEN 1 ELSE 0 END) OVER w % 2 = 1 ins, starts_with(content, '```') fence FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
k AS (SELECT *, CASE WHEN ins OR fence THEN 'code' WHEN regexp_matches(content, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(content, '^(---+|\*\*\*+)$') THEN 'rule' WHEN trim(content, ' ') = '' THEN 'blank' WHEN regexp_matches(content, '^\s*([-*+]|[0-9]+\.) ') THEN 'list' WHEN starts_with(content, '>') THEN 'blockquote' WHEN starts_with(content, '|') THEN 'table' WHEN starts_with(content, '<') THEN 'html' ELSE 'paragraph' END kind FROM f),
h AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN regexp_replace(content, '^#{{1,6}} ', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) section, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) prior FROM k),
g AS (SELECT *, sum(CASE WHEN (kind = prior AND kind NOT IN ('heading', 'code')) OR (kind = 'paragraph' AND prior IN ('list', 'blockquote')) OR (kind = 'code' AND NOT (fence AND ins)) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) seg FROM h)
SELECT doc_id, CAST(min(line) + 1 AS INTEGER) start_line, CAST(max(line) + 1 AS INTEGER) end_line, arg_min(kind, line) kind, CASE WHEN arg_min(kind, line) = 'code' THEN 'code' ELSE 'docs' END content_type, arg_min(section, line) section,
CASE WHEN arg_min(kind, line) = 'code' THEN string_agg(content, chr(10) ORDER BY line) FILTER (WHERE NOT fence) ELSE trim(string_agg(content, chr(10) ORDER BY line), ' ') END content
FROM g WHERE kind NOT IN ('blank', 'rule') GROUP BY doc_id, seg""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts between a heading and blocks of every kind."""
    md = F.concat(F.lit("# "), "lang", F.lit("\n"), "text", F.lit("\n```js\nx\n\n# y\n```\n- item\nmore\n- other\n\n| a |\n| b |\n## "), "source", F.lit("\n---\n> quote\n<p>"))
    return ingest.markdown_blocks(table(spark, sf_dir, "documents").select("doc_id", md.alias("md")), "doc_id", "md")


_POLICY = "(CASE file_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, (n, _) in ingest.SIZES.items()) + f" ELSE {ingest.SIZES['docs'][0]} END)"
_OVERLAP = "(CASE file_type " + " ".join(f"WHEN '{k}' THEN {o}" for k, (_, o) in ingest.SIZES.items()) + f" ELSE {ingest.SIZES['docs'][1]} END)"


@R.add("chunk_policy", f"""WITH {_CLASSIFIED}, s AS (SELECT doc_id, file_type, content, 4 * {_POLICY} w, 4 * {_OVERLAP} o FROM k WHERE length(content) >= 10),
cut AS (SELECT doc_id, file_type, content, w, unnest(CASE WHEN length(content) > w THEN range(0, length(content) - o, w - o) ELSE [0] END) a FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) total_chunks, substr(content, CAST(a AS BIGINT) + 1, w) content FROM cut""")
def chunk_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut by the size policy of their type."""
    return ingest.policy_chunks(classified(spark, sf_dir), "doc_id", "content", "file_type").select("doc_id", "chunk_index", "total_chunks", "content")


@R.add("segment_config", f"WITH {_CLASSIFIED} SELECT doc_id, 'config' content_type, 1 start_line, CAST(len(string_split(content, chr(10))) AS INTEGER) end_line, content FROM k WHERE file_type = 'config'")
def segment_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.whole_segments(classified(spark, sf_dir), "content").select("doc_id", "content_type", "start_line", "end_line", "content")


@R.add("detect_changes", """WITH o AS (SELECT 'p' || doc_id path, sha256(text) h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT 'p' || doc_id path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.path, n.path) path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END status FROM o FULL JOIN n ON o.path = n.path""")
def detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots made of documents: some rows are missing from either, some texts differ."""
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    old = d.where("doc_id % 10 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return ingest.detect_changes(old, new)


@R.add("ema_rate", """WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) l FROM events)
SELECT event_id, round(list_reduce(l, lambda s, v: 0.3::DOUBLE * v + 0.7::DOUBLE * s), 4) rate FROM e""")
def ema_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean over the last ten values, seeded with the oldest of them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    e = table(spark, sf_dir, "events").select("event_id", F.collect_list("value").over(w).alias("l"))
    return e.select("event_id", F.round(F.aggregate(F.slice("l", 2, 10), F.col("l")[0], lambda s, v: 0.3 * v + 0.7 * s), 4).alias("rate"))


