"""Known answers and edge cases of the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import context, evaluate, extract, ingest, routing, search, store, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("got", "want", "k", "metric", "value"),
    [
        (["x1", "x2", "a", "x3", "b"], ["a", "b"], 5, "ndcg", 0.543772),
        (["x", "y", "a", "z", "w"], ["a"], 5, "ndcg", 0.5),
        (["a", "x", "b"], ["a", "b"], None, "map", 0.833333),
        (["a"], ["a", "b", "c"], None, "map", 0.333333),
        (["a", "x", "b", "y", "c"], ["a", "b", "c"], None, "map", 0.755556),
        (["a"], [], 3, "recall_at_k", 0.0),
        ([], ["a"], 3, "mrr", 0.0),
        (["./src/A.ts", "\\src\\a.ts", "src//a.ts"], ["src/a.ts"], 3, "precision_at_k", 0.333333),
        (["x", "a"], ["a"], 1, "mrr", 0.5),
    ],
)
def test_metrics(spark, got, want, k, metric, value):
    d = spark.createDataFrame([(got, want)], "r array<string>, e array<string>")
    assert evaluate.metrics(d, "r", "e", k).first()[metric] == pytest.approx(value, abs=2e-6)


def test_macro_of_nothing(spark):
    d = spark.createDataFrame([], "r array<string>, e array<string>")
    row = evaluate.macro(evaluate.metrics(d, "r", "e", 5)).first()
    assert row.mrr == 0 and row.query_count == 0


def lists(spark, rows):
    return spark.createDataFrame(rows, "q long, list string, weight double, id string, rank long")


def test_rrf(spark):
    got = {r.id: r.score for r in search.rrf(lists(spark, [(1, "d", 1.0, "A", 1), (1, "b", 1.0, "B", 1)]), ["q"], "id").collect()}
    assert got == {"A": round(1 / 61, 9), "B": round(1 / 61, 9)}
    both = search.rrf(lists(spark, [(1, "d", 1.0, "A", 1), (1, "b", 1.0, "A", 1)]), ["q"], "id").first()
    assert both.score == round(2 / 61, 9)
    weighted = search.rrf(lists(spark, [(1, "d", 1.0, "A", 1), (1, "b", 0.0, "B", 1)]), ["q"], "id", weight="weight")
    assert [(r.id, r.score) for r in weighted.orderBy("rank").collect()] == [("A", round(1 / 61, 9)), ("B", 0.0)]
    assert search.rrf(lists(spark, []), ["q"], "id").count() == 0


def test_minmax(spark):
    d = spark.createDataFrame([(1, 5.0, 1), (2, 3.0, 1), (2, 1.0, 2), (3, 2.0, 1), (3, 2.0, 2), (3, 2.0, 3)], "q long, s double, rank long")
    got = [(r.q, r.rank, r.normalized) for r in search.minmax(d, ["q"], "s", [F.asc("rank")]).orderBy("q", "rank").collect()]
    assert got == [(1, 1, 5.0), (2, 1, 1.0), (2, 2, 0.0), (3, 1, 1.0), (3, 2, 0.75), (3, 3, 0.5)]


def test_empty_query_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a b")], "id long, t string")
    for bad in ("  ", None):
        with pytest.raises(ValueError):
            search.bm25_scores(docs, spark.createDataFrame([(1, bad)], "q long, x string"), "id", "t", "q", "x")


def test_dense_filters_first(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "a")], "id long, v array<float>, p string")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "q long, qv array<float>")
    got = search.dense_topk(v.where("p = 'a'"), q, "id", "v", "q", "qv", 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3]
    top1 = search.dense_topk(v, q, "id", "v", "q", "qv", 1).collect()
    assert [r.id for r in top1] == [1]


@pytest.mark.parametrize(
    ("path", "gone"),
    [("a/node_modules/x.js", True), (".env", True), (".env.example", False), (".env.local", True), ("src/a.ts", False), ("x.log", True), ("dist/a/b.c", True), ("distant/a.c", False), ("Cargo.lock", True)],
)
def test_ignore(spark, path, gone):
    assert one(spark, ingest.ignored(F.lit(path), ingest.IGNORED)) is gone


def test_ignore_patterns(spark):
    assert one(spark, ingest.ignored(F.lit("a/b/c.txt"), ["/a/**/*.txt"])) is True
    assert one(spark, ingest.ignored(F.lit("x/a/c.txt"), ["/a/*.txt"])) is False
    assert one(spark, ingest.ignored(F.lit("build/keep.txt"), ["build/", "!build/keep.txt"])) is False
    assert one(spark, ingest.parse_ignore(F.lit("# c\n\n *.a \r\nb/"))) == ["*.a", "b/"]


def test_classification(spark):
    for path, lang, kind in [("a/b.TSX", "typescript", "code"), ("Dockerfile", "dockerfile", "code"), ("x.unknown", "text", "docs"), ("s.less", "css", "style"), ("q.sql", "sql", "data")]:
        assert one(spark, ingest.language(F.lit(path))) == lang
        assert one(spark, ingest.file_type(ingest.language(F.lit(path)))) == kind
    assert one(spark, ingest.is_binary(F.lit("a.min.js"))) is True and one(spark, ingest.is_binary(F.lit("a.js"))) is False


def test_text_functions(spark):
    assert one(spark, T.file_refs(F.lit("@a.ts (@b/c.ts), x@y.z @a.ts"))) == ["a.ts", "b/c.ts"]
    assert one(spark, T.without_file_refs(F.lit("@a.ts how  does it work?"))) == "how does it work?"
    assert one(spark, T.snippet(F.lit("Line 1\n Line 2"), 20)) == "Line 1 Line 2" and one(spark, T.snippet(F.lit("Hello world"), 5)) == "Hello..."
    assert one(spark, T.line_range(F.lit(3), F.lit(3))) == "3" and one(spark, T.line_range(F.lit(3), F.lit(9))) == "3-9"
    assert one(spark, T.human_bytes(F.lit(133_600_000))) == "127.4 MB" and one(spark, T.human_bytes(F.lit(0))) == "0 Bytes"
    assert one(spark, T.estimate_tokens(F.lit("12345"))) == 2


def test_routing(spark):
    names = F.array(F.lit("web-app"), F.lit("api"))
    cases = {
        "Compare web-app and API": ("MULTI_PROJECT", 0.95), "compare api with others": ("MULTI_PROJECT", 0.85), "how does api work": ("SINGLE_PROJECT", 0.9),
        "what is in this repo": ("SINGLE_PROJECT", 0.85), "compare caches": ("GENERAL", 0.6), "caching": ("GENERAL", 0.5), "Where is X?": ("SINGLE_PROJECT", 0.85), "apis": ("GENERAL", 0.5),
    }
    for q, want in cases.items():
        x = spark.range(1).select(F.lit(q).alias("q")).withColumns({"n": F.size(routing.mentions(F.col("q"), names)), "s": F.size(routing.contained(F.col("q"), routing.SEVERAL)), "c": F.size(routing.contained(F.col("q"), routing.CURRENT))})
        kind, sure = routing.intent(F.col("n"), F.col("s"), F.col("c"))
        assert tuple(x.select(kind, sure).first()) == want, q
    assert one(spark, F.size(routing.contained(F.lit("Where is X?"), routing.CURRENT, whole_words=True))) == 0
    assert one(spark, routing.contained(F.lit("inconsistent"), routing.SEVERAL)) == ["consistent", "inconsistent"]


def test_context(spark):
    rows = [(1, 1, "alpha beta gamma delta"), (1, 2, "alpha beta gamma delta"), (1, 3, "other words"), (1, 4, "x" * 40)]
    d = spark.createDataFrame(rows, "q long, rank long, content string")
    assert sorted(r.rank for r in context.dedupe(d, "q", "content").collect()) == [1, 3, 4]
    place = {r.rank: r.p for r in d.select("rank", context.sandwich(F.col("rank"), F.lit(4)).alias("p")).collect()}
    assert place == {1: 1, 3: 2, 4: 3, 2: 4}
    assert [r.rank for r in context.budget(d, "q", "content", 7).orderBy("rank").collect()] == [1, 2]
    assert one(spark, context.truncated(F.lit("aaaaaaaaa\nbbbb"), F.lit(11))) == "aaaaaaaaa\n\n[... content truncated ...]"


def test_trend(spark):
    d = spark.createDataFrame([("p", 1, 0.5), ("p", 2, 0.55), ("p", 3, 0.7), ("p", 4, 0.6)], "p string, t long, m double")
    assert [r.direction for r in evaluate.trend(d, ["p"], "t", ["m"]).orderBy("t").collect()] == ["first", "stable", "improved", "regressed"]


def test_extraction():
    js = extract.js_segments("/** Doc */\nexport function f(a) {\n  return '}';\n}\nconst g = async (x) => { return x; };\nclass C {}\ntype T = string;\n")
    assert [(r[3], r[4], r[0], r[1]) for r in js] == [("doc", None, 1, 1), ("function", "f", 2, 4), ("arrow", "g", 5, 5), ("class", "C", 6, 6), ("type", "T", 7, 7)]
    py = extract.python_segments('"""M."""\nclass A:\n    """D."""\n    def f(self):\n        pass\n')
    assert [(r[2], r[3], r[4]) for r in py] == [("docs", "docstring", None), ("code", "class", "A"), ("docs", "docstring", "A"), ("code", "function", "f")]
    assert extract.python_segments("def (") == [(1, 1, "code", "module", None, "def (")] and extract.js_segments("") == []


def test_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, p string")
    path = f"file://{tmp_path}/t"
    with pytest.raises(ValueError):
        tables.read_table(spark, path)
    tables.append(d, path, "p")
    before = tables.read_table(spark, path)
    assert tables.swap_partitions(spark.createDataFrame([(9, "b"), (10, "c")], "id long, p string"), path, "p") == (2, 2)
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(before) == [1, 2, 3] and ids(tables.read_table(spark, path)) == [1, 9, 10]  # a reader keeps the state it began with
    with pytest.raises(ValueError):
        tables.swap_partitions(d.limit(0), path, "p")
    tables.append(d, path, "p")
    tables.drop_partitions(spark, path, ["c"])
    now = tables.read_table(spark, path)
    assert now.columns == ["id", "p"] and ids(now) == [1, 1, 2, 3, 9]
    assert tables.vacuum(spark, path) == 2 and ids(tables.read_table(spark, path)) == [1, 1, 2, 3, 9]


def test_a_faster_writer_is_not_lost(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(1, "a")], "id long, p string")
    path = f"file://{tmp_path}/t"
    tables.append(d, path, "p")
    real, raced = tables.state, []

    def late(s, p):
        found = real(s, p)
        if not raced:
            raced.append(1)
            tables.append(d, path, "p")  # between reading the state and writing the next
        return found

    monkeypatch.setattr(tables, "state", late)
    tables.append(d, path, "p")
    assert tables.read_table(spark, path).count() == 3


def test_store(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, p string")
    bad = store.validated(d, {"id": F.col("id") < 3}, strict=True)
    with pytest.raises(Exception, match="invalid row"):
        bad.collect()
    assert store.relative_start("7d") == "INTERVAL 7 DAY" and store.relative_start("soon") is None


def test_streams(spark, tmp_path):
    from siltstone.streaming import traces

    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 02:00:00", 4.0), (2, "2024-01-02 00:00:00", 8.0)]
    batch = spark.createDataFrame(rows, "u long, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    q = traces.tumbling(stream, ["u"], "v").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.start, r.u)
    assert sorted(spark.table("tumbled").collect(), key=key) == sorted(traces.tumbling(batch, ["u"], "v").collect(), key=key)
    assert sorted(r.n for r in traces.sessions(batch, "u").collect()) == [1, 1, 2]
    traces.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/c", "u").awaitTermination()
    traces.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/c", "u").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_scan(spark, tmp_path):
    from siltstone.sources.files import scan_directory

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TS").write_text("hi")
    (tmp_path / ".hidden").write_text("no")
    got = scan_directory(spark, str(tmp_path)).collect()
    assert [(r.relative_path, r.size, r.extension) for r in got] == [("a/x.TS", 2, "ts")]


def test_scan_rules(spark, tmp_path):
    from siltstone.sources.files import scan_tree

    for path in ("a.ts", "b/c.py", "b/d/e.md", "b/d/f/g.ts", "node_modules/x.js", "img.png", "b/x.min.js", ".env", "own/skip.ts", "keep.log", "extra/z.ts"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / ".gitignore").write_text("# own\nown/\n!keep.log\n")
    (tmp_path / "link.ts").symlink_to(tmp_path / "a.ts")
    (tmp_path / "b" / "loop").symlink_to(tmp_path / "extra")
    found = lambda **k: sorted(r.relative_path for r in scan_tree(spark, str(tmp_path), **k).collect())
    assert found() == ["a.ts", "b/c.py", "b/d/e.md", "b/d/f/g.ts", "extra/z.ts", "keep.log"]
    assert found(max_depth=2) == ["a.ts", "b/c.py", "extra/z.ts", "keep.log"]
    assert found(extensions=[".TS", "py"], extra_patterns=["extra"]) == ["a.ts", "b/c.py", "b/d/f/g.ts"]
    assert "link.ts" in found(follow_links=True)
    (row,) = scan_tree(spark, f"file://{tmp_path}", extensions=["md"]).collect()
    assert (row.root, row.size) == (f"file://{tmp_path}", 1)
    with pytest.raises(Exception, match="(?i)path"):
        scan_tree(spark, f"{tmp_path}/absent").collect()


def test_markdown_blocks(spark):
    md = "intro\nmore\n\n## Head\n- a\n  b\nc\n```py\nx = 1\n\n# no head\n```\n| t |\n---\n> q\nlazy\n<p>\n"
    d = spark.createDataFrame([(1, md), (2, "\n---\n"), (3, "   \n"), (4, "---\n***"), (5, None), (6, "```\nopen")], "id long, md string")
    got = ingest.markdown_blocks(d, "id", "md").orderBy("id", "start_line").collect()
    rows = [(r.start_line, r.end_line, r.kind, r.content_type, r.section, r.content) for r in got if r.id == 1]
    assert rows == [
        (1, 2, "paragraph", "docs", None, "intro\nmore"), (4, 4, "heading", "docs", "Head", "## Head"), (5, 7, "list", "docs", "Head", "- a\n  b\nc"), (8, 12, "code", "code", "Head", "x = 1\n\n# no head"),
        (13, 13, "table", "docs", "Head", "| t |"), (15, 16, "blockquote", "docs", "Head", "> q\nlazy"), (17, 17, "html", "docs", "Head", "<p>"),
    ]
    assert [(r.id, r.kind, r.start_line, r.end_line) for r in got if r.id != 1] == [(2, "document", 1, 3), (4, "document", 1, 2), (6, "code", 1, 2)]


def test_size_policy(spark):
    d = spark.createDataFrame([(1, "code", "x" * 3000), (2, "config", "y" * 3000), (3, "docs", "z" * 3000), (4, "docs", "short"), (5, "odd", "w" * 5000)], "id long, t string, c string")
    n = {r.id: r.k for r in ingest.policy_chunks(d, "id", "c", "t").groupBy("id").agg(F.count(F.lit(1)).alias("k")).collect()}
    assert n == {1: 2, 2: 4, 3: 1, 5: 2}
    (row,) = ingest.whole_segments(d.withColumn("c", F.concat("c", F.lit("\na"))), "c", "t").collect()
    assert (row.id, row.start_line, row.end_line, row.content_type) == (2, 1, 2, "config")


def test_protocols(spark):
    def embedder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(t)), 1.0] for t in texts]

    d = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "ccc")], "id long, t string").coalesce(1)
    got = {r.id: (r.embedding, r.error) for r in extract.embed(d, "id", "t", embedder, batch=2).collect()}
    assert got == {1: ([1.0, 1.0], None), 2: (None, "ValueError: bad text"), 3: (None, None), 4: ([3.0, 1.0], None)}
    c = spark.createDataFrame([(1, 10, "q", "aa", 1), (1, 11, "q", "aaaa", 2), (2, 10, "r", "b", 1)], "qid long, id long, query string, t string, rank long")
    scores = extract.scored_by(c, "qid", "id", "query", "t", lambda q, texts: [len(t) for t in texts])
    assert [(r.qid, r.id) for r in search.rerank(c.select("qid", "id", "rank"), scores, "qid", "id").orderBy("qid", "new_rank").collect()] == [(1, 11), (1, 10), (2, 10)]
    with pytest.raises(Exception, match="no candidate"):
        search.rerank(c.where("id = 10").select("qid", "id", "rank"), scores, "qid", "id").collect()
    (seg,) = extract.segments_by(d.where("id = 4"), "id", "t", lambda t: [(1, 1, "docs", "line", None, t.upper())]).collect()
    assert seg.content == "CCC"


def test_hashed_embeddings_agree(spark):
    d = spark.createDataFrame([(1, "Some words, some words"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.embedding for r in extract.embed_hash(d, "id", "t").collect()}
    assert got[1] == pytest.approx(extract.hashed_vectors(["Some words, some words"])[0].tolist()) and set(got[2] + got[3]) == {0.0}


def test_postings_once(spark):
    """The corpus is read in one job; frequencies, lengths and both scores come from what was written."""
    d = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, None), (4, "")], "id long, t string")
    q = spark.createDataFrame([(9, "a b z")], "q long, x string")
    x = search.lexical_scores(d, q, "id", "t", "q", "x")
    assert {r.id: r.coverage for r in x.collect()} == {1: round(2 / 3, 6), 2: round(1 / 3, 6)}
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "postings" in plan and "split(lower(t#" not in plan


def test_holders(spark):
    text = "one two three four five six"
    d = spark.createDataFrame([(1, f"x {text} y"), (2, f"zz{text}s"), (3, "one two three four five sx"), (4, "tiny bit"), (5, None)], "id long, t string")
    items = spark.createDataFrame([(1, text), (2, "iny b"), (3, "none of it is in any text"), (4, "two three four")], "item long, x string")
    got = {(r.item, r.id) for r in search.holders(d, items, "id", "t", "item", "x").collect()}
    assert got == {(1, 1), (1, 2), (2, 4), (4, 1), (4, 2), (4, 3)}


def test_router_with_and_without_a_model(spark):
    every = F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"))
    named = lambda *n: F.array(*map(F.lit, n)) if n else F.array().cast("array<string>")
    none, here = F.lit(None).cast("string"), F.lit("p3")
    said = lambda text: routing.reply(F.lit(text), every)
    cases = [
        (("SINGLE_PROJECT", 0.9, named("p2"), here, None), (["p2"], "heuristic", 0.9)), (("SINGLE_PROJECT", 0.85, named(), here, None), (["p3"], "heuristic", 0.85)),
        (("SINGLE_PROJECT", 0.85, named(), none, None), (["p1", "p2", "p3"], "fallback_all", 0.5)), (("MULTI_PROJECT", 0.95, named("p1", "p2"), none, None), (["p1", "p2"], "heuristic", 0.95)),
        (("GENERAL", 0.5, named(), here, None), (["p3"], "fallback_all", 0.6)), (("GENERAL", 0.5, named(), here, 'x {"projectIds": ["p2", "q"], "confidence": 0.7}'), (["p2"], "llm", 0.7)),
        (("GENERAL", 0.5, named(), here, '{"projectIds": ["p2"], "confidence": 0.69}'), (["p1", "p2", "p3"], "fallback_all", 0.69)), (("GENERAL", 0.5, named(), here, '{"projectIds": ["q"], "confidence": 0.9}'), (["p1", "p2", "p3"], "fallback_all", 0.0)),
        (("GENERAL", 0.5, named(), here, "no braces"), (["p1", "p2", "p3"], "fallback_all", 0.5)), (("MULTI_PROJECT", 0.95, named("p1"), here, '{"projectIds": ["p2"], "confidence": 0.9}'), (["p1"], "heuristic", 0.95)),
    ]
    for (kind, sure, n, cur, text), want in cases:
        got = spark.range(1).select(*routing.route(F.lit(kind), F.lit(sure), n, cur, every, said(text) if text else None)).first()
        assert tuple(got) == want, (kind, text)
    nothing = spark.range(1).select(*routing.route(F.lit("GENERAL"), F.lit(0.5), named(), here, named())).first()
    assert tuple(nothing) == ([], "fallback_all", 1.0)


def test_references_within_a_total(spark):
    m = spark.createDataFrame([("p", 0, 1, "a"), ("p", 0, 2, "b"), ("q", 1, 1, "c"), ("q", 1, 2, "d")], "pattern string, k int, place int, path string")
    f = spark.createDataFrame([("a", "x" * 30), ("b", "y" * 30), ("c", "z" * 45 + "\n" + "w" * 40), ("d", "v")], "path string, text string")
    got = {r.path: r.text for r in context.with_content(m, f, "k", "path", "text", 110).collect()}
    assert got == {"a": "x" * 30, "b": "y" * 30, "c": "z" * 45 + "\n\n[... content truncated ...]"}


def test_run_notes(spark):
    notes = lambda *n: one(spark, evaluate.run_notes(*map(F.lit, n)))
    assert notes(2, 3, 0, 0) == "status:completed | 2/3 passed"
    assert notes(0, 0, 4, 5) == "status:completed | 0/0 passed | 4 skipped (no expectedFilePaths) | 5 filtered by tags"


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("q", "an answer", ["a", "b"], ["c"]), ("r", "", ["a", "b"], []), ("", "x", [], [])], "query string, answer string, expected array<string>, retrieved array<string>")
    path = f"file://{tmp_path}/new/folders/ragas"
    store.write_json(evaluate.ragas(d), path)
    got = {r.question: (r.answer, r.contexts, r.ground_truths) for r in spark.read.schema(evaluate.ragas(d).schema).json(path).collect()}
    assert got == {"q": ("", ["c"], ["an answer", "a", "b"]), "r": ("", [], ["a", "b"])}
    assert {r.input: r.expected_output for r in evaluate.deepeval(d).collect()} == {"q": "an answer", "r": "a, b"}


def test_windows_and_percentiles(spark, tmp_path):
    from siltstone.streaming import traces

    rows = [("a", "2024-01-01 00:30:00", 1.0), ("a", "2024-01-01 01:30:00", 3.0), ("b", "2024-01-01 02:30:00", 5.0)]
    d = spark.createDataFrame(rows, "u string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted((r.start.hour, r.u, r.n) for r in traces.sliding(d, ["u"], "v", "2 hours", "1 hour").collect())
    assert got == [(0, "a", 2), (1, "a", 1), (1, "b", 1), (2, "b", 1), (23, "a", 1)]
    p = {r.u: (r.n, r.p50) for r in traces.latency(d, ["u"], "v").collect()}
    assert p == {"a": (2, 2.0), "b": (1, 5.0), None: (3, 3.0)}


def test_cancellation(spark):
    import threading
    import time

    from siltstone.operators.steps import cancel, cancellable

    failed = []

    def slow():
        with cancellable(spark, "slow-one"):
            try:
                spark.range(0, 10**13, 1, 4).selectExpr("sum(id % 7)").collect()
            except Exception as e:
                failed.append(e)

    t = threading.Thread(target=slow)
    t.start()
    began = time.time()
    while t.is_alive() and time.time() - began < 60:
        time.sleep(0.5)
        cancel(spark, "slow-one")
    t.join(60)
    assert len(failed) == 1 and spark.range(3).count() == 3


def test_shared_folder(spark, monkeypatch):
    from siltstone.operators import steps

    class Elsewhere:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        conf = {}
        sparkContext = Elsewhere()  # noqa: N815

    with pytest.raises(ValueError, match="share"):
        steps.work_dir(Session())


def test_golden_file(spark, tmp_path):
    (tmp_path / "g.json").write_text('{\n "version": "1.0", "projectName": "p",\n "entries": [{"id": "1", "query": "q", "expectedFilePaths": ["a"], "source": "manual"}, {"id": "2", "query": "r", "source": "manual"}]}')
    got = store.read_golden(spark, str(tmp_path / "g.json")).orderBy("id").collect()
    assert [(r.projectName, r.id, r.expectedFilePaths) for r in got] == [("p", "1", ["a"]), ("p", "2", None)]
    (tmp_path / "h.json").write_text('{"version": "2.0", "projectName": "p", "entries": []}')
    with pytest.raises(Exception, match="unknown version"):
        store.read_golden(spark, str(tmp_path / "h.json")).collect()
    (tmp_path / "i.json").write_text('{"version": "1.0", "projectName": "", "entries": [{"id": "1", "query": "", "source": "made"}]}')
    with pytest.raises(Exception, match="projectName: empty; entries.query: empty; entries.source: unknown"):
        store.read_golden(spark, str(tmp_path / "i.json")).collect()
    assert store.read_golden(spark, f"{tmp_path}/absent.json").count() == 0
    entries = spark.createDataFrame([("1", "q", ["a"])], "id string, query string, expectedFilePaths array<string>")
    store.save_golden(entries, "p", f"{tmp_path}/new/set")
    assert [(r.id, r.query, r.expectedFilePaths, r.source) for r in store.read_golden(spark, f"{tmp_path}/new/set", lines=True).collect()] == [("1", "q", ["a"], "manual")]
