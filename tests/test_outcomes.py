"""Golden entries added and removed, deletions that count, appends that check, forced routes and plans, first entries by query."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluate, extract, routing, store, tables


def test_golden_entries_come_and_go(spark, tmp_path):
    path = f"file://{tmp_path}/sets/p"
    made = store.add_golden(spark, "p", path, spark.createDataFrame([("a?", ["x.md"]), ("b?", ["y.md", "z.md"])], "query string, expectedFilePaths array<string>"))
    store.add_golden(spark, "p", path, spark.createDataFrame([("c?", "yes")], "query string, expectedAnswer string"))
    got = store.read_golden(spark, path, lines=True)
    assert sorted(r.query for r in got.collect()) == ["a?", "b?", "c?"] and got.select("id").distinct().count() == 3
    (a,) = made.where("query = 'a?'").collect()
    assert store.remove_golden(spark, "p", path, ["absent"]) == 0 == store.remove_golden(spark, "p", path, [])
    assert store.remove_golden(spark, "p", path, [a.id]) == 1
    assert sorted((r.query, r.expectedAnswer) for r in store.read_golden(spark, path, lines=True).collect()) == [("b?", None), ("c?", "yes")]
    for query, files in ((" ", ["x"]), (None, ["x"]), ("d?", []), ("d?", None)):
        with pytest.raises(ValueError, match="entry"):
            store.add_golden(spark, "p", path, spark.createDataFrame([(query, files)], "query string, expectedFilePaths array<string>"))
    assert store.read_golden(spark, path, lines=True).count() == 2


def test_deletion_counts_first_and_names_what_is_absent(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    child = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "w")], "pid long, v string")
    ids = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    left, kept, counts = store.delete_parents(parents, "id", ids, {"chunks": (child, "pid")})
    assert [r.id for r in left.collect()] == [3] and sorted(r.v for r in kept["chunks"].collect()) == ["w", "z"]
    assert sorted(tuple(r) for r in counts.collect()) == [("chunks", 1, 2), ("chunks", 2, 0)]
    with pytest.raises(LookupError, match="9"):
        store.delete_parents(parents, "id", spark.createDataFrame([(1,), (9,)], "id long"), {})
    assert store.delete_parents(parents, "id", ids, {})[2].count() == 0


def test_an_invalid_row_leaves_the_table_as_it_was(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    rules = {"score": F.col("score").between(0, 1)}
    rows = lambda *x: spark.createDataFrame(list(x), "project string, score double")
    store.append_valid(rows(("p", 0.5)), path, "project", rules)
    for bad in (2.0, None):
        with pytest.raises(Exception, match="invalid row: score"):
            store.append_valid(rows(("p", 0.1), ("q", bad)), path, "project", rules)
    assert [tuple(r) for r in tables.read_table(spark, path).select("project", "score").collect()] == [("p", 0.5)]


def test_forced_routes(spark):
    d = spark.createDataFrame([(["a"], "llm", 0.4), ([], "llm", 0.4), (["a"], "heuristic", 0.5), ([], "heuristic", 0.9), (None, "llm", None)], "ids array<string>, m string, c double")
    ids, method = routing.forced(F.col("ids"), F.col("m"), F.col("c"), F.array(F.lit("a"), F.lit("b")))
    got = [(r[0], r[1]) for r in d.select(ids, method).collect()]
    assert got == [(["a"], "force-rag"), (["a", "b"], "force-rag"), (["a"], "heuristic"), ([], "heuristic"), (["a", "b"], "force-rag")]


def test_plans_and_lost_capabilities(spark):
    d = spark.createDataFrame([("simple",), ("complex",), ("conversational",), ("factual",), (None,)], "k string")
    got = [tuple(r[0]) for r in d.select(routing.retrieval_plan(F.col("k"), 5)).collect()]
    assert got == [(True, "no retrieval for a simple question", 0, False, False), (False, None, 10, True, False), (False, None, 5, False, True), (False, None, 5, False, False), (False, None, 5, False, False)]
    can = spark.createDataFrame([("a", "tools"), ("a", "tools"), ("a", "json"), ("b", "json")], "provider string, ability string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "none")], "provider string, fallback string")
    assert sorted(tuple(r) for r in routing.lost_capabilities(can, pairs).collect()) == [("a", "b", "tools", 1), ("a", "none", "json,tools", 2), ("b", "a", "", 0)]


def test_first_entry_of_the_same_query(spark):
    results = spark.createDataFrame([("q", 1), ("q", 2), ("none", 3), (None, 4)], "query string, n int")
    entries = spark.createDataFrame([(7, "q", "second"), (3, "q", "first"), (1, None, "null"), (2, "Q", "other")], "k int, query string, answer string")
    assert sorted((r.n, r.answer) for r in evaluate.with_entries(results, entries, "query", "k").collect()) == [(1, "first"), (2, "first"), (3, None), (4, None)]


def test_programs_with_quotes_in_odd_places():
    program = """/** Doc. */
export function one(a) {
  x.replace(/'/g, '');
  return a / 2 / 3;
}
function two() { return `a ${b ? `}` : '{'} c
function no() {}
`; }
// function three() {
/*
function four() {}
*/
export const five = (x) => x + 1
const six = (x) => { return x; };
type Seven = { a: string }
interface Eight { a: /* } */ string }
export default class Nine { m() { if (/[/}]\\/{/.test(s)) return 1; } }
type Ten = string
function eleven({ a }, b = "}") { return a; }
"""
    got = [(r[0], r[1], r[3], r[4]) for r in extract.js_segments(program)]
    assert got == [
        (1, 1, "doc", None), (2, 5, "function", "one"), (6, 8, "function", "two"), (13, 13, "arrow", "five"), (14, 14, "arrow", "six"), (15, 15, "type", "Seven"),
        (16, 16, "interface", "Eight"), (17, 17, "class", "Nine"), (18, 18, "type", "Ten"), (19, 19, "function", "eleven"),
    ]
    for broken in ("", "`", "`${", "}", "function f(", "'", "/", "/*", "type A", "`${`${", "// x\n" * 40_000):
        extract.js_segments(broken)
