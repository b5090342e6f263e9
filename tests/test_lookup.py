"""Substrings and names against loops over all pairs."""

from __future__ import annotations

import random
import re

from siltstone.operators import context, lookup
from siltstone.plans import catalog
from tests.oracle import DATA


def test_containing(spark):
    rng = random.Random(1)
    paths = ["/".join("".join(rng.choices("abAB.é", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 4))) for _ in range(300)] + [None, "", "ab", "ab", "a.b\\%_"]
    patterns = ["a", "AB", "ab.", "aba/", "/b", "é", "zzz", "", None, "a", "bab.a", "\\%_"]
    p = spark.createDataFrame(list(enumerate(patterns)), "k int, pattern string")
    t = spark.createDataFrame(list(enumerate(paths)), "n int, path string")
    got = sorted((r.k, r.n) for r in lookup.containing(p, lookup.postings(t, "path"), "pattern", "path").collect())
    assert got == sorted((k, n) for k, x in enumerate(patterns) for n, y in enumerate(paths) if x and y and x.lower() in y.lower())


def test_the_rarest_run_is_asked(spark):
    t = spark.createDataFrame([(f"src/file{k}.md",) for k in range(50)] + [("src/xyz.md",)], "path string")
    p = spark.createDataFrame([("yz.md",), ("nowhere",)], "pattern string")
    (row,) = lookup.rarest(p, lookup.postings(t, "path"), "pattern").collect()
    assert (row._low, row._gram) in {("yz.md", "yz."), ("yz.md", "z.m")}


def test_files_of_a_pattern(spark):
    t = spark.createDataFrame([("a/app.ts",), ("b/app.ts",), ("b/app.tsx",), ("x/my-app.ts",), ("app.ts/readme",)], "path string")
    p = spark.createDataFrame([("App.ts", 0)], "pattern string, k int")
    got = sorted((r.place, r.path, r.score) for r in context.match_files(p, t, "pattern", "path", 5).collect())
    assert [(x, s) for _, x, s in got] == [("a/app.ts", 1.0), ("b/app.ts", 1.0), ("b/app.tsx", 0.8), ("x/my-app.ts", 0.6), ("app.ts/readme", 0.4)]


def test_mentioned(spark):
    names = ["api", "my-app", "My App", "c++", "", " ", None, ".net", "a.b*c", "src1", "API"]
    texts = ["the API and my-app", "my app, my-apps", "c++x or c++", "asp.net, .net", "a.b*c here", "src10 src1", "rapid", None, "", "api api"]
    n = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    t = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    got = sorted((r.i, r.k) for r in lookup.mentioned(t, n, "q", "name").collect())
    want = [(i, k) for i, q in enumerate(texts) for k, x in enumerate(names) if q and x and x.strip() and re.search(rf"\b{re.escape(x.lower())}\b", q.lower())]
    assert got == sorted(want)


def test_no_pattern_meets_every_text(spark):
    for name in ("resolve_file_refs", "complete_path", "detect_projects"):
        plan = catalog.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
