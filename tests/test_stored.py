"""Tables, scans and incremental indexing: what must not be lost, entered or made again."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from siltstone.operators import incremental, steps, tables
from siltstone.sources import files as tree


def rows(d):
    return sorted(map(tuple, d.collect()), key=repr)


def test_append_refuses_rows_that_do_not_fit(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.append(spark.createDataFrame([(1, "a")], "id long, p string"), path, "p")
    for bad, by, what in (("id long, p string, more int", "p", "more: no such column"), ("id string, p string", "p", "id: bigint in the table, string"), ("p string", "p", "id: bigint in the table, absent"), ("id long, p string", "id", "partitioned by p")):
        values = {"id": 1, "p": "b", "more": 2} if "id long" in bad else {"id": "1", "p": "b"}
        d = spark.createDataFrame([{k: v for k, v in values.items() if k in bad}], bad)
        with pytest.raises(tables.SchemaMismatch, match=what):
            tables.append(d, path, by)
        with pytest.raises(tables.SchemaMismatch):
            tables.swap_partitions(d, path, by)
    tables.append(spark.createDataFrame([("b", 2)], "p string, id long"), path, "p")  # another order is no other schema
    assert rows(tables.read_table(spark, path)) == [(1, "a"), (2, "b")]


def test_any_value_is_a_partition(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    values = ["", None, "a/b", "a=b", "x" * 400, "ü %2F\n", ".", "null"]
    tables.append(spark.createDataFrame(list(enumerate(values)), "id long, p string"), path, "p")
    assert rows(tables.read_table(spark, path)) == rows(spark.createDataFrame(list(enumerate(values)), "id long, p string"))
    assert [r.id for r in tables.read_table(spark, path, values=["a/b"]).collect()] == [2]
    assert tables.drop_partitions(spark, path, ["a/b", "", None]) == 3
    assert sorted(r.id for r in tables.read_table(spark, path).collect()) == [3, 4, 5, 6, 7]
    number = tables.state(spark, path)[0]
    with pytest.raises(tables.NoPartition, match="'a/b'"):
        tables.drop_partitions(spark, path, ["null", "a/b"])
    assert tables.state(spark, path)[0] == number and tables.read_table(spark, path).count() == 5


def test_named_errors(spark, tmp_path):
    path, d = f"file://{tmp_path}/t", spark.createDataFrame([(1, 5)], "id long, p int")
    for call in (lambda: tables.swap_partitions(d, path, "p"), lambda: tables.drop_partitions(spark, path, [5]), lambda: tables.read_table(spark, path)):
        with pytest.raises(tables.NoTable, match="no table at"):
            call()
    tables.append(d, path, "p")
    with pytest.raises(tables.EmptyStage):
        tables.swap_partitions(d.limit(0), path, "p")
    assert tables.swap_partitions(d.limit(0), path, "p", emptied=[5]) == (1, 0)
    assert tables.read_table(spark, path).count() == 0


def test_scope_frees_what_steps_wrote(spark, tmp_path):
    with steps.scope(spark):
        folder = steps.work_dir(spark, "x")
        kept = steps.materialize(spark.range(3)).count()
        assert os.path.isdir(folder.removeprefix("file://"))
    assert kept == 3 and not os.path.exists(folder.removeprefix("file://"))


def write(base, *names):
    for n in names:
        (base / n).parent.mkdir(parents=True, exist_ok=True)
        (base / n).write_text("x")


def test_scan_does_not_enter_what_is_ignored(spark, tmp_path, monkeypatch):
    write(tmp_path, "a.ts", "src/b.TS", "src/deep/er/c.ts", "node_modules/pkg/d.ts", "src/node_modules/e.ts", ".git/f.ts", "dist/g.ts", "own/h.ts", "own2/i.ts", "src/j.png")
    (tmp_path / ".gitignore").write_text("own/\n!dist/g.ts\n")
    os.symlink(tmp_path / "src", tmp_path / "link")
    listed = []
    real = os.scandir
    monkeypatch.setattr(tree.os, "scandir", lambda p: listed.append(str(p)) or real(p))
    reader = tree.TreeReader({"path": str(tmp_path), "patterns": '["node_modules", ".git", "dist", "own/", "!dist/g.ts"]', "subtrees": "3"})
    parts = reader.partitions()
    assert sorted(r[0] for p in parts for r in reader.read(p)) == ["a.ts", "own2/i.ts", "src/b.TS", "src/deep/er/c.ts", "src/j.png"]
    assert not [p for p in listed if any(x in p for x in ("node_modules", ".git", "dist", "own/", "link"))] and not [p for p in listed if p.endswith("/own")]
    monkeypatch.undo()
    assert [r.relative_path for r in tree.scan_tree(spark, str(tmp_path)).orderBy("relative_path").collect()] == ["a.ts", "own2/i.ts", "src/b.TS", "src/deep/er/c.ts"]
    assert sorted(r.relative_path for r in tree.scan_tree(spark, str(tmp_path), max_depth=2).collect()) == ["a.ts", "own2/i.ts", "src/b.TS"]


def test_scan_counts_errors(spark, tmp_path, monkeypatch):
    write(tmp_path, "a/x.ts", "b/y.ts")
    real = os.scandir

    def denied(p):
        if str(p).endswith("/a"):
            raise PermissionError(13, "Permission denied")
        return real(p)

    monkeypatch.setattr(tree.os, "scandir", denied)
    for subtrees in ("1", "9"):  # by a task, by the driver
        reader = tree.TreeReader({"path": str(tmp_path), "subtrees": subtrees})
        got = sorted((r for p in reader.partitions() for r in reader.read(p)), key=lambda r: r[0])
        assert [r[0] for r in got] == ["a", "b/y.ts"] and "PermissionError" in got[0][3]
    monkeypatch.undo()
    with pytest.raises(Exception, match="absent"):
        tree.scan_tree(spark, f"{tmp_path}/absent").collect()
    assert tree.scan_tree(spark, str(tmp_path), errors=True).where("error IS NOT NULL").count() == 0


def test_reindex_touches_only_what_changed(spark, tmp_path):
    path, seen = f"file://{tmp_path}/index", []

    def chunker(files):
        seen.append(sorted(r.file for r in files.collect()))
        return files.select("file", F.posexplode(F.split("content", "\n")).alias("no", "content")).where("content <> ''")

    snapshot = lambda d: spark.createDataFrame(sorted(d.items()), "file string, content string")
    first = {f"f{k}": f"a{k}\nb{k}" for k in range(40)} | {"empty": "", "null": None}
    assert incremental.reindex(snapshot(first), path, chunker, buckets=16).new == 42
    before = dict(tables.state(spark, path)[1]["folders"])
    second = {k: v for k, v in first.items() if k != "f3"} | {"f5": "changed", "f99": "new\none"}
    run = incremental.reindex(snapshot(second), path, chunker)
    assert (run.new, run.changed, run.deleted, run.same) == (1, 1, 1, 40) and seen[1] == ["f5", "f99"]
    after = tables.state(spark, path)[1]["folders"]
    assert len(run.buckets) <= 3 and sum(before[k] == after.get(k) for k in before) >= len(before) - 3
    rebuilt = f"file://{tmp_path}/rebuilt"
    incremental.reindex(snapshot(second), rebuilt, chunker, buckets=16)
    assert rows(tables.read_table(spark, path)) == rows(tables.read_table(spark, rebuilt))
    number = tables.state(spark, path)[0]
    assert incremental.reindex(snapshot(second), path, chunker).same == 42 and tables.state(spark, path)[0] == number  # nothing to do
    assert incremental.reindex(snapshot({}), path, chunker).deleted == 42 and incremental.indexed_chunks(spark, path).count() == 0
    with pytest.raises(ValueError, match="f1 2 times"):
        incremental.reindex(snapshot({"f1": "x"}).union(snapshot({"f1": "y"})), path, chunker)


def test_merged_sketches(spark):
    from siltstone.streaming import sketches

    rows = [(f"2024-01-{1 + k % 5:02d} 00:00:00", "ab"[k % 2], float((k * 7919) % 20_000), k % 300) for k in range(20_000)] + [("2024-01-09 00:00:00", "a", None, None)]
    d = spark.createDataFrame(rows, "ts string, kind string, v double, u long").withColumn("ts", F.col("ts").cast("timestamp"))
    days = sketches.day_sketches(d, ["kind"], "v", "u").cache()
    assert days.count() == 11 and days.agg(F.max(F.length("values"))).first()[0] < 10_000  # bounded, whatever the day holds
    (total,) = sketches.merged(days, []).collect()
    assert total.n == 20_001 and abs(total.users / 300 - 1) < 0.03
    for got, share in ((total["p50"], 0.5), (total["p90"], 0.9), (total["p99"], 0.99)):
        assert abs(got / 20_000 - share) < 0.03
    per = {r.kind: r.n for r in sketches.merged(days, ["kind"]).collect()}
    assert per == {"a": 10_001, "b": 10_000}
