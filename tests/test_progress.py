"""Streaming state against plain loops: several micro-batches, one batch, a restart from the checkpoint."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import progress as P
from siltstone.streaming import traces

SCHEMA = "event_id long, user_id long, ts timestamp, note string"
T0 = dt.datetime(2024, 1, 1)


def _put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def _rows(n, seed=1):
    r = random.Random(seed)
    at = sorted(r.randrange(0, 4 * 86400) for _ in range(n))
    return [(k, r.choice([1, 1, 1, 2, 3, 7]), T0 + dt.timedelta(seconds=s), None) for k, s in enumerate(at)]


def _run(spark, stream, out, checkpoint):
    P.started(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True), spark).awaitTermination()


def _loop(rows, goals, tick, idle, late):
    """at, status, processed, rate and eta by user, by loops."""
    ms = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    mark = max(ms(r[2]) for r in rows) - late
    found = []
    for user in {r[1] for r in rows}:
        ends: dict[int, int] = {}
        for r in rows:
            if r[1] == user:
                end = ms(r[2]) // tick * tick + tick
                ends[end] = ends.get(end, 0) + 1
        last, done, rates, goal = None, 0, [], goals.get(user)
        for end in sorted(e for e in ends if e <= mark):
            if last is not None and end - tick - last > idle:
                found.append((user, last + idle, "stalled", done, 0.0, None))
                last, done, rates = None, 0, []
            if last is not None:
                rates = (rates + [ends[end] * 1000 / (end - last)])[-10:]
            last, done = end, done + ends[end]
            rate = 0.0
            for k, x in enumerate(rates):
                rate = x if k == 0 else 0.3 * x + 0.7 * rate
            eta = math.ceil((goal - done) / rate) if goal is not None and goal > done and rate > 0 else None
            found.append((user, end, "done" if goal is not None and done >= goal else "running", done, round(rate, 9), eta))
        if last is not None and mark >= last + idle + tick:
            found.append((user, last + idle, "stalled", done, 0.0, None))
    return sorted(found, key=str)


def test_progress_whatever_the_batches(spark, tmp_path):
    rows, goals = _rows(400), {1: 60, 2: 5}
    want = _loop(rows, goals, 3_600_000, 6 * 3_600_000, 1_800_000)
    assert {"running", "stalled", "done"} == {w[2] for w in want}
    given = spark.createDataFrame(list(goals.items()), "user_id long, goal long")
    for name, cuts in {"one": [0, 400], "several": [0, 90, 91, 230, 400]}.items():
        folder, out, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "check"))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            _put(spark, folder, f"f{k}", rows[a:b])
            if name == "several" and k == 1:  # a stream that ends here and is begun anew from its checkpoint
                _run(spark, P.progress(_read(spark, folder), "user_id", given, tick="1 hour", idle="6 hours", late="30 minutes"), out, check)
        _run(spark, P.progress(_read(spark, folder), "user_id", given, tick="1 hour", idle="6 hours", late="30 minutes"), out, check)
        got = [(r.user_id, r.at_ms, r.status, r.processed, round(r.rate, 9), r.eta) for r in spark.read.parquet(out).collect()]
        assert sorted(got, key=str) == want, name


def test_fates_keep_every_row(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    at = lambda h: T0 + dt.timedelta(hours=h)
    _put(spark, folder, "f0", [(1, 1, at(0), "a"), (1, 1, at(0), "b"), (2, 1, at(10), ""), (None, 1, at(10), None), (3, None, None, "c")])
    traces_of = lambda: P.fates(_read(spark, folder), "event_id", late="1 hour", keep="1 day")
    P_start = lambda: P.started(traces.appender(traces_of(), out, check, "fate"), spark).awaitTermination()
    P_start()
    _put(spark, folder, "f1", [(4, 1, at(3), "too old"), (2, 1, at(10), "again"), (5, 1, at(100), "")])
    P_start()
    _put(spark, folder, "f2", [(2, 1, at(100), "its first is forgotten"), (4, 1, at(99.5), "in time")])
    P_start()
    got = sorted(((r.event_id, r.note, r.fate) for r in spark.read.parquet(out).collect()), key=str)
    firsts = [g for g in got if g[0] == 1]
    assert [f for _, _, f in firsts].count("new") == 1 and [f for _, _, f in firsts].count("repeat") == 1
    assert [g for g in got if g[0] != 1] == sorted(
        [(2, "", "new"), (2, "again", "repeat"), (2, "its first is forgotten", "new"), (3, "c", "undated"), (4, "in time", "new"), (4, "too old", "late"), (5, "", "new"), (None, None, "unnamed")], key=str
    )


def test_empty_streams_clashing_names_and_durations(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    _put(spark, folder, "f0", [])
    _run(spark, P.progress(_read(spark, folder), "user_id"), out, check)
    assert spark.read.schema("user_id long").parquet(out).count() == 0
    with pytest.raises(ValueError, match="fate"):
        P.fates(_read(spark, folder).withColumn("fate", F.lit(1)), "event_id")
    assert (P.millis("90 seconds"), P.millis("1 hour"), P.millis("2 days")) == (90_000, 3_600_000, 172_800_000)
    with pytest.raises(ValueError):
        P.millis("soon")


def test_ids_share_their_state(spark, tmp_path, monkeypatch):
    """Fates by ids that share one bucket: Python asks the state store for each bucket of a batch, not for each id. What is forgotten is forgotten one by one."""
    for buckets in (1, 3):
        monkeypatch.setattr(P, "BUCKETS", buckets)
        folder, out, check = (str(tmp_path / f"{buckets}-{x}") for x in ("in", "out", "check"))
        at = lambda h: T0 + dt.timedelta(hours=h)
        batches = [
            [*[(k, 1, at(k % 5), "a") for k in range(40)], (7, 1, at(2), "b"), (None, 1, at(3), "c"), (None, 2, None, "d")],
            [(k, 1, at(20), "e") for k in range(20, 50)],
            [(60, 1, at(30), "f"), *[(k, 1, at(28.5), "g") for k in (0, 1, 2, 3, 4, 45)]],
            [(k, 1, at(29.5), "h") for k in (0, 1, 3, 4, 45)],
        ]
        for k, rows in enumerate(batches):
            _put(spark, folder, f"f{k}", rows)
            stream = P.fates(_read(spark, folder), "event_id", late="1 hour", keep="1 day")
            P.started(traces.appender(stream, out, check, "fate"), spark).awaitTermination()
        states = spark.read.format("statestore").option("stateVarName", "firsts").load(check).collect()
        rows = spark.read.parquet(out).collect()
        assert len(states) <= buckets and sum(len(s["value"]["ids"]) for s in states) <= 51
        assert sorted(r.fate for r in rows if r.event_id == 7 and r.note in "ab") == ["new", "repeat"]
        assert {(r.event_id, r.note): r.fate for r in rows if (r.event_id, r.note) not in ((7, "a"), (7, "b"))} == {
            **{(k, "a"): "new" for k in range(40) if k != 7}, (None, "c"): "unnamed", (None, "d"): "undated",
            **{(k, "e"): "repeat" if k < 40 else "new" for k in range(20, 50)},
            (60, "f"): "new", **{(k, "g"): "repeat" for k in (0, 1, 2, 3, 4, 45)},
            **{(k, "h"): "new" for k in (0, 1, 3, 4)}, (45, "h"): "repeat",  # by the watermark, 29 hours, what came first at 0 to 4 hours is forgotten
        }
