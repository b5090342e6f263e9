"""State across micro-batches: what became of each trace, and rates of progress with the time that is left.

`fates` tells new traces from repeated and late ones; its state is one timestamp for each id, dropped when the watermark has
passed it by `keep`. Ids are dealt to a fixed number of buckets, whose state is read and written as a whole: Python and the
state store talk once for each bucket of a batch, not for each trace. `progress` counts traces by tick with Spark's own
aggregation, so that a key's traces meet as one row a tick whatever their number, and carries the last rates of each key
along; a key that has been idle is ended by a timer. Results don't depend on how the rows are cut into batches, as long as
none is late. Both keep their state in RocksDB and are started with `started`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from siltstone.streaming.traces import event_time

#: Weight of the newest rate, and how many rates are kept.
ALPHA, HISTORY = 0.3, 10
#: Ids, and traces without one, are dealt over this many keys of the state.
BUCKETS = 4096

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a stream with its state in RocksDB; the session's own setting stays."""
    with _rocksdb(spark):
        return writer.start()


def millis(duration: str) -> int:
    """`90 seconds`, `1 hour` or `2 days` as milliseconds. ValueError for anything else."""
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    n, _, unit = duration.partition(" ")
    if not n.isdigit() or unit.rstrip("s") not in units:
        raise ValueError(f"not a duration: {duration}")
    return int(n) * units[unit.rstrip("s")] * 1000


class _Fates(StatefulProcessor):
    """Rows are read by position: their columns, the time in microseconds, and what else `fates` has put behind them."""

    def __init__(self, columns: list[str], name: int, at: int, keep: int) -> None:
        self.columns, self.name, self.at, self.keep = columns, name, at, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.out = Row(*self.columns, "fate")
        self.first = handle.getValueState("firsts", "ids array<string>, at array<bigint>, due bigint")

    def _held(self, now: int) -> tuple[dict[str, int], int | None, bool]:
        """The bucket's ids and when each came first, without those to be forgotten by `now`; when all of them are; whether some were left out."""
        ids, at, due = self.first.get() or ((), (), None)
        seen = {i: t for i, t in zip(ids, at, strict=True) if t + self.keep >= now}
        return seen, due, len(seen) < len(ids)

    def _hold(self, seen: dict[str, int], due: int | None) -> None:
        """Puts the ids back, with a timer for when the last of them is to be forgotten."""
        ends = max(seen.values()) + self.keep if seen else None
        if due is not None and due != ends:
            self.handle.deleteTimer(due)
        if ends is None:
            self.first.clear()
            return
        if due != ends:
            self.handle.registerTimer(ends)
        self.first.update((list(seen), list(seen.values()), ends))

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs()
        seen, due, changed = self._held(now)
        width = len(self.columns)
        for r in rows:
            us, name = r[self.at], r[self.name]
            if us is None:
                fate = "undated"
            elif us // 1000 < now:
                fate = "late"
            elif name is None:
                fate = "unnamed"
            elif (name := str(name)) in seen:
                fate = "repeat"
            else:
                fate, seen[name], changed = "new", us // 1000, True
            yield self.out(*r[:width], fate)
        if changed:
            self._hold(seen, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen, due, _ = self._held(timerValues.getCurrentWatermarkInMs())
        self._hold(seen, due)
        return iter([])

    def close(self) -> None:
        pass


def fates(stream: DataFrame, id_col: str, at: str = "ts", late: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """The rows of a stream with `fate`: new, repeat (its id came before, within `keep`), late (older than the watermark), unnamed (no id), undated (no time).

    No row is dropped: `traces.ingest(..., partition="fate")` gives late rows and repeats folders of their own. Ids may repeat
    any number of times, their rows pass one by one. Columns named _key, _bucket or fate are refused.
    """
    taken = {"_key", "_bucket", "fate"} & set(stream.columns)
    if taken:
        raise ValueError(f"columns with names that are used inside: {sorted(taken)}")
    d = event_time(stream, at).withWatermark(at, late)
    key = F.col(id_col).cast("string")
    bucket = F.pmod(F.when(key.isNull(), F.xxhash64(*[F.col(c).cast("string") for c in d.columns])).otherwise(F.xxhash64(key)), F.lit(BUCKETS)).cast("int")
    # The time is a number, no longer the watermark's column: Spark would drop late rows before they are seen.
    free = d.withColumns({"_bucket": bucket, at: F.unix_micros(at)})
    plain = isinstance(d.schema[id_col].dataType, (StringType, ByteType, ShortType, IntegerType, LongType))  # str() is Spark's cast
    free = free if plain else free.withColumn("_key", key)
    out = StructType([StructField(f.name, f.dataType, True) for f in [*free.select(*d.columns).schema.fields, StructField("fate", StringType())]])
    told = _Fates(d.columns, free.columns.index(id_col if plain else "_key"), d.columns.index(at), millis(keep))
    return free.groupBy("_bucket").transformWithState(told, out, "Append", "EventTime").withColumn(at, F.timestamp_micros(at))


class _Progress(StatefulProcessor):
    def __init__(self, by: str, width: int, idle: int) -> None:
        self.by, self.width, self.idle = by, width, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "last bigint, done bigint, goal bigint, rates array<double>")

    def _row(self, key, at, kind, done, goal, rates):
        rate = rates[0] if rates else 0.0
        for r in rates[1:]:
            rate = ALPHA * r + (1 - ALPHA) * rate
        left = None if goal is None else goal - done
        eta = math.ceil(left / rate) if left is not None and left > 0 and rate > 0 else None
        return Row(**{self.by: key[0]}, at_ms=at, status=kind, processed=done, rate=rate, eta=eta)

    def handleInputRows(self, key, rows, timerValues):
        last, done, goal, rates = self.state.get() if self.state.exists() else (None, 0, None, [])
        if last is not None:
            self.handle.deleteTimer(last + self.idle + self.width)
        rates = list(rates)
        # A key's ticks of one batch: as many as the time it spans has, whatever the number of traces.
        for r in sorted(rows, key=lambda r: r["_end"]):
            if last is not None and r["_end"] - self.width - last > self.idle:
                yield self._row(key, last + self.idle, "stalled", done, goal, [])
                last, done, rates = None, 0, []
            if last is not None:
                rates = [*rates, r["n"] * 1000 / (r["_end"] - last)][-HISTORY:]
            last, done, goal = r["_end"], done + r["n"], r["_goal"]
            yield self._row(key, last, "running" if goal is None or done < goal else "done", done, goal, rates)
        self.state.update((last, done, goal, rates))
        # A tick that would still belong to this run ends no later than this.
        self.handle.registerTimer(last + self.idle + self.width)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, done, goal, _ = self.state.get()
        self.state.clear()
        yield self._row(key, last + self.idle, "stalled", done, goal, [])

    def close(self) -> None:
        pass


def progress(stream: DataFrame, by: str, goals: DataFrame | None = None, at: str = "ts", tick: str = "1 minute", idle: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The columns `by`, at_ms, status, processed, rate (a second) and eta (whole seconds): a row for each tick in which a key has traces, and one where it stalls.

    The rate is the mean of the last `HISTORY` rates, weighted to the newest by `ALPHA` and begun with the oldest; a run's first
    tick has rate 0. eta is ceil(left / rate), null without a goal, without a rate or with nothing left. status is running, done
    (the goal is reached) or stalled: no tick begins within `idle` of the last one's end; the next trace begins a new run.
    `goals` (by, goal), one row for each key, is a table; keys without a row have no goal. Rows without key or time are left out.
    """
    d = event_time(stream.where(F.col(by).isNotNull()), at).withWatermark(at, late)
    ticks = d.groupBy(F.window(at, tick), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.unix_millis(F.timestamp_micros(F.unix_micros("window.end"))).alias("_end"), "n")
    if goals is None:
        ticks = ticks.withColumn("_goal", F.lit(None).cast("long"))
    else:
        ticks = ticks.join(goals.select(by, F.col("goal").cast("long").alias("_goal")), by, "left")
    kind = stream.schema[by].dataType.simpleString()
    out = f"`{by}` {kind}, at_ms bigint, status string, processed bigint, rate double, eta bigint"
    return ticks.groupBy(by).transformWithState(_Progress(by, millis(tick), millis(idle)), out, "Append", "EventTime")
