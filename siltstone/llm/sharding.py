"""Sharding by balanced label propagation.

Documents with equal texts are linked. Groups of at least a quarter of a shard are few; they start together, the
largest first, each in the shard that it fills best. The others start in a shard by hash, in proportion to the room
that is left; in each round every group of links counts its
members by shard, and members elsewhere move to the shard that can hold most of the group, the most common one
first, under quotas: a shard takes movers up
to its capacity, counting the places that leave it and those that documents without links can free. A last step
makes the sizes even, moving documents without links first. Only a group that is larger than a shard is cut,
into parts of a whole shard and what is left, each of which moves by itself.

The law is `rows`: shards differ by one document at most. Ranks within a shard come from counts of small hash
buckets and a row number within each, so that no task gets a shard or a group. What the driver sees is a table of
shards by shards.

Defined results: a null text counts as an empty one, and empty texts are linked like any others; repeated rows are
placed one by one; a null doc_id is placed like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import materialize, small

SHARDS, ROUNDS, PER_BUCKET = 40, 5, 20_000


def _pick(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), index)


def _chance(*cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def linked_rows(docs: DataFrame, total: int | None = None, shards: int = SHARDS) -> DataFrame:
    """rid, doc_id, size, text_crc32, h (hash of the row), unit (the part of a group it moves with; null without links), members of the unit."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"),
    )
    base = materialize(base.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")), "rows")
    n = base.count() if total is None else total
    groups = materialize(base.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "groups")
    base = base.join(small(groups), "g", "left")
    out = ("rid", "doc_id", "size", "text_crc32", "h", "unit", "members")
    most, whole = max(1, -(-n // shards)), max(1, n // shards)
    fits = base.where(F.col("k").isNull() | (F.col("k") <= most)).withColumn("unit", F.when(F.col("k").isNotNull(), F.xxhash64("g", F.lit(0)))).withColumn("members", F.col("k"))
    if not groups.where(F.col("k") > most).limit(1).count():
        return fits.select(*out)
    hot = base.where(F.col("k") > most).withColumn("bucket", F.pmod(F.xxhash64("h", "rid"), F.ceil(F.col("k") / PER_BUCKET)))
    counts = hot.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("g", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "hot")
    hot = hot.withColumn("_n", F.row_number().over(Window.partitionBy("g", "bucket").orderBy("h", "rid"))).join(small(counts), ["g", "bucket"])
    part = F.floor((F.col("offset") + F.col("_n") - 1) / whole)
    members = F.least(F.lit(whole), F.col("k") - part * whole)
    return fits.select(*out).unionByName(hot.select("*", F.xxhash64("g", part).alias("unit"), members.alias("members")).select(*out))


def _loads(state: DataFrame, shards: int) -> list[int]:
    got = {r.shard: r.n for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [got.get(k, 0) for k in range(shards)]


def placed(state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`state` (rid, h, unit) with a first shard: large units together, the rest by hash in proportion to the room left."""
    total = state.count()
    sizes = state.where("unit is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") >= max(2, total // shards // 4)).collect()  # 8 times as many as shards at most
    room, seeds = [total // shards + (k < total % shards) for k in range(shards)], []
    for row in sorted(large, key=lambda x: (-x.n, x.unit)):
        fits = [j for j in range(shards) if room[j] >= row.n]
        to = min(fits, key=lambda j: room[j]) if fits else max(range(shards), key=lambda j: room[j])
        room[to] -= row.n
        seeds.append((row.unit, to))
    room = [max(0, x) for x in room]
    stops = [sum(room[: j + 1]) / max(1, sum(room)) for j in range(shards - 1)]
    drawn = _chance("h", F.lit(1))
    shard = F.size(F.filter(F.array(*[F.lit(float(x)) for x in stops]), lambda x: x <= drawn)) if stops else F.lit(0)
    if seeds:
        state = state.join(F.broadcast(state.sparkSession.createDataFrame(seeds, "unit long, seed int")), "unit", "left")
        shard = F.coalesce("seed", shard)
    return state.withColumn("shard", shard.cast("int")).drop("seed")


def propagate(state: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of moves; `state` has rid, h, unit, shard."""
    capacity = -(-sum(_loads(state, shards)) // shards)
    for step in range(rounds):
        loads = _loads(state, shards)
        free = {r.shard: r.n for r in state.where("unit is null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = [max(0, capacity - loads[j] + free.get(j, 0)) for j in range(shards)]  # for documents with links
        votes = state.where(F.col("unit").isNotNull()).groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("n"), F.first("members").alias("members"))
        held = F.least(F.col("members"), F.col("n") + _pick(room, F.col("shard")))  # the members that the shard can hold
        target = votes.groupBy("unit").agg(F.max_by("shard", F.struct(held, "n", F.xxhash64("unit", "shard"))).alias("target"))
        moving = materialize(state.join(small(materialize(target, "targets")), "unit", "left"), "moves")
        asked = moving.where("target <> shard").groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n")).collect()  # shards x shards
        if not asked:
            return state
        coming = [0] * shards
        for r in asked:
            coming[r.target] += r.n
        rate = [1.0] * shards
        for _ in range(20):  # quotas: what leaves depends on what the others take
            out = [0.0] * shards
            for r in asked:
                out[r.shard] += r.n * rate[r.target]
            rate = [min(1.0, max(0.0, capacity - loads[j] + out[j] + free.get(j, 0)) / coming[j]) if coming[j] else 1.0 for j in range(shards)]
        rates = F.get(F.array(*[F.lit(float(x)) for x in rate]), F.col("target"))
        moved = F.when((F.col("target") != F.col("shard")) & (_chance(F.col("h"), F.col("rid"), F.lit(step)) < rates), F.col("target")).otherwise(F.col("shard"))
        state = materialize(moving.withColumn("shard", moved).drop("target"), "state")
    return state


def evened(state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Sizes at most one apart: final shard, and slot within it."""
    loads = _loads(state, shards)
    total = sum(loads)
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    buckets = max(1, total // (shards * PER_BUCKET))
    by = ["shard", "single", "bucket", "sub"]
    rows = state.select(
        "*", F.col("unit").isNull().alias("single"), F.pmod(F.xxhash64(F.coalesce("unit", F.xxhash64("h", F.lit(3)))), F.lit(buckets)).alias("bucket"),
        F.pmod(F.xxhash64("h", "rid"), F.ceil(F.coalesce("members", F.lit(1)) / PER_BUCKET)).alias("sub"),
    )
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("single", "bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select(*by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    within = Window.partitionBy(*by).orderBy("unit", "h", "rid")
    rows = rows.withColumn("_n", F.row_number().over(within)).join(small(counts), by).withColumn("rank", F.col("offset") + F.col("_n") - 1)
    over, start, bounds = [], 0, []
    for k in range(shards):  # where each shard's surplus begins among all that move
        over.append(start)
        start += max(0, loads[k] - quota[k])
    start = 0
    for k in range(shards):
        gap = max(0, quota[k] - loads[k])
        if gap:
            bounds.append((k, start, start + gap))
        start += gap
    shard = F.col("shard")
    stays = F.col("rank") < _pick(quota, shard)
    e = _pick(over, shard) + F.col("rank") - _pick(quota, shard)
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, a, z in bounds:
        here = (e >= a) & (e < z)
        to, slot = F.when(here, F.lit(k)).otherwise(to), F.when(here, e - a + loads[k]).otherwise(slot)
    return rows.select("doc_id", "size", "text_crc32", F.when(stays, shard).otherwise(to).cast("int").alias("to"), F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot"))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of `docs`."""
    state = placed(materialize(linked_rows(docs, shards=shards), "linked"), shards)
    state = evened(propagate(materialize(state, "state"), shards), shards)
    return state.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("to").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
