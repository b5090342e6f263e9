"""Chunks of long texts by functions only: at the coarsest separator that will do, or where the next sentence is unlike the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import tokens
from siltstone.operators.steps import spread

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
_RANGES = "array<struct<a:int,z:int>>"
#: Texts are cut into blocks of so many characters once, since a place in a long string is found by counting from its start.
_BLOCK = 1 << 16


def _range(a: Column, z: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), z.cast("int").alias("z"))


def _blocks(text: Column) -> Column:
    starts = F.sequence(F.lit(0), F.floor(F.length(text) / _BLOCK).cast("int"))
    return F.transform(starts, lambda b: F.substring(text, b * _BLOCK + 1, F.lit(_BLOCK)))


def _within(blocks: Column, a: Column, z: Column) -> Column:
    """The characters from `a` to before `z` of a text in blocks."""
    first, last = F.floor(a / _BLOCK).cast("int"), F.floor(z / _BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), (a - first * _BLOCK + 1).cast("int"), (z - a).cast("int"))


def _merged(blocks: Column, r: Column, sep: str, most: int, overlap: int) -> Column:
    """The ranges into which one is cut at a separator: neighbouring parts together up to `most` characters, then the next with the end of the last one before it. A part beyond `most` stands alone."""
    wide = len(sep)

    def step(acc: Column, n: Column) -> Column:
        held, end = acc["z"] > acc["a"], acc["at"] + n
        start = F.when(held, acc["a"]).otherwise(acc["at"])
        tail = F.least(F.lit(overlap), acc["z"] - acc["a"])
        after = F.when(held & (tail > 0) & (tail + wide + n <= most), acc["z"] - tail).otherwise(acc["at"])
        fits, alone = end - start <= most, end - after > most
        done = F.when(held, F.array(_range(acc["a"], acc["z"]))).otherwise(F.array().cast(_RANGES))
        done = F.concat(acc["out"], done, F.when(alone, F.array(_range(after, end))).otherwise(F.array().cast(_RANGES)))
        return F.struct(
            (end + wide).alias("at"),
            F.when(fits, start).when(alone, end).otherwise(after).alias("a"),
            end.alias("z"),
            F.when(fits, acc["out"]).otherwise(done).alias("out"),
        )

    def last(acc: Column) -> Column:
        left = (acc["z"] > acc["a"]) & F.rlike(_within(blocks, acc["a"], acc["z"]), F.lit(r"\S"))
        return F.when(left, F.concat(acc["out"], F.array(_range(acc["a"], acc["z"])))).otherwise(acc["out"])

    lengths = F.transform(F.split(_within(blocks, r["a"], r["z"]), rf"\Q{sep}\E", -1), F.length)
    zero = F.struct(r["a"].alias("at"), F.lit(0).alias("a"), F.lit(0).alias("z"), F.array().cast(_RANGES).alias("out"))
    return F.aggregate(lengths, zero, step, last)


def _cut(blocks: Column, sep: str, most: int, overlap: int) -> Callable[[Column], Column]:
    """A function that cuts a range beyond `most` characters at a separator, if it holds it."""

    def cut(r: Column) -> Column:
        fits = r["z"] - r["a"] <= most
        if sep:
            return F.when(fits | ~F.contains(_within(blocks, r["a"], r["z"]), F.lit(sep)), F.array(r)).otherwise(_merged(blocks, r, sep, most, overlap))
        starts = F.sequence(r["a"], r["z"] - overlap - 1, F.lit(most - overlap))
        return F.when(fits, F.array(r)).otherwise(F.transform(starts, lambda a: _range(a, F.least(a + most, r["z"]))))

    return cut


def chunk_recursive(docs: DataFrame, id_col: str, text_col: str, size: int = 1024, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """id, chunk_index, content: chunks of at most `size` estimated tokens, cut at the coarsest separator that will do, with up to `overlap` tokens repeated.

    What is too long between two separators is cut at the next finer one; "" cuts anywhere. Chunks are places in the text,
    found from the lengths of its parts, so no string is built before the last step. A null, empty or blank text has no
    chunks; rows that repeat are chunked each; other columns are left out. Nothing is shuffled but to spread small tables.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size, and not negative")
    most, back = 4 * size, 4 * overlap
    t = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).where(F.rlike("_text", F.lit(r"\S")))
    t = t.select("_id", F.length("_text").alias("_n"), _blocks(F.col("_text")).alias("_blocks"))
    blocks = F.col("_blocks")
    ranges = F.array(_range(F.lit(0), F.col("_n")))
    for sep in separators:
        ranges = F.flatten(F.transform(ranges, _cut(blocks, sep, most, back)))
    t = t.select("_id", "_blocks", F.posexplode(ranges).alias("_i", "_r"))
    return t.select(F.col("_id").alias(id_col), F.col("_i").alias("chunk_index"), _within(blocks, F.col("_r.a"), F.col("_r.z")).alias("content"))


def sentences(text: Column) -> Column:
    """Pieces of a text that end with a full stop, exclamation or question mark before white space; blank ones are left out."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: F.rlike(s, F.lit(r"\S")))


def chunk_semantic(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, least: int = 100, dims: int = 64) -> DataFrame:
    """id, chunk_index, content: sentences gathered until the next one's hashed vector is less similar than `threshold` to the last one's and the chunk has `least` tokens.

    Vectors are those of `embed_hash`, kept as whole numbers: cosines are compared as dot >= threshold * sqrt(norms). A
    sentence without words is like no other. One shuffle brings each text to a task; words, sums, neighbours and the fold
    over its sentences stay there. Rows that repeat within a partition are chunked once and given as often as they came.
    A null, empty or blank text has no chunks; other columns are left out.
    """
    d = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).where(F.rlike("_text", F.lit(r"\S")))
    # Copies in different partitions have different keys, so that no task gets all copies of a hot row. The keys are used in this one branch only.
    name = F.concat(F.spark_partition_id().cast("string"), F.coalesce(F.concat(F.lit("="), F.col("_id").cast("string")), F.lit("-")), F.lit("\n"), F.col("_text"))
    texts = d.withColumn("_key", F.md5(name)).groupBy("_key").agg(F.first("_id").alias("_id"), F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_copies"))
    own = ["_key", "_id", "_copies"]

    # A sentence's text goes with its first word.
    said = texts.select(*own, F.posexplode(sentences(F.col("_text"))).alias("_i", "_s"))
    words = said.select(*own, "_i", "_s", F.posexplode_outer(tokens(F.col("_s"))).alias("_at", "_w"))
    h = words.select(*own, "_i", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_s")).alias("_s"), F.md5(F.col("_w").cast("binary")).alias("_h"))
    place, sign = F.pmod(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), F.lit(dims)), F.when(F.substring("_h", 5, 1) < "8", 1).otherwise(-1)
    v = h.select(*own, place.alias("_k"), "_i", "_s", F.when(F.col("_h").isNotNull(), sign).otherwise(0).alias("_v"))
    v = v.groupBy(*own, "_k", "_i").agg(F.sum("_v").alias("_v"), F.max("_s").alias("_s"))
    beside = Window.partitionBy(*own, "_k").orderBy("_i")
    v = v.withColumn("_u", F.when(F.lag("_i").over(beside) == F.col("_i") - 1, F.lag("_v").over(beside)).otherwise(0))
    sums = v.groupBy(*own, "_i").agg(F.sum(F.col("_v") * F.col("_u")).alias("_dot"), F.sum(F.col("_v") * F.col("_v")).alias("_norm"), F.max("_s").alias("_s"))
    norms = F.col("_norm") * F.lag("_norm").over(Window.partitionBy(*own).orderBy("_i"))
    like = F.when(norms > 0, F.col("_dot") >= threshold * F.sqrt(norms)).otherwise(F.lit(threshold <= 0))
    lines = sums.select(*own, "_i", "_s", like.alias("_like")).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("_i", "_s", "_like"))).alias("_all"))

    def step(acc: Column, x: Column) -> Column:
        n = F.length(x["_s"])
        begins = (acc["n"] < 0) | ((acc["n"] >= 4 * least) & ~x["_like"])
        return F.struct(F.when(begins, n).otherwise(acc["n"] + 1 + n).alias("n"), F.when(begins, F.concat(acc["starts"], F.array(x["_i"]))).otherwise(acc["starts"]).alias("starts"))

    zero = F.struct(F.lit(-1).alias("n"), F.array().cast("array<int>").alias("starts"))
    x = lines.select("_id", "_copies", F.col("_all._s").alias("_all"), F.aggregate("_all", zero, step, lambda acc: acc["starts"]).alias("_starts"))
    upto = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_all"))
    told = F.transform("_starts", lambda a, k: F.array_join(F.slice("_all", a + 1, upto(k) - a), " "))
    x = x.select("_copies", "_id", told.alias("_told")).select("_id", "_told", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_c"))
    return x.select(F.col("_id").alias(id_col), F.posexplode("_told").alias("chunk_index", "content"))
