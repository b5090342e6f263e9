"""Incremental indexing: a new snapshot of files against a stored index, of which only what changed is made anew.

The index is one table (see `tables`) with the chunks of each file and the digest of the content that they come from; a
file without chunks has one row without a chunk. Files are dealt to buckets by their name, which partition the table.
A snapshot's digests are joined with the stored ones; new and changed files go through the chunker, and their buckets
are written again with what else they hold, as it was. Buckets in which nothing changed keep their files. New chunks,
deletions and whatever is carried over become visible in one step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import tables
from siltstone.operators.steps import materialize

#: Buckets of an index; a run rewrites those that hold a changed file.
BUCKETS = 64


@dataclass
class Run:
    """What a run did: files by status, buckets written again or emptied, and (file, status) of each file."""

    new: int
    changed: int
    deleted: int
    same: int
    buckets: list[int]
    status: DataFrame


def _digested(files: DataFrame, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int")
    return files.select("file", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"), bucket.alias("bucket"))


def _rows(files: DataFrame, chunker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index's rows of `files`: (file, digest, bucket) with each of the chunker's rows, or with none."""
    chunks = chunker(files.select("file", "content"))
    return files.select("file", "digest", "bucket").join(chunks, "file", "left")


def reindex(files: DataFrame, path: str, chunker: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> Run:
    """Brings the index at `path` to the snapshot `files` (file, content), each file once; without an index all files are new.

    `chunker` takes (file, content) to rows with `file`, `content` and whatever else it has, the same columns at each run.
    ValueError if a file is there twice. The number of buckets is that of the first run.
    """
    spark = files.sparkSession
    stored = tables.state(spark, path)[1]
    if stored:
        buckets = int(stored.get("buckets", buckets))
    new = materialize(_digested(files, buckets), "snapshot")
    twice = new.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the snapshot has {twice[0].file} {twice[0].n} times")
    if not stored:
        tables.append(_rows(new, chunker), path, "bucket", {"buckets": buckets})
        n = new.count()
        return Run(n, 0, 0, 0, sorted(r.bucket for r in new.select("bucket").distinct().collect()), new.select("file", F.lit("new").alias("status")))
    now = tables.read_table(spark, path)
    known = now.select("file", "digest", "bucket").distinct()
    status = F.when(F.col("known").isNull(), "new").when(F.col("digest").isNull(), "deleted").when(F.col("known") != F.col("digest"), "changed").otherwise("same")
    both = known.select("file", F.col("digest").alias("known"), F.col("bucket").alias("was")).join(new.select("file", "digest", "bucket"), "file", "full_outer")
    both = materialize(both.select("file", F.coalesce("bucket", "was").alias("bucket"), status.alias("status")), "status")
    count = {r.status: r.n for r in both.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = both.groupBy("bucket").agg(F.count_if(F.col("status") != "same").alias("touched"), F.count_if(F.col("status") != "deleted").alias("left")).where("touched > 0").collect()  # a row for each bucket
    touched = sorted(r.bucket for r in per)
    if touched:
        again = both.where("status IN ('new', 'changed')").select("file")
        carried = tables.read_table(spark, path, values=touched).join(both.where("status = 'same'").select("file"), "file", "left_semi")
        rows = _rows(new.join(again, "file", "left_semi"), chunker).select(*now.columns).unionByName(carried)
        tables.swap_partitions(rows, path, "bucket", [r.bucket for r in per if not r.left])
    return Run(*(count.get(s, 0) for s in ("new", "changed", "deleted", "same")), touched, both.select("file", "status"))


def indexed_chunks(spark: SparkSession, path: str, with_files: bool = False) -> DataFrame:
    """The chunks of the present state; with `with_files` also a row with null content for each file that has none."""
    rows = tables.read_table(spark, path)
    return rows if with_files else rows.where(F.col("content").isNotNull())
