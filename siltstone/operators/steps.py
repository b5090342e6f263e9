"""Steps between jobs: tables written to the shared folder, size checks before broadcasts, rows spread over cores."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Query sides are broadcast up to this many rows; beyond it the joins shuffle.
BROADCAST_QUERIES = 200_000


#: Folders made inside the innermost `scope`.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """The folders of intermediate steps that are made inside are deleted at its end; what is still wanted must be written elsewhere by then."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder and all in it, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def work_dir(spark: SparkSession, name: str = "work") -> str:
    """A new folder under spark.checkpoint.dir, deleted at the end of the `scope` around it, or else when the JVM ends. The setting is made only where it is unset and Spark runs in one process; ValueError on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing."""
    path = f"{work_dir(df.sparkSession, name)}/data"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, rows: int = BROADCAST_QUERIES, most: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows: by `most`, a bound that is known, or else by counting no further than that."""
    n = most if most is not None else df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores if its files are too small to give each of them a task, as a table in one row group is; large tables stay as they are. Nothing runs for it."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    each = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * each else df


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[str]:
    """Jobs that this thread begins inside carry `tag`; `cancel`, from any thread, ends those that run."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield tag
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the running jobs that carry `tag`."""
    spark.sparkContext.cancelJobsWithTag(tag)


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file's text, from any file system that Spark reads, hidden ones too; None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
