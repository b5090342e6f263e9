"""Registration of named queries and their SQL twins, and the domain views that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as chunks: id, project, language, path, content."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("project"),
        F.col("lang").alias("language"),
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"),
        F.col("text").alias("content"),
    )


CHUNKS = "chunks AS (SELECT doc_id chunk_id, source project, lang \"language\", source || '/' || lang || '/' || doc_id || '.md' file_path, text content FROM documents)"

#: File name endings that are dealt over the documents, so that the file operators meet every kind.
ENDINGS = ["ts", "py", "md", "json", "css", "sql", "go", "RS", "png", "min.js", "log", "txt", "java", "yml", "lock", "tsx", "Dockerfile"]
FOLDERS = ["src", "lib", "node_modules/pkg", "docs", "dist", "test", ".git"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as files: path, relative_path, size, content."""
    d = table(spark, sf_dir, "documents")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % n).cast("int"))
    name = F.concat(pick(FOLDERS, len(FOLDERS)), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), pick(ENDINGS, len(ENDINGS)))
    return d.select("doc_id", F.col("source").alias("root"), name.alias("relative_path"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FILES = f"files AS (SELECT doc_id, source root, ({_sql_list(FOLDERS)})[doc_id % {len(FOLDERS)} + 1] || '/f' || doc_id || '.' || ({_sql_list(ENDINGS)})[doc_id % {len(ENDINGS)} + 1] relative_path, CAST(octet_length(encode(text)) AS BIGINT) size, text content FROM documents)"
