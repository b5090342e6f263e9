"""File trees as DataFrames."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions.text import extension
from siltstone.operators.ingest import IGNORED, ignore_regex, is_binary, parse_ignore
from siltstone.operators.steps import read_file


def scan_directory(spark: SparkSession, root: str, glob: str = "*", content: bool = False) -> DataFrame:
    """path, relative_path, size, modified_at, extension of the files below a folder, hidden ones left out; content only if asked for, else it is never read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:(//[^/]*)?", "")
    plain = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?/*", "/"), r"/+", "/")
    f = f.select("path", F.substring(plain, F.length(base) + 2, F.lit(10_000)).alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), *(["content"] if content else []))
    return f.where(~F.col("relative_path").rlike(r"(^|/)\.")).withColumn("extension", extension(F.col("relative_path")))


class TreeSource(DataSource):
    """A file tree as rows (relative_path, size, modified_at, error), walked on the executors.

    Options: path; patterns, a JSON list of ignore patterns; endings, a JSON list; maxDepth; followLinks; subtrees, how many
    partitions are wished for. The driver lists no more folders than it needs to find that many subtrees; tasks walk
    them. A folder that is ignored, hidden, too deep or behind a symbolic link is never listed. A folder that can't be
    listed gives a row with its error and doesn't end the scan; a root that can't is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "siltstone_tree"

    def schema(self) -> str:
        return "relative_path string, size long, modified_at timestamp, error string"

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader(dict(self.options))


class Subtree(InputPartition):
    def __init__(self, folders: list[tuple[str, int]], found: list[tuple]) -> None:
        self.folders, self.found = folders, found


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.rules = [(re.compile(r), back) for r, back in map(ignore_regex, json.loads(options.get("patterns", "[]")))]
        self.endings = json.loads(options["endings"]) if options.get("endings") is not None else None
        self.depth = int(options["maxdepth"]) if options.get("maxdepth") else None
        self.links, self.subtrees = options.get("followlinks") == "true", int(options.get("subtrees", 64))

    def ignored(self, path: str) -> bool:
        out = False
        for rule, back in self.rules:
            if rule.search(path):
                out = not back
        return out

    def listed(self, folder: str) -> Iterator[tuple[str, bool, int, object]]:
        """(name, whether a folder, size, time) of what a folder holds; OSError if it can't be listed. A file that vanishes meanwhile is left out."""
        if "://" in self.root and not self.root.startswith("file://"):
            fs, base = FileSystem.from_uri(self.root)
            for i in fs.get_file_info(FileSelector(f"{base}/{folder}" if folder else base)):
                yield i.base_name, i.type == FileType.Directory, i.size or 0, i.mtime
            return
        base = re.sub("^file:(//)?", "", self.root)
        with os.scandir(f"{base}/{folder}" if folder else base) as entries:
            for e in entries:
                try:
                    if not self.links and e.is_symlink():
                        continue
                    stat = e.stat()
                    yield e.name, e.is_dir(), stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc)
                except FileNotFoundError:
                    continue

    def step(self, folder: str, depth: int) -> tuple[list[tuple[str, int]], list[tuple]]:
        """Folders to walk and files to return of one folder, whose entries are `depth` folders deep."""
        folders, files = [], []
        for name, is_folder, size, at in sorted(self.listed(folder)):
            path = f"{folder}/{name}" if folder else name
            if name.startswith("."):
                continue
            if is_folder:
                if (self.depth is None or depth < self.depth) and not self.ignored(f"{path}/"):
                    folders.append((path, depth + 1))
            elif not self.ignored(path) and (self.endings is None or ("." in name and name.rsplit(".", 1)[1].lower() in self.endings)):
                files.append((path, size, at, None))
        return folders, files

    def partitions(self) -> list[Subtree]:
        try:
            open_, found = self.step("", 1)
        except OSError as e:
            raise OSError(f"the path {self.root} can't be listed: {e}") from e
        while open_ and len(open_) < self.subtrees:
            nearer = []
            for folder, depth in open_:
                more, files = self.tried(folder, depth)
                nearer += more
                found += files
            open_ = nearer
        dealt = [Subtree(open_[k :: self.subtrees], found[k :: self.subtrees]) for k in range(self.subtrees)]
        return [p for p in dealt if p.folders or p.found] or [Subtree([], [])]

    def tried(self, folder: str, depth: int) -> tuple[list[tuple[str, int]], list[tuple]]:
        try:
            return self.step(folder, depth)
        except OSError as e:
            return [], [(folder, None, None, f"{type(e).__name__}: {e.strerror or e}")]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        yield from partition.found
        stack = list(partition.folders)
        while stack:
            more, files = self.tried(*stack.pop())
            yield from files
            stack += more


def scan_tree(spark: SparkSession, root: str, max_depth: int | None = None, extensions: list[str] | None = None, extra_patterns: list[str] | None = None, follow_links: bool = False, errors: bool = False) -> DataFrame:
    """The files that an index takes: root, relative_path, size, modified_at, extension.

    Hidden, ignored (`IGNORED`, the root's own ignore file and `extra_patterns`, the last pattern that matches decides)
    and binary files are left out, and so are those deeper than `max_depth` folders, of other `extensions`, or, on a
    local file system, reached through a symbolic link. Folders of those kinds are not entered, so that nothing below
    them is taken back in. Files that vanish meanwhile are left out too; a root that can't be read is an error, other
    folders that can't give a row with `error`, a column that is there with `errors`.
    """
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("siltstone_tree").option("patterns", json.dumps([*IGNORED, *ignore_file(spark, root), *(extra_patterns or [])])).option("followLinks", str(follow_links).lower())
    if max_depth is not None:
        reader = reader.option("maxDepth", max_depth)
    if extensions is not None:
        reader = reader.option("endings", json.dumps([e.lower().lstrip(".") for e in extensions]))
    f = reader.load(root.rstrip("/")).where(F.col("error").isNotNull() | ~is_binary(F.col("relative_path")))
    f = f.select(F.lit(root.rstrip("/")).alias("root"), "relative_path", "size", "modified_at", extension(F.col("relative_path")).alias("extension"), "error")
    return f if errors else f.where("error IS NULL").drop("error")


def ignore_file(spark: SparkSession, root: str, name: str = ".gitignore") -> list[str]:
    """The patterns of the root's own ignore file; none without one."""
    text = read_file(spark, f"{root.rstrip('/')}/{name}")
    return [] if text is None else spark.range(1).select(parse_ignore(F.lit(text)).alias("p")).first().p
