"""Stored relations: upsert, cascade, partial update, validation, golden datasets and exports as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import tables
from siltstone.operators.steps import materialize


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of `new` over those of `old`; in the columns `keep`, a null leaves the old value."""
    o, n = old.select(key, *[F.col(c).alias(f"_{c}") for c in old.columns if c != key], F.lit(True).alias("_old")), new.withColumn("_new", F.lit(True))
    value = lambda c: F.when(F.col("_new").isNull(), F.col(f"_{c}")).otherwise(F.coalesce(c, f"_{c}") if c in keep else F.col(c))
    return o.join(n, key, "full_outer").select(key, *[value(c).alias(c) for c in old.columns if c != key])


def without(child: DataFrame, gone: DataFrame, key: str, gone_key: str) -> DataFrame:
    """The rows of a child table that a deletion of parents leaves."""
    return child.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti")


def delete_parents(parents: DataFrame, key: str, ids: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """What deleting the parents `ids` (a column named as `key`) leaves: of the parents, of each child table (frame, its key), and what goes: relation, id, n (0 too), counted before anything is deleted.

    LookupError names ids that no parent has; then nothing is deleted. Null ids are no ids; ids may repeat.
    """
    wanted = ids.select(key).dropna().distinct()
    absent = wanted.join(parents, key, "left_anti").limit(5).collect()
    if absent:
        raise LookupError(f"not found or already deleted: {', '.join(sorted(str(r[0]) for r in absent))}")
    kept = {name: without(df, wanted, k, key) for name, (df, k) in children.items()}
    counts = []
    for name, (df, k) in children.items():
        n = df.groupBy(F.col(k).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        counts.append(wanted.select(F.col(key).alias("id")).join(n, "id", "left").select(F.lit(name).alias("relation"), "id", F.coalesce("n", F.lit(0)).alias("n")))
    told = counts[0] if counts else wanted.select(F.lit("").alias("relation"), F.col(key).alias("id"), F.lit(0).cast("long").alias("n")).limit(0)
    for c in counts[1:]:
        told = told.unionByName(c)
    return without(parents, wanted, key, key), kept, told


def partial_update(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only what a change supplies is set."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    return df.join(c, key, "left").select(*[F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in df.columns])


def validated(df: DataFrame, rules: dict[str, Column], strict: bool = False) -> DataFrame:
    """`df` with the name of the first rule that a row breaks (null: none); strict raises on it instead."""
    broken = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        broken = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(broken)
    out = df.withColumn("broken_rule", broken)
    return out.where(F.assert_true(F.col("broken_rule").isNull(), F.concat(F.lit("invalid row: "), "broken_rule")).isNull()) if strict else out


def append_valid(df: DataFrame, path: str, partition: str, rules: dict[str, Column]) -> None:
    """Appends rows to a table of `tables`. A row that breaks a rule ends the write with the rule's name, and the table stays as it was."""
    tables.append(validated(df, rules, strict=True).drop("broken_rule"), path, partition)


def relative_start(text: str) -> str | None:
    """`7d`, `24h` or `2w` as an interval literal; None for any other text."""
    units = {"d": "DAY", "h": "HOUR", "w": "WEEK"}
    return f"INTERVAL {int(text[:-1])} {units[text[-1]]}" if text[:-1].isdigit() and text[-1:] in units else None


GOLDEN = "version string, projectName string, entries array<struct<id:string,query:string,expectedFilePaths:array<string>,expectedAnswer:string,tags:array<string>,source:string>>"
SOURCES = ("manual", "generated", "captured")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_golden(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of a golden dataset in JSON, one for each file or (lines) for each line. A path that doesn't exist is an empty set.

    What is invalid raises with all its issues: another version, no project name, an entry without id, query or a known source.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], GOLDEN).select("projectName", F.explode("entries").alias("e")).select("projectName", "e.*")
    d = spark.read.schema(GOLDEN).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    text = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    of_entry = lambda e: F.concat_ws("; ", F.when(~text(e["id"]), F.lit("entries.id: empty")), F.when(~text(e["query"]), F.lit("entries.query: empty")), F.when(~F.coalesce(e["source"].isin(*SOURCES), F.lit(False)), F.lit("entries.source: unknown")))
    issues = F.concat_ws("; ", F.when(~F.coalesce(F.col("version") == "1.0", F.lit(False)), F.lit("version: unknown version")), F.when(~text(F.col("projectName")), F.lit("projectName: empty")), F.array_join(F.array_remove(F.transform("entries", of_entry), ""), "; "))
    issues = F.regexp_replace(issues, "(; )+$", "")
    d = d.where(F.assert_true(issues == "", F.concat(F.lit("schema validation failed: "), issues)).isNull())
    return d.select("projectName", F.explode_outer("entries").alias("e")).select("projectName", "e.*")


def save_golden(entries: DataFrame, project: str, path: str) -> None:
    """Entries (id, query, and any of expectedFilePaths, expectedAnswer, tags, source) as golden datasets of one entry a line; folders are made."""
    write_json(_golden_lines(entries, project), path)


def _golden_lines(entries: DataFrame, project: str) -> DataFrame:
    kinds = {"id": "string", "query": "string", "expectedFilePaths": "array<string>", "expectedAnswer": "string", "tags": "array<string>", "source": "string"}
    given = [F.col(c).cast(t).alias(c) if c in entries.columns else F.lit("manual" if c == "source" else None).cast(t).alias(c) for c, t in kinds.items()]
    return entries.select(F.lit("1.0").alias("version"), F.lit(project).alias("projectName"), F.array(F.struct(*given)).alias("entries"))


def add_golden(spark: SparkSession, project: str, path: str, entries: DataFrame) -> DataFrame:
    """Adds entries (query, and any of expectedFilePaths, expectedAnswer, tags, source) to a dataset saved by `save_golden`, or makes it; returns them with their new ids.

    ValueError, with nothing written, if one has a blank query or neither paths nor an answer. What is there stays as it is.
    """
    kinds = {"expectedFilePaths": "array<string>", "expectedAnswer": "string"}
    new = entries.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in entries.columns})
    blank = F.coalesce(F.trim("query"), F.lit("")) == ""
    useless = (F.coalesce(F.size("expectedFilePaths"), F.lit(0)) <= 0) & (F.coalesce("expectedAnswer", F.lit("")) == "")
    for bad, why in ((blank, "entry query must be a non-empty string"), (useless, "entry must have at least one of expectedFilePaths or expectedAnswer")):
        if not new.where(bad).isEmpty():
            raise ValueError(why)
    # Written once: an id that is made at random must not be made again when it is read.
    made = materialize(new.withColumn("id", F.expr("uuid()")), "entries")
    _golden_lines(made, project).write.mode("append").option("ignoreNullFields", False).json(path)
    return made


def remove_golden(spark: SparkSession, project: str, path: str, ids: list[str]) -> int:
    """Removes the entries of these ids; the number of entries removed, 0 (and nothing written) if none is there. A reader sees the old entries or the new ones."""
    old = read_golden(spark, path, lines=True)
    gone = old.where(F.col("id").isin(ids)).count() if ids else 0
    if gone:
        save_golden(old.where(~F.col("id").isin(ids)), project, f"{path}.new")
        jvm = spark._jvm.org.apache.hadoop.fs
        at, new, before = (jvm.Path(path + x) for x in ("", ".new", ".old"))
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.rename(at, before)
        fs.rename(new, at)
        fs.delete(before, True)
    return gone


def write_json(df: DataFrame, path: str) -> None:
    """`df` as JSON, a row a line, null fields kept; folders that are missing are made, an earlier export is replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
