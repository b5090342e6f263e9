"""Context assembly: near-duplicate removal, order, budget, XML, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import estimate_tokens, fixed, line_range, tokens, xml_escape
from siltstone.operators.lookup import containing, postings


def dedupe(results: DataFrame, by: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Results (ranked, at most a few dozen for a query) without those whose words are alike to a better one that was kept: Jaccard >= threshold."""
    row = F.struct(F.col("rank").alias("rank"), F.array_distinct(tokens(F.col(text))).alias("words"))
    all_rows = results.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    like = lambda a, b: F.size(F.array_intersect(a, b)) >= threshold * F.size(F.array_union(a, b))
    kept = F.aggregate("_rows", F.slice("_rows", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: like(x["words"], y["words"])), acc).otherwise(F.concat(acc, F.array(x))))
    kept = all_rows.select(by, F.explode(kept).alias("k")).select(by, F.col("k.rank").alias("rank"))
    return results.join(kept, [by, "rank"])


def sandwich(rank: Column, n: Column) -> Column:
    """Place of a rank when the best stand at both ends: odd ranks rising, then even ranks falling."""
    odd = rank % 2 == 1
    return F.when(odd, F.floor((rank + 1) / 2)).otherwise(n - F.floor(rank / 2) + 1).cast("long")


def budget(results: DataFrame, by: str, text: str, most: int = 4000) -> DataFrame:
    """The first results of each query whose estimated tokens before them stay below the budget."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    t = results.withColumn("tokens", estimate_tokens(F.col(text)))
    return t.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)).cast("long")).where(F.col("before") < most)


def xml(results: DataFrame, by: str) -> DataFrame:
    """One <sources> document for each query of results (rank, project, file_path, start_line, end_line, score, content)."""
    lines = F.when(F.col("start_line") == F.col("end_line"), F.col("start_line").cast("string")).otherwise(F.concat_ws("-", "start_line", "end_line"))
    one = F.concat(
        F.lit('  <source id="'), F.col("rank").cast("string"), F.lit('" project="'), F.col("project"), F.lit('" file="'), F.col("file_path"), F.lit('" lines="'), lines,
        F.lit('" score="'), fixed(F.col("score"), 3), F.lit('">\n'), xml_escape(F.col("content")), F.lit("\n  </source>"),
    )
    all_rows = F.array_sort(F.collect_list(F.struct("rank", one.alias("x"))))
    return results.groupBy(by).agg(F.concat(F.lit("<sources>\n"), F.array_join(F.transform(all_rows, lambda r: r["x"]), "\n"), F.lit("\n</sources>")).alias("context"))


def citation(index: Column, path: Column, start: Column, end: Column, score: Column, language: Column, kind: Column, style: str = "compact") -> Column:
    place = F.when(start > 0, F.concat(path, F.lit(":"), line_range(start, end))).otherwise(path)
    head = F.concat(F.lit("["), index.cast("string"), F.lit("] "), place)
    if style == "minimal":
        return head
    if style == "compact":
        return F.concat(head, F.lit(" ("), fixed(score, 2), F.lit(")"))
    known = F.when(language.isNotNull(), F.concat(F.upper(F.substring(language, 1, 1)), F.substring(language, 2, 1000)))
    named = F.coalesce(known, F.when(kind == "code", "Code").when(kind == "docs", "Documentation").when(kind == "config", "Config").otherwise("Unknown"))
    return F.concat(head, F.lit("\n    "), named, F.lit(" | score: "), fixed(score, 2))


def citations(results: DataFrame, by: str, style: str = "compact", limit: int = 0) -> DataFrame:
    """A block of citations for each query; beyond `limit` (0: none) a last line counts the rest."""
    one = citation(F.col("rank"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("score"), F.col("language"), F.col("file_type"), style)
    lines = results.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("x")))), lambda r: r["x"]).alias("x"))
    n = F.size("x")
    text = F.array_join("x", "\n")
    if limit > 0:
        text = F.when(n > limit, F.concat(F.array_join(F.slice("x", 1, limit), "\n"), F.lit("\n...and "), (n - limit).cast("string"), F.lit(" more"))).otherwise(text)
    return lines.select(by, text.alias("citations"))


def match_files(patterns: DataFrame, paths: DataFrame, pattern: str, path: str, most: int = 3, least: float = 0.3) -> DataFrame:
    """The best files for each pattern: exact name 1.0, its beginning 0.8, a part of the name 0.6, a part of the path 0.4; then shorter paths. Candidates come from `lookup`; an empty pattern finds nothing."""
    p, f = F.lower(pattern), F.lower(path)
    name = F.element_at(F.split(f, "/"), -1)
    score = F.when(name == p, 1.0).when(F.startswith(name, p), 0.8).when(F.contains(name, p), 0.6).otherwise(0.4)
    found = containing(patterns, postings(paths, path), pattern, path).withColumn("score", score).where(F.col("score") >= least)
    w = Window.partitionBy(pattern).orderBy(F.desc("score"), F.length(path), F.asc(path))
    return found.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)


def with_content(matches: DataFrame, files: DataFrame, order: str, path: str, content: str, total: int = 50_000) -> DataFrame:
    """`matches` (of one question: pattern in its order, place) with their files' content, cut so that all of it stays within `total` characters.

    Files come in the order of the patterns and places. What begins beyond the total is left out; what passes it is cut.
    A stated question has few patterns and each has few matches, which bounds the window.
    """
    x = matches.join(files.select(path, F.col(content).alias("_content")), path)
    before = F.coalesce(F.sum(F.length("_content")).over(Window.orderBy(order, "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_room", (F.lit(total) - before).cast("int")).where("_room > 0")
    return x.withColumn(content, truncated(F.col("_content"), F.col("_room"))).drop("_content", "_room")


def truncated(text: Column, most: Column) -> Column:
    """A text cut to `most` characters, at the last line end if that keeps more than 80 percent, and marked."""
    cut = F.substring(text, F.lit(1), most)
    at = F.length(cut) - F.locate("\n", F.reverse(cut))
    has = F.contains(cut, F.lit("\n"))
    body = F.when(has & (at > most * 0.8), F.substring(cut, F.lit(1), at)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(body, F.lit("\n\n[... content truncated ...]")))
