"""Ingest: classification of files, ignore rules, segments and chunks, change detection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import estimate_tokens, extension

#: Endings of each language, the file type of each language, ignore patterns, endings of binary files.
LANGUAGE_ENDINGS = {
    "typescript": ["ts", "tsx", "mts", "cts"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py", "pyw", "pyi"], "go": ["go"], "rust": ["rs"], "java": ["java"], "c": ["c", "h"],
    "cpp": ["cpp", "hpp", "cc", "cxx"], "csharp": ["cs"], "ruby": ["rb", "rake"], "php": ["php"], "swift": ["swift"], "kotlin": ["kt", "kts"], "scala": ["scala", "sc"], "html": ["html", "htm"],
    "css": ["css", "less"], "scss": ["scss", "sass"], "json": ["json", "jsonc"], "yaml": ["yaml", "yml"], "toml": ["toml"], "markdown": ["md", "mdx"], "text": ["txt", "rst"], "sql": ["sql"],
    "shell": ["sh", "bash", "zsh", "fish"], "dockerfile": ["dockerfile"],
}
TYPE_LANGUAGES = {
    "code": ["typescript", "javascript", "python", "go", "rust", "java", "c", "cpp", "csharp", "ruby", "php", "swift", "kotlin", "scala", "html", "shell", "dockerfile"],
    "style": ["css", "scss"], "config": ["json", "yaml", "toml"], "docs": ["markdown", "text"], "data": ["sql"],
}
IGNORED = [
    ".git", ".svn", ".hg", "node_modules", "vendor", "venv", ".venv", "__pycache__", ".tox", "bower_components", "dist", "build", "out", "target", ".next", ".nuxt", ".output", ".cache",
    ".idea", ".vscode", "*.swp", "*.swo", "*~", ".DS_Store", "Thumbs.db", "coverage", ".nyc_output", "*.log", "logs", ".env", ".env.*", "!.env.example",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "poetry.lock", "composer.lock",
]
BINARY_ENDINGS = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "svg", "tiff", "tif", "psd", "ai", "mp3", "wav", "ogg", "flac", "aac", "m4a", "mp4", "mov", "avi", "mkv", "webm", "wmv", "flv",
    "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "exe", "dll", "so", "dylib", "bin", "woff", "woff2", "ttf", "otf", "eot", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "db", "sqlite", "sqlite3", "wasm", "map", "min.js", "min.css",
]
#: Chunk size, overlap and size limit by file type.
SIZES = {"code": (512, 50), "docs": (1024, 100), "config": (256, 25), "style": (512, 50), "data": (512, 50)}
MOST_BYTES, LEAST_CHARS = 500 * 1024, 10


def _case(col: Column, groups: dict[str, list[str]], default: str) -> Column:
    of = F.create_map(*[F.lit(x) for value, names in groups.items() for name in names for x in (name, value)])
    return F.coalesce(F.try_element_at(of, col), F.lit(default))


def language(path: Column) -> Column:
    return _case(extension(path), LANGUAGE_ENDINGS, "text")


def file_type(lang: Column) -> Column:
    return _case(lang, TYPE_LANGUAGES, "docs")


def is_binary(path: Column) -> Column:
    """By ending, also by an ending of two parts."""
    return F.lower(path).rlike(r"\.(" + "|".join(map(re.escape, BINARY_ENDINGS)) + ")$")


def parse_ignore(text: Column) -> Column:
    """The patterns of an ignore file: trimmed lines that are neither blank nor comments."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """A regular expression over relative paths for an ignore pattern, and whether it takes files back in."""
    back = pattern.startswith("!")
    p = pattern[back:]
    anchored = "/" in p.rstrip("/")
    only_folder = p.endswith("/")
    p = p.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] in "*?":
            out, i = out + ("[^/]*" if p[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_folder else "(?:/|$)"), back


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches ignores the path; a path below an ignored folder stays ignored by it."""
    runs: list[tuple[list[str], bool]] = []  # neighbours of one kind are one expression
    for regex, back in map(ignore_regex, patterns):
        if not runs or runs[-1][1] != back:
            runs.append(([], back))
        runs[-1][0].append(regex)
    out = F.lit(False)
    for regexes, back in runs:
        out = F.when(path.rlike("|".join(f"(?:{r})" for r in regexes)), F.lit(not back)).otherwise(out)
    return out


def skip_reason(size: Column, content: Column, most: int = MOST_BYTES) -> Column:
    """Why a file gives no chunks: too_large (more than `most` bytes), empty, or null."""
    return F.when(size > most, F.lit("too_large")).when(F.length(F.trim(F.regexp_replace(content, r"\s+", " "))) == 0, F.lit("empty"))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and status (new, changed, deleted, same) of two snapshots (path, hash)."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("same")
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))


def markdown_segments(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of Markdown with their kind and the heading above them. Fences toggle; blank lines and rules are left out.

    A document's lines stay together, which bounds a group by the longest document.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "content"))
    w = Window.partitionBy(id_col).orderBy("line")
    fence = F.col("content").startswith("```")
    inside = F.sum(fence.cast("int")).over(w) % 2 == 1
    x = lines.withColumn("_in", inside).withColumn("_fence", fence)
    heading = ~F.col("_in") & ~F.col("_fence") & F.col("content").rlike(r"^#{1,6} ")
    kind = (
        F.when(F.col("_in") | F.col("_fence"), "code")
        .when(heading, "heading")
        .when(F.col("content").rlike(r"^(---+|\*\*\*+)$"), "rule")
        .when(F.trim("content") == "", "blank")
        .when(F.col("content").rlike(r"^\s*([-*+]|[0-9]+\.) "), "list")
        .when(F.col("content").startswith(">"), "blockquote")
        .when(F.col("content").startswith("|"), "table")
        .when(F.col("content").startswith("<"), "html")
        .otherwise("paragraph")
    )
    title = F.when(heading, F.regexp_replace("content", r"^#{1,6} ", ""))
    x = x.withColumn("kind", kind).withColumn("section", F.last(title, ignorenulls=True).over(w))
    return x.where(~F.col("kind").isin("blank", "rule")).select(id_col, "line", "kind", "section", "content")


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Segments of Markdown: first and last line (from 1), kind, content_type, section and content.

    A heading is a segment, so is a fence with its marks taken off, and so are neighbouring lines of a paragraph, list,
    quote, table or HTML block; blank lines and rules part them. A line behind a list or quote that is indented or
    plain goes on with it. A text without any segment but not blank is one.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "content"))
    w = Window.partitionBy(id_col).orderBy("line")
    fence = F.col("content").startswith("```")
    x = lines.withColumn("_open", fence & (F.sum(fence.cast("int")).over(w) % 2 == 1)).withColumn("_fence", fence).withColumn("_in", F.sum(fence.cast("int")).over(w) % 2 == 1)
    body = F.col("content")
    kind = (
        F.when(F.col("_in") | F.col("_fence"), "code")
        .when(body.rlike(r"^#{1,6} "), "heading")
        .when(body.rlike(r"^(---+|\*\*\*+)$"), "rule")
        .when(F.trim(body) == "", "blank")
        .when(body.rlike(r"^\s*([-*+]|[0-9]+\.) "), "list")
        .when(body.startswith(">"), "blockquote")
        .when(body.startswith("|"), "table")
        .when(body.startswith("<"), "html")
        .otherwise("paragraph")
    )
    x = x.withColumn("kind", kind).withColumn("section", F.last(F.when(F.col("kind") == "heading", F.regexp_replace("content", r"^#{1,6} ", "")), ignorenulls=True).over(w))
    before = F.lag("kind").over(w)
    goes_on = (F.col("kind") == before) & ~F.col("kind").isin("heading", "code") | (F.col("kind") == "paragraph") & before.isin("list", "blockquote") | (F.col("kind") == "code") & ~F.col("_open")
    x = x.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_seg", F.sum("_new").over(w))
    inner = F.when(~F.col("_fence"), F.struct("line", "content"))
    x = x.where(~F.col("kind").isin("blank", "rule")).groupBy(id_col, "_seg").agg(
        (F.min("line") + 1).alias("start_line"), (F.max("line") + 1).alias("end_line"), F.min_by("kind", "line").alias("kind"), F.min_by("section", "line").alias("section"),
        F.array_join(F.transform(F.array_sort(F.collect_list(inner)), lambda r: r["content"]), "\n").alias("content"),
    )
    x = x.select(id_col, "start_line", "end_line", "kind", F.when(F.col("kind") == "code", "code").otherwise("docs").alias("content_type"), "section", F.when(F.col("kind") == "code", F.col("content")).otherwise(F.trim("content")).alias("content"))
    whole = docs.where(F.trim(F.regexp_replace(text_col, r"\s+", " ")) != "").join(x.select(id_col).distinct(), id_col, "left_anti")
    count = F.size(F.split(text_col, "\n"))
    return x.unionByName(whole.select(id_col, F.lit(1).alias("start_line"), count.alias("end_line"), F.lit("document").alias("kind"), F.lit("docs").alias("content_type"), F.lit(None).cast("string").alias("section"), F.trim(text_col).alias("content")))


def size_policy(kind: Column) -> tuple[Column, Column]:
    """Chunk size and overlap of a file type; an unknown one has those of documents."""
    of = lambda j: F.create_map(*[F.lit(x) for name, sizes in SIZES.items() for x in (name, sizes[j])])
    size, overlap = (F.coalesce(F.try_element_at(of(j), kind), F.lit(SIZES["docs"][j])) for j in (0, 1))
    return size, overlap


def whole_segments(files: DataFrame, text_col: str, kind_col: str = "file_type") -> DataFrame:
    """Config files as one segment each: all lines, as they are."""
    return files.where(F.col(kind_col) == "config").withColumns({"start_line": F.lit(1), "end_line": F.size(F.split(text_col, "\n")), "content_type": F.lit("config")})


def policy_chunks(segments: DataFrame, id_col: str, text_col: str, kind_col: str) -> DataFrame:
    """Chunks of segments by the size policy of their kind; segments of less than `LEAST_CHARS` characters are left out, those that fit are one chunk."""
    size, overlap = size_policy(F.col(kind_col))
    return fixed_chunks(segments.where(F.length(text_col) >= LEAST_CHARS), id_col, text_col, size, overlap)


def fixed_chunks(docs: DataFrame, id_col: str, text_col: str, size: int | Column, overlap: int | Column) -> DataFrame:
    """Chunks of `size` estimated tokens with `overlap`: index, number of chunks, first and last line, content. Both may differ from row to row.

    They stand in the plan once, as variables of a function over one struct: Spark puts an expression in the place of each
    column that refers to it, and a size that depends on a path's ending would be repeated beyond what the driver can hold.
    """
    size, overlap = (F.lit(x) if isinstance(x, int) else x for x in (size, overlap))
    n = F.length(text_col)
    begins = lambda w, o: F.when(n > w, F.sequence(F.lit(0), n - o - 1, w - o)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    cut = lambda s: F.transform(begins(s["w"], s["o"]), lambda at: F.struct(at.alias("at"), s["w"].alias("w")))
    x = docs.select(id_col, text_col, F.get(F.transform(F.array(F.struct((4 * size).alias("w"), (4 * overlap).alias("o"))), cut), 0).alias("_starts"))
    x = x.select(id_col, text_col, F.size("_starts").alias("total_chunks"), F.posexplode("_starts").alias("chunk_index", "_start"))
    x = x.select(id_col, text_col, "total_chunks", "chunk_index", F.col("_start.at").alias("_at"), F.col("_start.w").alias("_width"))
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    body = F.substring(F.col(text_col), F.col("_at") + 1, F.col("_width"))
    first = newlines(F.substring(F.col(text_col), F.lit(1), F.col("_at"))) + 1
    return x.select(id_col, "chunk_index", "total_chunks", first.alias("start_line"), (first + newlines(body)).alias("end_line"), body.alias("content"))


def segment_filter(segments: DataFrame, text: str = "content") -> DataFrame:
    """Segments of `LEAST_CHARS` characters and more, with their token estimate."""
    return segments.where(F.length(F.trim(text)) >= LEAST_CHARS).withColumn("tokens", estimate_tokens(F.col(text)))


def model_dimensions(name: Column) -> Column:
    """Vector width by model name; fixed values, the first that is contained counts."""
    out = F.lit(1024)
    for part, n in reversed([("bge-large", 1024), ("bge-base", 768), ("bge-small", 384), ("nomic-embed", 768), ("mxbai-embed", 1024), ("text-embedding-3-large", 3072), ("text-embedding-3-small", 1536), ("text-embedding-ada", 1536)]):
        out = F.when(F.lower(name).contains(part), F.lit(n)).otherwise(out)
    return out
