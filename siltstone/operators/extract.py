"""Segments of source code by Arrow-batched Python, where SQL functions can't parse, and embeddings."""

from __future__ import annotations

import ast
import hashlib
import re
import threading
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import tokens
from siltstone.operators.steps import spread

_JS = re.compile(
    r"(?P<doc>/\*\*[\s\S]*?\*/)"
    r"|(?P<function>^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<f>[\w$]+))"
    r"|(?P<class>^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<c>[\w$]+))"
    r"|(?P<interface>^[ \t]*(?:export\s+)?interface\s+(?P<i>[\w$]+))"
    r"|(?P<type>^[ \t]*(?:export\s+)?type\s+(?P<t>[\w$]+)[^=\n]*=)"
    r"|(?P<arrow>^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<a>[\w$]+)[^=\n]*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)[^=\n]*=>)",
    re.MULTILINE,
)
SEGMENTS = "start_line int, end_line int, content_type string, symbol_type string, symbol string, content string"


_TOKEN = re.compile(r"""(?P<quiet>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\s+)|(?P<string>'(?:\\[\s\S]|[^'\\\n])*'?|"(?:\\[\s\S]|[^"\\\n])*"?)|(?P<word>[\w$]+)|(?P<one>[\s\S])""")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(?P<end>`|\$\{|\Z)")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
_PAIRS = {"}": "{", ")": "(", "]": "["}


def _structure(text: str) -> tuple[list[int], dict[int, int], list[tuple[int, int]]]:
    """One pass over a program: places of brackets and semicolons, each opening bracket's closing one, and the spans of strings, templates' texts, comments and regular expressions."""
    places, closing, quoted, open_at, at, value = [], {}, [], [], 0, False

    def template(at: int) -> int:
        m = _TEMPLATE.match(text, at)
        quoted.append((at - 1, m.end()))
        if m["end"] == "${":
            open_at.append((m.end() - 1, "${"))
        return m.end()

    while at < len(text):
        m = _TOKEN.match(text, at)
        if m["quiet"] or m["string"]:
            if not m[0].isspace():
                quoted.append(m.span())
            value, at = value or bool(m["string"]), m.end()
        elif m["word"]:
            value, at = m[0] not in _BEFORE_REGEX, m.end()
        elif m[0] == "`":
            at, value = template(at + 1), text[at] == "`"
        elif m[0] == "/" and not value and (r := _REGEX.match(text, at)):
            quoted.append(r.span())
            value, at = True, r.end()
        elif m[0] == "}" and open_at and open_at[-1][1] == "${":
            open_at.pop()
            at, value = template(at + 1), True
        else:
            if m[0] in "{([":
                open_at.append((at, m[0]))
            elif m[0] in _PAIRS and open_at and open_at[-1][1] == _PAIRS[m[0]]:
                closing[open_at.pop()[0]] = at
            if m[0] in "{([;":
                places.append(at)
            value, at = m[0] in ")]", at + 1
    return places, closing, quoted


def _closing(places: list[int], closing: dict[int, int], text: str, at: int, stop: int) -> int:
    """End of the block or statement that begins at `at`: behind its first block, its semicolon, or at `stop`, where the next one begins."""
    i = bisect_left(places, at)
    while i < len(places) and places[i] < stop:
        p = places[i]
        if text[p] == ";":
            return p + 1
        end = closing.get(p, len(text) - 1)
        if text[p] == "{":
            return end + 1
        i = bisect_right(places, end)
    return min(stop, len(text))


def js_segments(text: str) -> list[tuple]:
    """Doc comments, functions, arrow functions, classes, interfaces and type aliases; what repeats (lines, kind) counts once. What only stands in a string, a template, a comment or a regular expression is none."""
    found, seen = [], set()
    places, closing, quoted = _structure(text)
    starts, lines = [q[0] for q in quoted], [m.start() for m in re.finditer("\n", text)]

    def inside(at: int) -> bool:
        i = bisect_right(starts, at) - 1
        return i >= 0 and quoted[i][0] < at < quoted[i][1]

    code = lambda m: m.start() + len(m[0]) - len(m[0].lstrip())
    matches = [m for m in _JS.finditer(text) if not inside(code(m))]
    for k, m in enumerate(matches):
        after = matches[k + 1] if k + 1 < len(matches) else None
        kind = next(g for g in ("doc", "function", "class", "interface", "type", "arrow") if m[g])
        stop = after.start() if after and kind in ("arrow", "type") else len(text)
        end = m.end() if kind == "doc" else m.start() + len(text[m.start() : _closing(places, closing, text, m.start(), stop)].rstrip("\n"))
        a, z = bisect_left(lines, m.start()) + 1, bisect_left(lines, end) + 1
        name = next((m[g] for g in "fcita" if m[g]), None)
        row = (a, z, "docs" if kind == "doc" else "code", kind, name, text[m.start() : end].strip("\n"))
        if row[:3] not in seen:
            seen.add(row[:3])
            found.append(row)
    return sorted(found, key=lambda r: (r[0], r[1]))


def python_segments(text: str) -> list[tuple]:
    """Docstrings as docs, functions and classes as code, nested ones too; a text that doesn't parse is one segment."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [(1, text.count("\n") + 1, "code", "module", None, text)] if text.strip() else []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            name = getattr(node, "name", None)
            doc = ast.get_docstring(node, clean=False)
            if doc is not None:
                d = node.body[0]
                out.append((d.lineno, d.end_lineno, "docs", "docstring", name, doc))
            if name:
                out.append((node.lineno, node.end_lineno, "code", "class" if isinstance(node, ast.ClassDef) else "function", name, ast.get_source_segment(text, node) or ""))
    return sorted(out, key=lambda r: (r[0], r[1], r[2]))


@lru_cache(maxsize=1 << 16)
def _place(word: str) -> tuple[int, float]:
    """A word's place, as the first 16 bits of its MD5, and its sign, the bit behind them."""
    h = hashlib.md5(word.encode()).digest()
    return h[0] << 8 | h[1], 1.0 if h[2] < 128 else -1.0


def hashed_vectors(texts: list[str], dims: int = 64) -> np.ndarray:
    """Unit vectors of hashed word counts as rows, as `embed_hash` makes them; zeros for a text without words."""
    at = [(i, *_place(w)) for i, t in enumerate(texts) for w in re.findall(r"\w+", t.lower())]
    row, place, sign = map(np.array, zip(*at, strict=True)) if at else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    v = np.bincount(row * dims + place % dims, weights=sign, minlength=len(texts) * dims).reshape(len(texts), dims)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _mapped(docs: DataFrame, id_col: str, text_col: str, fn, fields: str) -> DataFrame:
    names = [f.split(" ")[0] for f in fields.split(", ")]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b[id_col], b[text_col], strict=True) for r in fn(t or "")]
            yield pd.DataFrame(rows, columns=[id_col, *names])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, {fields}")


def extract_js(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _mapped(docs, id_col, text_col, js_segments, SEGMENTS)


def extract_python(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _mapped(docs, id_col, text_col, python_segments, SEGMENTS)


def embed_hash(docs: DataFrame, id_col: str, text_col: str, dims: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns `keep`, embedding: unit vectors of hashed word counts; of a text without words all zeros. A row for each row.

    The first 16 bits of a word's MD5 choose the place, the bit behind them the sign. A batch hashes each distinct word
    once and adds up whole numbers; nothing is shuffled but to spread small tables.
    """
    words = F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))
    own = [id_col, *keep]
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.columns[-1]
            cut = lists.flatten().dictionary_encode()
            at = [_place(w) for w in cut.dictionary.to_pylist()]
            place, sign = np.array([k % dims for k, _ in at], np.int64), np.array([s for _, s in at])
            row, word = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), cut.indices.to_numpy(zero_copy_only=False)
            v = np.bincount(row * dims + place[word], weights=sign[word], minlength=b.num_rows * dims).reshape(b.num_rows, dims)
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            x = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dims), pa.array((v / np.where(norm > 0, norm, 1)).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], x], schema.names)

    return spread(docs.select(*own, text_col)).select(*own, words.alias("_words")).mapInArrow(run, schema)


class Embedder(Protocol):
    """Texts to vectors of one width."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """A question and texts to a score for each."""

    def __call__(self, query: str, texts: list[str]) -> list[float]: ...


class Segmenter(Protocol):
    """A text to segments (start_line, end_line, content_type, symbol_type, symbol, content)."""

    def __call__(self, text: str) -> list[tuple]: ...


def _in_time(embedder: Embedder, texts: list[str], deadline: float | None) -> list[list[float]]:
    """What an embedder gives within `deadline` seconds. One that hangs is left behind in a thread that doesn't keep the worker alive."""
    if deadline is None:
        return embedder(texts)
    got: list = []

    def call() -> None:
        try:
            got.append((embedder(texts), None))
        except Exception as e:  # raised again below, in the thread that waits
            got.append((None, e))

    t = threading.Thread(target=call, daemon=True)
    t.start()
    t.join(deadline)
    if not got:
        raise TimeoutError(f"no vectors within {deadline:g} seconds")
    vectors, error = got[0]
    if error is not None:
        raise error
    return vectors


def _vectors(embedder: Embedder, texts: list[str], deadline: float | None, dims: int | None) -> list[list[float]]:
    """Vectors that are as many as the texts, not empty and of `dims` places, if that is given; ValueError otherwise."""
    out = [[float(x) for x in v] for v in _in_time(embedder, texts, deadline)]
    if len(out) != len(texts):
        raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
    for v in out:
        if not v or (dims is not None and len(v) != dims):
            raise ValueError(f"a vector has {len(v)} places" + (f" instead of {dims}" if dims is not None else ""))
    return out


def _embedded(texts: list[str], embedders: list[Embedder], deadline: float | None, dims: int | None) -> list[tuple[list[float] | None, str | None, int | None]]:
    """(vector, error, number of the embedder) of each text; the error is the last one."""
    out: list[tuple[list[float] | None, str | None, int | None]] = [(None, None, None)] * len(texts)
    left = list(range(len(texts)))
    for number, embedder in enumerate(embedders):
        if not left:
            break
        try:
            for i, v in zip(left, _vectors(embedder, [texts[i] for i in left], deadline, dims), strict=True):
                out[i] = (v, None, number)
            left = []
            continue
        except TimeoutError as e:
            if number + 1 < len(embedders):
                for i in left:
                    out[i] = (None, f"{type(e).__name__}: {e}", None)
                continue
        except Exception:  # whichever text is at fault is found below
            pass
        failed = []
        for i in left:
            try:
                out[i] = (_vectors(embedder, [texts[i]], deadline, dims)[0], None, number)
            except Exception as e:  # one bad text must not cost the batch
                out[i] = (None, f"{type(e).__name__}: {e}", None)
                failed.append(i)
        left = failed
    return out


def embed(docs: DataFrame, id_col: str, text_col: str, embedder: Embedder, batch: int = 32, deadline: float | None = None, dims: int | None = None, fallback: Embedder | None = None) -> DataFrame:
    """id, embedding, error, provider: vectors of an embedder in batches of `batch`.

    A batch that fails is tried one by one; what fails then goes to `fallback`, in the same way, and keeps a null vector
    and the last error if that fails too. A call may take `deadline` seconds; a batch that takes longer goes to `fallback`
    at once, where there is one. Vectors of another width than `dims` are errors, so both embedders' vectors can be
    compared: ValueError if `fallback` comes without `dims`. `provider` is 0 for the embedder and 1 for `fallback`. Null
    texts have neither vector nor error. `embed_counts` tells how many there were of each.
    """
    if fallback is not None and dims is None:
        raise ValueError("a fallback needs dims, the width that its vectors and the first embedder's must have")
    id_type = docs.schema[id_col].dataType.simpleString()
    embedders = [embedder] if fallback is None else [embedder, fallback]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple[list[float] | None, str | None, int | None]] = []
            for k in range(0, len(b), batch):
                part = b[text_col].iloc[k : k + batch].tolist()
                got = iter(_embedded([t for t in part if t is not None], embedders, deadline, dims))
                out += [(None, None, None) if t is None else next(got) for t in part]
            yield pd.DataFrame({id_col: b[id_col], "embedding": [v for v, _, _ in out], "error": [e for _, e, _ in out], "provider": pd.array([n for _, _, n in out], "Int32")})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, embedding array<double>, error string, provider int")


def embed_counts(embedded: DataFrame, observation: Observation) -> DataFrame:
    """The same rows; `observation` has the numbers `embedded`, `fell_back`, `failed` and `without_text` once they were written."""
    n = lambda test, name: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).alias(name)
    vector, error = F.col("embedding").isNotNull(), F.col("error").isNotNull()
    return embedded.observe(observation, n(vector, "embedded"), n(F.coalesce(F.col("provider") == 1, F.lit(False)), "fell_back"), n(error, "failed"), n(~vector & ~error, "without_text"))


def scored_by(candidates: DataFrame, query_id: str, id_col: str, query: str, text: str, reranker: Reranker) -> DataFrame:
    """(query, id, rerank_score) by a reranker, for `search.rerank`; the texts of one question within an Arrow batch go to it together."""
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby(query_id, sort=False):
                yield pd.DataFrame({query_id: g[query_id], id_col: g[id_col], "rerank_score": [float(x) for x in reranker(g[query].iloc[0], g[text].tolist())]})

    return candidates.select(query_id, id_col, query, text).mapInPandas(run, f"{query_id} {kinds[query_id]}, {id_col} {kinds[id_col]}, rerank_score double")


def segments_by(docs: DataFrame, id_col: str, text_col: str, segmenter: Segmenter) -> DataFrame:
    """Segments of each text by a segmenter."""
    return _mapped(docs, id_col, text_col, segmenter, SEGMENTS)
