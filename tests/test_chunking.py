"""Chunking plans against plain loops over single texts."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import md5

import pytest

from siltstone.operators import chunking
from tests.oracle import DATA


def recursive_chunks(text: str, size: int, overlap: int, separators: tuple[str, ...] = chunking.SEPARATORS) -> list[str]:
    """Pieces of at most `size` estimated tokens, cut at the coarsest separator that will do, with up to `overlap` tokens repeated."""
    most = 4 * size
    if len(text) <= most:
        return [text] if text.strip() else []
    sep = next(s for s in separators if s == "" or s in text)
    if sep == "":
        step = 4 * (size - overlap)
        return [text[i : i + most] for i in range(0, len(text) - 4 * overlap, step)]
    out, held = [], ""
    for part in text.split(sep):
        joined = held + sep + part if held else part
        if len(joined) <= most:
            held = joined
            continue
        if held:
            out.append(held)
            tail = held[-4 * overlap :] if overlap else ""
            held = tail + sep + part if tail and len(tail) + len(sep) + len(part) <= most else part
        else:
            held = part
        if len(held) > most:
            out += recursive_chunks(held, size, overlap, separators[separators.index(sep) + 1 :])
            held = ""
    return out + [held] if held.strip() else out


def semantic_chunks(text: str, threshold: float, least: int) -> list[str]:
    """The same sentence by sentence; cosines as squares of whole numbers."""
    said = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    vectors = []
    for s in said:
        v: Counter = Counter()
        for w in re.findall(r"\w+", s.lower()):
            h = md5(w.encode()).digest()
            v[(h[0] << 8 | h[1]) % 64] += 1 if h[2] < 128 else -1
        vectors.append(v)
    out: list[str] = []
    for i, s in enumerate(said):
        if i:
            u, v = vectors[i - 1], vectors[i]
            dot, norms = sum(x * v[k] for k, x in u.items()), sum(x * x for x in u.values()) * sum(x * x for x in v.values())
            like = norms > 0 and dot >= 0 and dot * dot >= threshold * threshold * norms
        if not i or (len(out[-1]) >= 4 * least and not like):
            out.append(s)
        else:
            out[-1] += " " + s
    return out


def chunked(df) -> dict:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (str(r[0]), r.chunk_index)):
        out.setdefault(r[0], []).append(r.content)
    return out


def odd_texts() -> list[str | None]:
    rng = random.Random(3)
    parts = ["a", "bc", "word", " ", " ", ". ", ".", "\n", "\n\n", "é", "日本", "x" * 30, "!", "? ", "\n\n\n"]
    return [None, "", "  \n ", "short", "x" * 500, "\n\n" * 200, "word " * 300, " " * 300 + "end"] + ["".join(rng.choices(parts, k=rng.randint(1, 400))) for _ in range(150)]


@pytest.mark.parametrize("size, overlap, block", [(5, 1, 16), (10, 0, 64), (20, 8, 7), (50, 5, 1 << 16)])
def test_recursive_chunks(spark, monkeypatch, size, overlap, block):
    """Blocks smaller than a chunk too, so that ranges cross several."""
    monkeypatch.setattr(chunking, "_BLOCK", block)
    texts = odd_texts()
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = chunked(chunking.chunk_recursive(d, "id", "t", size, overlap))
    want = {i: recursive_chunks(t, size, overlap) for i, t in enumerate(texts) if t and re.search(r"\S", t)}
    assert got == {i: c for i, c in want.items() if c}
    assert all(len(c) <= 4 * size for cs in got.values() for c in cs)


def test_recursive_chunks_keep_whole_documents(spark):
    d = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    got = chunked(chunking.chunk_recursive(d, "doc_id", "text", 64, 8))
    for r in d.collect():
        assert got.get(r.doc_id, []) == recursive_chunks(r.text or "", 64, 8)


def test_overlap_must_be_less(spark):
    with pytest.raises(ValueError, match="overlap"):
        chunking.chunk_recursive(spark.range(1).selectExpr("id", "'a' t"), "id", "t", 10, 10)


@pytest.mark.parametrize("threshold, least", [(0.5, 2), (0.3, 10), (0.9, 0)])
def test_semantic_chunks(spark, threshold, least):
    """Null ids, repeated rows, sentences without words, clashing names."""
    rng = random.Random(5)
    texts = odd_texts() + [" ".join(" ".join(rng.choices("ant bee cat dog eel fox".split(), k=rng.randint(0, 4))) + rng.choice(".!?") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "_id long, _text string, _key string, chunk_index int")
    got = chunked(chunking.chunk_semantic(d, "_id", "_text", threshold, least))
    want = {i: semantic_chunks(t, threshold, least) for i, t in enumerate(texts) if t}
    assert got == {i: c for i, c in want.items() if c}


def test_semantic_chunks_of_repeated_rows(spark):
    d = spark.createDataFrame([(None, "One. Two."), (1, "One. Two."), (1, "One. Two."), (1, "Three.")], "id long, t string")
    rows = sorted(chunking.chunk_semantic(d, "id", "t").collect(), key=str)
    assert [(r.id, r.chunk_index, r.content) for r in rows] == [(1, 0, "One. Two."), (1, 0, "One. Two."), (1, 0, "Three."), (None, 0, "One. Two.")]


def test_chunks_need_no_python(spark):
    d = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    for df in (chunking.chunk_recursive(d, "doc_id", "text"), chunking.chunk_semantic(d, "doc_id", "text")):
        plan = df._jdf.queryExecution().toString()
        assert "InPandas" not in plan and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
