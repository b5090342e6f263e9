from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score double, positions int, n string, _n int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 6))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empties, ties, copies, near copies, shared passages, long and odd texts."""
    rng = random.Random(5)
    passage = words(rng, 40)
    base = [words(rng, rng.randint(30, 120)) for _ in range(12)]
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, "   \n\t"), (3, "one two"), (4, "ONE two"), (5, "!!! ??? ..."), (6, "日本語 の テキスト です はい"), (None, base[0]), (None, None)]
    rows += [(10 + i, t) for i, t in enumerate(base)]
    rows += [(40 + i, base[i % 3]) for i in range(9)]  # exact copies
    for i in range(30):  # near copies of one text, and of one another to differing degrees
        w = base[4].split(" ")
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = "x" * rng.randint(1, 5)
        rows.append((60 + i, " ".join(w)))
    rows += [(100 + i, words(rng, 20) + " " + passage + " " + words(rng, 20)) for i in range(8)]
    rows += [(120, "a" * 5000), (121, "ab" * 3000), (122, base[5] + " " + "a" * 4000), (123, words(rng, 30_000)), (124, "ONE\ttwo\rthree  four five"), (125, "one two three four five")]
    rows += [(11, base[1]), (11, base[1]), (11, base[2])]  # rows that repeat an id
    return rows


def edge(spark, rows=None):
    """With extra columns whose names clash with those that operators use inside."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else "fr", None if i == 3 else "s", len(t or ""), 1, 0.5, 2, "x", 3) for i, t in rows], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return edge(spark).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return edge(spark, [])
