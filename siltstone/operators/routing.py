"""Query routing by rules: which projects a question is about, what is retrieved for it, what a fallback lacks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed phrases: about several projects, about the project at hand.
SEVERAL = [
    "compare", "comparison", "comparing", "versus", "vs", "across", "all projects", "every project", "both projects", "all codebases", "each project", "different from", "differs from",
    "similarities", "differences", "between", "common pattern", "shared pattern", "consistent", "inconsistent",
]
CURRENT = ["this project", "this codebase", "this repo", "this repository", "current project", "focused project", "in here", "here"]
FORCE_BELOW = 0.5


def contained(text: Column, phrases: list[str], whole_words: bool = False, lowered: bool = False) -> Column:
    """The phrases that a text contains, in the order of the list. As parts of words too, unless whole words are asked for. A column of long texts is better lowered once, beforehand."""
    low = text if lowered else F.lower(text)
    test = (lambda p: low.rlike(rf"\b{re.escape(p)}\b")) if whole_words else (lambda p: low.contains(p))
    return F.array_compact(F.array(*[F.when(test(p), F.lit(p)) for p in phrases]))


def mentions(text: Column, names: Column, lowered: bool = False) -> Column:
    """Those of an array of project names that occur as whole words, whatever their case."""
    low = text if lowered else F.lower(text)
    escaped = lambda n: F.regexp_replace(F.lower(n), r"([\\.*+?^${}()|\[\]])", r"\\$1")
    return F.filter(names, lambda n: F.regexp_like(low, F.concat(F.lit(r"\b"), escaped(n), F.lit(r"\b"))))


def intent(named: Column, several: Column, current: Column) -> tuple[Column, Column]:
    """Intent and confidence from the numbers of named projects and found phrases; the first rule that fits counts."""
    rules = [
        (named >= 2, "MULTI_PROJECT", 0.95),
        ((several > 0) & (named > 0), "MULTI_PROJECT", 0.85),
        (named == 1, "SINGLE_PROJECT", 0.9),
        (current > 0, "SINGLE_PROJECT", 0.85),
        (several > 0, "GENERAL", 0.6),
    ]
    kind, sure = F.lit("GENERAL"), F.lit(0.5)
    for test, k, c in reversed(rules):
        kind, sure = F.when(test, k).otherwise(kind), F.when(test, c).otherwise(sure)
    return kind, sure


ACCEPT = 0.7


def reply(text: Column, known: Column) -> Column:
    """A model's reply as struct (ids, confidence): its first brace block, ids that are known only, no confidence without them. Null if there is no block or it doesn't parse."""
    block = F.regexp_extract(text, r"\{[^}]*\}", 0)
    j = F.from_json(F.when(block != "", block), "projectIds array<string>, confidence double")
    ids = F.array_intersect(j["projectIds"], known)
    sure = F.when(F.size(ids) > 0, F.least(F.greatest(F.coalesce(j["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.when(j["projectIds"].isNotNull(), F.struct(ids.alias("ids"), sure.alias("confidence")))


def route(kind: Column, sure: Column, named: Column, current: Column, every: Column, answer: Column | None = None, accept: float = ACCEPT) -> tuple[Column, Column, Column]:
    """Project ids, method and confidence from the intent and its confidence, the ids named, the current id, all ids and, if a model was asked, its `reply` (null: it failed).

    Rules come first. A model is asked only about general questions, or about a current project that there is none of,
    and only where there are two projects and more; a reply below `accept`, or without ids, leads to all projects.
    """
    none, n = F.array().cast("array<string>"), F.size(every)
    here = F.when(current.isNotNull(), F.array(current))
    single, several = kind == "SINGLE_PROJECT", kind == "MULTI_PROJECT"
    by_rule = F.when(single & (F.size(named) > 0), named).when(single, here).when(several, F.when(F.size(named) > 0, named).otherwise(every))
    ids = F.when(n == 0, none).when(by_rule.isNotNull(), by_rule)
    method = F.when(n == 0, "fallback_all").when(by_rule.isNotNull(), "heuristic")
    confidence = F.when(n == 0, 1.0).when(by_rule.isNotNull(), sure)
    if answer is not None:
        good = (answer["confidence"] >= accept) & (F.size(answer["ids"]) > 0)
        ids = ids.when((n >= 2) & good, answer["ids"]).when(n >= 2, every)
        method = method.when((n >= 2) & good, "llm").when(n >= 2, "fallback_all")
        confidence = confidence.when(n >= 2, F.coalesce(answer["confidence"], F.lit(0.5)))
    return ids.otherwise(F.coalesce(here, every)), method.otherwise("fallback_all"), confidence.otherwise(F.when(here.isNotNull(), 0.6).otherwise(0.5))


def forced(ids: Column, method: Column, sure: Column, every: Column, below: float = FORCE_BELOW) -> tuple[Column, Column]:
    """Project ids and method where a search is forced: a route less sure than `below` is taken all the same, as force-rag, and leads to all projects if it has no ids. The confidence stays."""
    unsure = F.coalesce(sure, F.lit(0.0)) < below
    return F.when(unsure & (F.coalesce(F.size(ids), F.lit(0)) <= 0), every).otherwise(ids), F.when(unsure, "force-rag").otherwise(method)


def retrieval_plan(kind: Column, top_k: int) -> Column:
    """What an `adaptive_class` asks for, as struct (skipped, reason, top_k, rerank, with_history): simple questions skip retrieval, complex ones take twice as many and rerank them, conversational ones look at the turns before. An unknown or null class is treated as factual."""
    is_ = lambda k: F.coalesce(kind == k, F.lit(False))
    return F.struct(
        is_("simple").alias("skipped"),
        F.when(is_("simple"), "no retrieval for a simple question").alias("reason"),
        F.when(is_("simple"), 0).when(is_("complex"), 2 * top_k).otherwise(top_k).alias("top_k"),
        is_("complex").alias("rerank"),
        is_("conversational").alias("with_history"),
    )


def lost_capabilities(abilities: DataFrame, pairs: DataFrame) -> DataFrame:
    """provider, fallback, lost (sorted, comma-joined) and n_lost: what a provider can (provider, ability) and its fallback can't, for each of `pairs` (provider, fallback). Repeated rows count once."""
    of_fallback = abilities.select(F.col("provider").alias("fallback"), "ability")
    gone = abilities.join(pairs, "provider").join(of_fallback, ["fallback", "ability"], "left_anti")
    told = gone.groupBy("provider", "fallback").agg(F.array_sort(F.collect_set("ability")).alias("l"))
    out = pairs.distinct().join(told, ["provider", "fallback"], "left").withColumn("l", F.coalesce("l", F.array().cast("array<string>")))
    return out.select("provider", "fallback", F.array_join("l", ",").alias("lost"), F.size("l").cast("long").alias("n_lost"))


def adaptive_class(text: Column) -> Column:
    """simple, conversational, complex or factual, by our own rules on length and leading words; simple ones skip retrieval."""
    low = F.trim(F.lower(text))
    n = F.size(F.split(low, r"\s+"))
    return (
        F.when(low.rlike(r"^(hi|hello|hey|thanks|thank you|ok|okay|bye)\b"), "simple")
        .when(low.rlike(r"\b(you said|earlier|previous answer|that again|go on)\b"), "conversational")
        .when((n > 20) | low.rlike(r"\b(compare|versus|why|explain|architecture|trade-?offs?)\b"), "complex")
        .otherwise("factual")
    )
