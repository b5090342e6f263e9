"""Substrings and names found by equal keys: short runs of characters, words. No pattern is compared with every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.routing import mentions
from siltstone.operators.steps import hinted

#: Runs of three characters find patterns of three and more; shorter patterns are runs themselves.
WIDTH = 3


def grams(low: Column, width: int) -> Column:
    """The distinct runs of `width` characters of a text; none if it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - width + 1), lambda i: F.substring(low, i, F.lit(width)))
    return F.when(F.length(low) >= width, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def postings(texts: DataFrame, text: str) -> DataFrame:
    """The rows of `texts` for each run of up to `WIDTH` characters in their lower-cased text, as `_gram`: written once, it serves any patterns. A null text has none."""
    low = F.lower(text)
    return texts.select("*", F.explode(F.concat(*[grams(low, n) for n in range(1, WIDTH + 1)])).alias("_gram"))


def rarest(patterns: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    """_low, _gram: for each lower-cased pattern that isn't empty the run that the fewest postings have; patterns with a run that none has are left out."""
    low = patterns.select(F.lower(pattern).alias("_low")).where("_low <> ''").distinct()
    runs = low.select("_low", F.explode(F.when(F.length("_low") < WIDTH, F.array("_low")).otherwise(grams(F.col("_low"), WIDTH))).alias("_gram"))
    counts = index.select("_gram").join(hinted(runs.select("_gram").distinct()), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    best = runs.join(counts, "_gram", "left").groupBy("_low").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("b"))
    return best.where("b.n > 0").select("_low", F.col("b._gram").alias("_gram"))


def containing(patterns: DataFrame, index: DataFrame, pattern: str, text: str) -> DataFrame:
    """Each row of `patterns` with each row of `index` (of `postings`) whose text holds the pattern, whatever the case.

    Candidates are the postings of a pattern's rarest run; each is then compared. An empty or null pattern finds nothing.
    Rows that repeat on either side are all kept.
    """
    asked = patterns.withColumn("_low", F.lower(pattern)).join(rarest(patterns, index, pattern), "_low")
    found = index.join(hinted(asked), "_gram")
    return found.where(F.contains(F.lower(text), F.col("_low"))).drop("_gram", "_low")


def mentioned(texts: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Each row of `texts` with each row of `names` whose name stands in the text as whole words, whatever the case.

    Candidates are texts with the longest word of a name among their words, or with the first character of a name that
    has none; each is then compared. Empty, blank and null names are in no text.
    """
    every = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\w+|[^\w\s]"), F.lit(0))
    rank = lambda w: F.struct(F.rlike(w, F.lit(r"\w")).alias("word"), F.length(w).alias("n"), w.alias("w"))
    keyed = names.withColumn("_word", F.array_max(F.transform(every(name), rank))["w"]).where("_word IS NOT NULL")
    x = texts.withColumn("_word", F.explode(F.array_distinct(every(text)))).join(hinted(keyed), "_word")
    return x.where(F.size(mentions(F.col(text), F.array(name))) > 0).drop("_word")
