"""Queries opN_<name> that apply the operators, with production parameters, to their whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import collocations, decontaminate, language, lexical, licenses, media, ngrams, quality, segment, sharding, suffixes, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict_language(docs, language.train_language(docs))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(_table(spark, sf_dir, "documents"))


#: The tokenizer's model file; the installed one unless told otherwise.
PIECES = os.environ.get("SILTSTONE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sample_report(_table(spark, sf_dir, "documents"), PIECES)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_report(_table(spark, sf_dir, "documents"))


def op6_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_links(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(_table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats_report(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, lexical.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_language, op3_media, op4_sentencepiece, op5_sharding, op6_jaccard_join, op6_jaccard_links, op7_decontamination, op8_warc, op9_suffix_dedup, op10_toxicity, op11_collocations, op12_lexical, op13_licenses)}


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_join": ngrams.ORACLE, "op6_jaccard_links": ngrams.LINKS_ORACLE, "op7_decontamination": decontaminate.ORACLE, "op8_warc": warc.ORACLE, "op9_suffix_dedup": suffixes.ORACLE, "op11_collocations": collocations.ORACLE, "op12_lexical": lexical.ORACLE, "op13_licenses": licenses.ORACLE}
