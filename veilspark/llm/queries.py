"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import audio, fim, htmlx, jaccard, lm, negatives, packing, pii, quality, rules, simhash, spm, urlfilter
from .shared import documents, pages

MIXTURE = 0.7  #: op4 packs under the sources' tokens to this power, a mixture that is not the corpus's own


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.result(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.result(documents(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(pages(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), MIXTURE).withColumnRenamed("queue", "source")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlx.extract(pages(spark, sf_dir))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.result(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.result(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.result(documents(spark, sf_dir))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.result(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_lm": op5_lm,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_audio": op8_audio,
    "op9_quality_rules": op9_quality_rules,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fim": op13_fim,
}

ORACLES: dict[str, str] = {
    "op3_url_filter": urlfilter.ORACLE,
    "op9_quality_rules": rules.ORACLE,
    "op11_jaccard_join": jaccard.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_fim": fim.ORACLE,
}
