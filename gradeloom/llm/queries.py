"""The named queries: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import (
    decontaminate,
    dialogue,
    embeddings,
    html,
    licenses,
    lm,
    minhash,
    mixing,
    quality,
    repeats,
    urls,
    warc,
    whitening,
)
from gradeloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("place", "root")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rule_table(spark, urls.RULES)
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damage(table(spark, sf_dir, "conversations")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("n_kept", "detections")


QUERIES: dict[str, Query] = {
    "op1_extract_html": op1_extract_html,
    "op2_minhash": op2_minhash,
    "op3_warc": op3_warc,
    "op4_lm_score": op4_lm_score,
    "op5_mix_sources": op5_mix_sources,
    "op6_suffix_array": op6_suffix_array,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_embeddings": op9_embeddings,
    "op10_decontaminate": op10_decontaminate,
    "op11_repair_conversations": op11_repair_conversations,
    "op12_whitening": op12_whitening,
    "op13_licenses": op13_licenses,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op3_warc": warc.SQL,
    "op5_mix_sources": mixing.SQL,
    "op7_url_filter": urls.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_repair_conversations": dialogue.SQL,
    "op13_licenses": licenses.SQL,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
