"""The operators bound to the tables ``documents``, ``benchmark``, ``pages`` and ``labels`` of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillmark.llm import decontamination, langid, lm_score, media, mixing, near_dedup, pii, sql, sst, toxicity, url_filter


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(_table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents")).drop("source", "slot")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(media.with_media(_table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.token_table(_table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict:
    import corpus_pipeline

    ops = (op1_url_filter, op2_decontamination, op3_lm_score, op4_mixing, op5_media, op6_toxicity, op7_langid, op8_pii, op9_near_dedup, op10_token_shards)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    """Where DuckDB can say the same. The others are held against brute force in tests/llm."""
    return {"op1_url_filter": sql.URL_FILTER, "op2_decontamination": sql.DECONTAMINATION, "op4_mixing": sql.MIXING}
