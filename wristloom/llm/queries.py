"""The numbered operators as queries over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bitpack, chroma, langid, linededup, mixing, packing, pii, quality, repeats, search, simhash, urls, whitening
from .common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir), pii.fit(pii.labelled_table(spark)))


def op2_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.encode_to_files(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(documents(spark, sf_dir))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(documents(spark, sf_dir))


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.aligned(chroma.sonify(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_bitpack, op3_simhash, op4_quality, op5_urls, op6_packing, op7_linededup, op8_chroma, op9_mixing, op10_langid,
        op11_whitening, op12_search, op13_repeats,
    )
}

ORACLE_SQL = {
    "op4_quality": quality.quality_sql(),
    "op5_urls": urls.judge_sql(),
    "op7_linededup": linededup.line_dedup_sql(),
    "op9_mixing": mixing.mix_sql(),
    "op12_search": search.search_sql(),
}
