"""A corpus pipeline of five stages, each one of the operators of wristloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
shared folder and reads it again as the next stage's docs.  All but the last return the columns of documents.

Columns of docs beyond doc_id, text, lang, source and n_chars pass through, whatever their names.  No documents give none.
Repeated rows are rows of their own; what a stage does with nulls and empty texts is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wristloom.llm import linededup, mixing, packing, quality, simhash
from wristloom.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's thresholds reject go: null and empty texts among them.

    A null lang or source is a group, shared with the empty string's.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents share stay in one of them; texts and n_chars follow.

    Null texts stay null; rows without a doc_id lose no line and make none common.
    """
    return linededup.without_common_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays.

    Texts without words, null ones too, are copies of each other; rows without a doc_id stay.
    """
    return simhash.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by probabilities raked to source, language and topic targets.

    Cells without tokens are kept, so null and empty texts are; a null lang or source is the empty string's, a null doc_id has the chance of one.
    """
    return mixing.sample_mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are packed into sequences of 4096: one row per piece; a null or empty text is the end id alone."""
    return packing.harmonic_pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", sequence_packing),
]

#: Fingerprints and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
