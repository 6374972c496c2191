"""Documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; all but the last return the columns of ``documents`` and no
others that ``docs`` may have.  An empty table gives an empty one.  Null texts
are empty, and short ones fail the rules; rows without an id are judged by
their own texts and none of them is taken for a near-duplicate of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import packing, quality_model, quality_rules, similar, suffix_dedup
from tracewell.llm.common import discard, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the highest grade, by the ordinal model of all labelled documents."""
    return quality_model.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word-shingle similarities of 0.8 or more link: by SimHash fingerprints first, then by shingles what these leave apart."""
    return similar.keep_one(docs, width=5).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier; a character that a cut splits goes too."""
    done = suffix_dedup.dedup(docs, 100, carry=("lang", "source"), whole=True)
    cut = done.withColumn("text", F.col("kept").cast("string"))
    return cut.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("bigint").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", passages), ("packing", pack)]

#: A fitted model and graph components are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
            discard(*[last] if last else [])
            last = docs
    return docs
