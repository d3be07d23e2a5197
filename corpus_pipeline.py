"""The corpus pipeline: documents in, token shards out.

Each stage is (name, function of (spark, docs, sf_dir)); it takes what the
stage before it kept, written as Parquet and read again, and all but the last
return the columns of `documents`.  Stages handle NULLs, empty and long texts,
repeated rows and empty tables as their operators do; the last returns
doc_id, start, n_tokens and ids_crc32 of every document it wrote.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, mixing, pu_classifier, simhash, wavelet
from quarry.llm.common import fold, text_batches
from quarry.session import remove_staged, stage, staged_paths


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't reject."""
    return pu_classifier.keep_good(docs, _table(spark, sf_dir, "labels"), fold("doc_id") != 0)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest id."""
    text_batches(spark)
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shuffled over shards."""
    return mixing.draw_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet token shards of every drawn document, and their index."""
    text_batches(spark)
    return wavelet.encode_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]

#: Fingerprints, training and alignment can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`.  A stage's tables are removed when its
    output is written, the output when the next one is."""
    docs, before = _table(spark, sf_dir, "documents"), []
    for _, step in STAGES[:-1]:
        with staged_paths() as made:
            docs = stage(step(spark, docs, sf_dir), "pipeline")
        remove_staged(spark, [*before, *made[:-1]])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
