"""Corpus pipeline: documents in, sampled token sequences out.

Each stage is (name, function) with ``function(spark, docs, sf_dir)``; its
result is written as Parquet and read again as the next one's ``docs``. All
stages but the last return the columns of documents. The last returns a row
per document and sample: doc_id, lang, source, sample (from 1), n_pieces, ids,
log_prob, inclusion.

Sampling and training cannot be put as SQL, so there is no ORACLE_SQL; the
tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm import exact_dedup, mixture, sentencepiece_sample, simhash_golay, toxicity
from presslens.llm.util import mod_crc32, stage, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, learned as in query op5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=mod_crc32(F.col("id"), 5) != 0)
    return toxicity.drop_toxic(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_golay.drop_near_copies(docs, shingle=4, most=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the weights of query op6."""
    return mixture.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = sentencepiece_sample.sample_segmentations(
        docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])
    return (rows.select("_row.*", F.posexplode("samples").alias("place", "sample"))
            .select("doc_id", "lang", "source", (F.col("place") + 1).alias("sample"),
                    F.size("sample.ids").alias("n_pieces"), "sample.ids", "sample.log_prob", "sample.inclusion"))


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("SimHash near-dedup", near),
          ("mixing sources to target weights", mix), ("SentencePiece sampling", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
