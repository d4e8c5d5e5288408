"""The corpus pipeline: documents that aren't toxic, one of each near-duplicate group, without benchmark passages and
personal data, as tokens.

In every stage null and empty texts stay as they are, rows with a null id stay unless their text sends them away, repeated
rows share one fate, an empty table gives an empty one, and columns beside doc_id, text and n_chars only pass through.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklake.llm import decontamination, ngram_join, pii, sentencepiece_bpe, toxicity
from sparklake.llm.common import shared_folder, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression-distance classifier, fitted on the labelled ones among them, scores below 0.5."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, directly or through others, the smallest id."""
    return ngram_join.first_of_each(docs, k=5, percent=80)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, in one piece or several."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by <kind>; n_chars follows the text."""
    return pii.masked(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as little-endian 32-bit token ids with begin and end ids, and the digest of what they decode to."""
    done = sentencepiece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("decontamination", not_leaked),
    ("pii", no_personal_data),
    ("sentencepiece", tokens),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other; what each but the last returns is written to the shared folder, and
    deleted there when the next stage's rows are written. The last written table stays: the result reads it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
