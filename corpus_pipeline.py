"""Corpus pipeline: toxicity, quality rules, near duplicates, benchmark decontamination and SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; `run` writes each result and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import fmindex, isolation, near_dups, pieces, toxicity
from runlens.llm.common import fold, shared_dir, table


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=fold("doc_id", 3) != 1)
    return toxicity.accepted(docs, model, limit=0.7)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the isolation forest sets apart go."""
    return isolation.passed(docs, isolation.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity of 0.8 or more) the least doc_id stays."""
    return near_dups.deduplicated(docs, threshold=0.8, words=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside occurrences of benchmark windows are cut from the texts; no document goes."""
    out = fmindex.decontaminated(docs, table(spark, sf_dir, "benchmark"), width=10)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text; `lossless` says that decoding gives the text again."""
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id",))


STAGES = [
    ("toxicity", non_toxic),
    ("quality_rules", good_quality),
    ("jaccard_join", one_of_each),
    ("decontamination", without_benchmark),
    ("pieces", encoded),
]

#: SQL can't express the learned stages; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = shared_dir(spark, name)
            docs.write.parquet(out)
            docs = spark.read.parquet(out)
    return docs
