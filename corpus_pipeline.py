"""The corpus pipeline: each stage's result is written as Parquet and read again as the documents of the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import bpe, decontaminate, exact_dedup, shingle_join, toxicity
from changelens.llm.common import shared_folder, table

#: Text of a block of the last stage. Its Python workers have run the other stages before and keep what these took, so blocks
#: are smaller than those of the operator alone.
BPE_BLOCK_BYTES = 8 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7; null and empty texts have the score of no evidence."""
    return toxicity.below(docs, table(spark, sf_dir, "labels"), 0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: of most code points, then of the smallest id (null ids last)."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one whose id is its component's. Documents without an id or words stay."""
    return shingle_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding gives the text back."""
    out = bpe.round_trip(docs, block_bytes=BPE_BLOCK_BYTES)
    digest = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), digest)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", tokenise),
]

#: Learnt scores, latent retrieval and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
