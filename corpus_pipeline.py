"""Clean and pack a corpus: toxic texts go, one of near copies stays, benchmark items go,
secrets are masked, the rest is packed into sequences.

``run`` applies ``STAGES`` to the documents of a folder. Every stage reads what the one
before it wrote as Parquet below ``spark.checkpoint.dir``, so a lost executor repeats
tasks of one stage only. All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetally.llm import toxicity
from pulsetally.llm.common import given, release_memory, stash
from pulsetally.llm.decontamination import drop_contaminated
from pulsetally.llm.jaccard_join import keep_one
from pulsetally.llm.packing import pack_documents
from pulsetally.llm.secret_scan import redact_secrets
from pulsetally.llm.tokens import word_bpe_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language."""
    model = toxicity.train(docs, given(spark, sf_dir, "labels"))
    release_memory()  # the texts of the fit would stay with the driver through all stages
    return toxicity.reject_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of documents whose five-word shingles are 80 % alike."""
    return keep_one(docs, words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not."""
    return drop_contaminated(docs, given(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` for every secret and the lengths brought up to date."""
    masked = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    length = F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit(""))))
    return masked.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return pack_documents(docs, word_bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The trained classifier and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
