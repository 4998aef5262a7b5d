"""Token totals by source, language and tokenizer version, kept by signed deltas.

A change says what happened to a document under one tokenizer version: ``insert`` and
``delete`` carry its count, ``revise`` the old and the new one (with the old keys, if
the document moved to another source, language or version). Changes become signed rows,
which are summed before they are shuffled and written as one partition for the batch.
Totals are sums over all partitions; no batch reads what was stored before.

A commit replaces the partition of its own batch, so a batch that is sent again, or
whose first try died half-way, counts once. The folder lies where all executors reach it.

Null sources, languages and versions are keys of their own; null counts are 0, and
unknown or null operations are an error. Groups whose documents and tokens both came to
0 are left out. Repeated rows are changes of their own. Empty batches change nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetally.llm.common import slices
from pulsetally.llm.tokens import ChunkTokenizer

KEYS = ("source", "lang", "tokenizer")
_DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, batch string"


def signed(changes: DataFrame) -> DataFrame:
    """Rows (source, lang, tokenizer, docs, tokens) that add up to the effect of ``changes``.

    ``changes`` has op, the keys and tokens; for revisions also old_tokens, and old_source,
    old_lang, old_tokenizer where these differ.
    """
    has = set(changes.columns)
    tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0))
    old = F.coalesce(F.col("old_tokens").cast("long"), F.lit(0)) if "old_tokens" in has else F.lit(0).cast("long")

    def row(sign: int, count, prefix: str = ""):
        keys = [F.col(f"{prefix}{k}" if f"{prefix}{k}" in has else k).cast("string").alias(k) for k in KEYS]
        return F.struct(*keys, F.lit(sign).cast("long").alias("docs"), (count * sign).alias("tokens"))

    effect = (
        F.when(F.col("op") == "insert", F.array(row(1, tokens)))
        .when(F.col("op") == "delete", F.array(row(-1, tokens)))
        .when(F.col("op") == "revise", F.array(row(-1, old, "old_"), row(1, tokens)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))).cast(
            "array<struct<source:string,lang:string,tokenizer:string,docs:bigint,tokens:bigint>>"
        ))
    )
    return changes.select(F.inline(effect))


class TokenRollup:
    """Totals below a folder, changed by committed batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/deltas"

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Store the effect of a batch; the same ``batch`` again replaces it."""
        (
            signed(changes)
            .groupBy(*KEYS)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .coalesce(1)
            .withColumn("batch", F.lit(batch))
            .write.partitionBy("batch")
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .parquet(self.path)
        )

    def on_stream(self, run: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function; ``run`` names the checkpoint, whose batch numbers start at 0."""
        return lambda changes, number: self.commit(f"{run}-{number}", changes)

    def deltas(self) -> DataFrame:
        try:
            return self.spark.read.schema(_DELTAS).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _DELTAS)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches."""
        return (
            self.deltas()
            .groupBy(*KEYS)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .filter("docs <> 0 OR tokens <> 0")
        )


def count_tokens(documents: DataFrame, tokenizer: str, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of the documents with ``n_tokens``, the ids a tokenizer file gives; null text has none."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ChunkTokenizer(tokenizer)
        for batch in slices(batches):
            found = pa.array([words.count(t.as_py() or "") for t in batch.column(len(columns))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], found], [*columns, "n_tokens"])

    return documents.select(*columns, F.col(text_column).alias("__text")).mapInArrow(
        count, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_tokens long"
    )
