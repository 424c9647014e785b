"""Document and term frequencies of passages as they arrive (an extension; the study's stages are batch).

``running_counts`` is a streaming aggregate with its state in the engine; ``maintain`` writes one
delta table a batch, keyed by the batch's number, so that a batch which runs again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postwright.functions.text import runs
from postwright.operators import tokens as T
from postwright.operators.vocabulary import document_counts


def running_counts(passages: DataFrame) -> DataFrame:
    """(word, df, tf) over a stream of (pid, text). Words count within their passage first, by sorting them, so the state is one row a word."""
    words = F.array_sort(F.transform(runs(F.col("text")), F.lower))
    counted = passages.select(words.alias("w")).select(F.explode(F.transform(
        F.array_distinct("w"), lambda x: F.struct(x.alias("word"), (F.size("w") - F.size(F.array_remove("w", x))).alias("n")))).alias("c"))
    return counted.groupBy(F.col("c.word").alias("word")).agg(F.count("*").alias("df"), F.sum("c.n").alias("tf"))


def maintain(passages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start writing each batch's counts as ``folder/batch=<n>``."""

    def write(batch: DataFrame, number: int) -> None:
        document_counts(T.tokens(batch)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return passages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(deltas: DataFrame) -> DataFrame:
    """(word, df, tf) over all batches written."""
    return deltas.groupBy("word").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
