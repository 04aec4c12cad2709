"""A vocabulary that follows a stream of CoNLL files. The state is one count for each word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbolex.operators.vocab import lemma_counts
from arbolex.sources.conll import parse_sentences


def sentence_stream(spark: SparkSession, path: str) -> DataFrame:
    """toks of all sentences of files as they arrive in a folder."""
    rows = spark.readStream.format("text").option("lineSep", "\n\n").load(path)
    return parse_sentences(rows)


def lemma_stream(sentences: DataFrame, name: str, checkpoint: str, least: int = 1) -> StreamingQuery:
    """Keeps the counts in the memory table name: complete after each batch."""
    counts = lemma_counts(sentences).where(F.col("cn") >= least)
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
