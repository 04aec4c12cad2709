"""CoNLL text: sentences are what blank lines part, tokens are lines of ten tab-separated fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def _parsed(text: Column) -> Column:
    lines = F.filter(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: (x != "") & ~x.startswith("#"))
    return F.transform(lines, lambda x: F.split(x, "\t"))


def parse_sentences(rows: DataFrame) -> DataFrame:
    """toks of each sentence in rows of text; several sentences in a row are told apart by blank lines."""
    rows = rows.select(F.explode(F.split(F.regexp_replace("value", "\r", ""), "\n\n+")).alias("value")).select(_parsed(F.col("value")).alias("rows"))
    rows = rows.where((F.size("rows") > 0) & F.forall("rows", lambda r: F.size(r) == len(FIELDS)))
    return rows.select(F.transform("rows", lambda r: F.struct(*[F.get(r, i).alias(f) for i, f in enumerate(FIELDS)])).alias("toks"))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """sent_id long, toks array<struct of FIELDS>. Comment lines are skipped; a sentence with a line of
    more or fewer than ten fields, or without lines, goes whole. The ids rise with the place in the files.

    Files are split between tasks at blank lines. (Files with CRLF hold no bare double newline, and are
    one row each.)
    """
    rows = parse_sentences(spark.read.option("lineSep", "\n\n").text(path))
    return rows.select(F.monotonically_increasing_id().alias("sent_id"), "toks")


def as_text(sentences: DataFrame) -> DataFrame:
    """value: each sentence as text, a blank line after it once written."""
    line = lambda t: F.concat_ws("\t", *[t[f] for f in FIELDS])
    return sentences.select(F.concat(F.array_join(F.transform("toks", line), "\n"), F.lit("\n")).alias("value"))


def write_conll(sentences: DataFrame, path: str) -> None:
    as_text(sentences).write.text(path)
