"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes all documents that its predecessor kept. ``run`` writes the documents between stages
into the shared folder, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.llm.common import stored, table
from arbolex.llm.decontaminate import decontaminate
from arbolex.llm.linededup import line_dedup
from arbolex.llm.neardup import near_duplicates
from arbolex.llm.packing import pack, pieces
from arbolex.llm.quality import quality_rules
from arbolex.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the rules reject."""
    return quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; n_chars follows."""
    out = line_dedup(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near-duplicates: that of least doc_id."""
    gone = near_duplicates(docs, k=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold ten consecutive words of a benchmark item, or all of a shorter one."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, remove="documents").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences of at most 1024 tokens, with their ids (little-endian unsigned 32-bit)."""
    return pieces(pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end=0))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", benchmarks), ("packing", packing)]

#: SQL cannot grow trees, sketch or tokenize; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
