"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word of licence scans and decontamination: digits, lower-case ASCII letters and everything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text already lower-cased: array<string>, empty for empty text."""
    return F.array_remove(F.split(text, NOT_WORD), "")


def row_key(*cols: str) -> list[Column]:
    """A 128-bit fingerprint of a row's content in two longs, never null, so that rows with null or
    repeated ids join back to themselves. Rows equal in these columns share it, and get equal results."""
    return [F.xxhash64(*cols, *map(F.isnull, cols)).alias("__k1"), F.xxhash64(F.lit(1), *cols, *map(F.isnull, cols)).alias("__k2")]


KEY = ["__k1", "__k2"]


def row_name(df: DataFrame) -> str:
    """A name that no column of df has."""
    name = "__row"
    while name in map(str.lower, df.columns):
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of a caller's column can meet one of ours."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias(row_name(df))


def of_row(df: DataFrame) -> list[Column]:
    """The columns of df out of that struct."""
    return [F.col(row_name(df))[c].alias(c) for c in df.columns]


_ENDING: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset (local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="arbolex-")
        spark.conf.set("spark.checkpoint.dir", at)
    folder = f"{at.rstrip('/')}/arbolex-{spark.sparkContext.applicationId}"
    if folder not in _ENDING:  # the folder goes when the driver ends
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _ENDING.add(folder)
    return folder


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back, so that a lost
    executor costs no recomputation. These tables go with ``release``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes every table that ``stored`` has written in this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def refuse_clashes(df: DataFrame, *needed: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
