"""Token ids in Parquet: list columns with dictionary or delta encoding, controlled row groups and page indexes.

Documents are range-partitioned by doc_id and sorted before they are encoded, so the files hold them in
ascending order, and page and row-group statistics of doc_id let readers skip what they do not want;
n_tokens and place are columns of their own, so that metadata is read without the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbolex.llm.common import refuse_clashes
from arbolex.llm.pieces import encoder, slices

SCHEMA = "part int, doc_id long, place long, n_tokens long, ids array<int>"


def _encoded(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, place, tool = TaskContext.get(), 0, encoder(tokenizer)
        part = context.partitionId() if context else 0
        for batch in slices(batches, "text"):
            n = len(batch)
            ids, at = tool.encode(batch.column("text").to_pylist())
            ids = np.insert(ids, at[1:], end).astype(np.int32)
            at = at + np.arange(n + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), batch.column("doc_id"), pa.array(place + at[:-1]), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))],
                ["part", "doc_id", "place", "n_tokens", "ids"],
            )
            place += int(at[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 1, encoding: str = "dictionary", row_group_mb: int = 64, page_rows: int = 2000) -> None:
    """Writes each document's ids and the end id, in ascending order of doc_id; part numbers the files' order.

    encoding: "dictionary" (a table of ids in each row group, then packed indexes) or "delta" (bit-packed
    differences). Null text: the end id alone. Null doc_id: first. Repeated doc_ids: by text. Empty table:
    files without rows. Other columns are left out; very long texts are one list.
    """
    refuse_clashes(docs, "doc_id", "text")
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__h"), "text")
    rows = rows.repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h").select("doc_id", "text")
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.dictionary.page.size": str(4 << 20),
        "parquet.block.size": str(row_group_mb << 20), "parquet.page.row.count.limit": str(page_rows), "parquet.columnindex.truncate.length": "64",
    }
    rows.mapInArrow(_encoded(tokenizer, end), SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start long (ids of all documents before it), n_tokens, and the ids if wanted: the files' own order.

    Filters on doc_id reach the files' page indexes. The sums by part are as many rows as there are parts.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("__before"))
    rows = rows if ids else rows.drop("ids")
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("place") + F.col("__before")).drop("part", "place", "__before")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
