"""Model files: a header line, then word, blank, vector, newline for each word; binary or text.

Binary files are parsed and built one file at a time, on a worker; a model is a file by its format's
nature. Models that are only used here are better kept as Parquet.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.operators.models import normalised

FORMATS = ("parts", "bin", "txt")


@dataclass(frozen=True)
class Header:
    words: int
    size: int
    dep: int = 0
    assoc: int = 0
    gramm: int = 0

    @property
    def sizes(self) -> tuple[int, int, int]:
        return self.dep, self.assoc, self.gramm

    def line(self, kind: str) -> bytes:
        numbers = [self.words, self.size, *(self.sizes if kind == "parts" else ())]
        return (" ".join(map(str, numbers)) + "\n").encode()


def parse(data: bytes, kind: str) -> tuple[Header, list[str], np.ndarray]:
    if kind not in FORMATS:
        raise ValueError(kind)
    end = data.index(b"\n")
    numbers = list(map(int, data[:end].split()))
    if len(numbers) != (5 if kind == "parts" else 2):
        raise ValueError(f"not the header of a {kind} model: {data[:end][:80]!r}")
    head = Header(*numbers) if kind == "parts" else Header(*numbers, dep=numbers[1])
    words, vectors, at = [], np.zeros((head.words, head.size), np.float32), end + 1
    for i in range(head.words):
        blank = data.index(b" ", at)
        words.append(data[at:blank].decode())
        if kind == "txt":
            at = data.index(b"\n", blank)
            vectors[i] = np.array(data[blank + 1 : at].split(), np.float32)
        else:
            at = blank + 1 + 4 * head.size
            vectors[i] = np.frombuffer(data, "<f4", head.size, blank + 1)
            if data[at : at + 1] != b"\n":
                raise ValueError(f"vector {i} has no end")
        at += 1
    return head, words, vectors


def build(head: Header, rows: Iterator[tuple[str, list[float]]], kind: str) -> bytes:
    out = [head.line(kind)]
    for word, vec in rows:
        body = " ".join(f"{x:f}" for x in vec).encode() if kind == "txt" else struct.pack(f"<{len(vec)}f", *vec)
        out += [word.encode(), b" ", body, b"\n"]
    return b"".join(out)


def read_model(spark: SparkSession, path: str, kind: str = "parts", normalise: bool = False) -> tuple[Header, DataFrame]:
    """Header, and idx, word, vec. Any path that Spark can read; a zero vector cannot be normalised."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select(F.expr("cast(substring(content, 1, 200) as binary)").alias("c")).first()["c"]
    numbers = list(map(int, bytes(first).split(b"\n")[0].split()))
    head = Header(*numbers) if kind == "parts" else Header(*numbers, dep=numbers[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                h, words, vectors = parse(content.as_py(), kind)
                for i in range(0, h.words, 5000):
                    part = vectors[i : i + 5000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * h.size), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(words[i : i + 5000], pa.string()), lists], ["idx", "word", "vec"])

    rows = files.select("content").mapInArrow(run, "idx int, word string, vec array<float>")
    if normalise:
        from arbolex.functions.vectors import norm

        if not rows.where(norm(F.col("vec")) == 0).isEmpty():
            raise ValueError("a zero vector cannot be normalised")
        rows = normalised(rows)
    return head, rows


#: Rows that go to a file in one call.
AT_ONCE = 2_000


def _stream(rows: DataFrame, path: str, first: bytes, body) -> None:
    """One file at path: first, then body of each lot of rows, in their order."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    part: list = []
    try:
        out.write(first)
        for row in rows.toLocalIterator(prefetchPartitions=True):
            part.append(row)
            if len(part) == AT_ONCE:
                out.write(body(part))
                part = []
        if part:
            out.write(body(part))
    finally:
        out.close()


def write_model(model: DataFrame, path: str, sizes: tuple[int, int, int], kind: str = "parts") -> None:
    """One file at path (a Hadoop path or URI), rows by idx. The format is one file, so the rows stream through the driver."""
    count, size = model.count(), model.select(F.max(F.size("vec"))).first()[0] or sum(sizes)

    def body(rows: list) -> bytes:
        said = build(Header(0, size), iter([(r["word"], r["vec"]) for r in rows]), kind)
        return said[said.index(b"\n") + 1 :]

    _stream(model.orderBy("idx").select("word", "vec"), path, Header(count, size, *sizes).line(kind), body)


def write_rows(rows: DataFrame, path: str, sizes: tuple[int, int, int]) -> None:
    """Vectors without words, by row: a line of four sizes (rows, all dimensions, syntactic, associative), then float32 values alone."""
    first = f"{rows.count()} {sum(sizes)} {sizes[0]} {sizes[1]}\n".encode()
    _stream(rows.orderBy("row").select("vec"), path, first, lambda part: b"".join(struct.pack(f"<{len(r['vec'])}f", *r["vec"]) for r in part))
