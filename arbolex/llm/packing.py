"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

One shuffle deals documents out at random; each task then streams through its share, closing a group at
GROUP_TOKENS tokens, so memory is bounded whatever the number of rows. A document is cut into pieces of
the sequence length and a rest; full pieces are sequences as they are, rests are packed. Encoding, the
expensive step, runs once, before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.llm.common import refuse_clashes
from arbolex.llm.pieces import encoder, slices

GROUP_TOKENS = 4_000_000
#: Sequences are numbered from the task's number times this.
TASK = 1 << 40
PIECES = "array<struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>>"
SEQUENCES = f"sequence_id long, length int, padded int, ids binary, pieces {PIECES}"
_PIECE = pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "offset")])
_SCHEMA = pa.schema([("sequence_id", pa.int64()), ("length", pa.int32()), ("padded", pa.int32()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE))])


class Bins:
    """Capacities of bins as the leaves of a tournament tree: each inner node holds the larger of its two.

    ``first_fit`` goes down to the leftmost bin that has room, in as many steps as the tree has levels.
    """

    def __init__(self, count: int, capacity: int):
        self.leaves = 1 << max(0, (count - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        tree, i = self.tree, 1
        if tree[1] < size:
            raise ValueError("nothing has room")
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        tree[i] -= size
        leaf = i - self.leaves
        while i > 1:
            i //= 2
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
        return leaf


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; items of equal size in their order."""
    bins, out = Bins(len(sizes), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.first_fit(sizes[i])
    return out


def padded_length(length: int, capacity: int) -> int:
    """A sequence is padded to the capacity, unless its length is a power of two."""
    return length if length & (length - 1) == 0 else capacity


def _encoded(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in slices(batches, "text"):
            ids, at = tool.encode(batch.column("text").to_pylist())
            out = [np.append(ids[at[i] : at[i + 1]], np.uint32(end)).astype("<u4").tobytes() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("__deal"), batch.column("doc_id"), pa.array(out, pa.binary())], ["__deal", "doc_id", "ids"])

    return run


def _packed(capacity: int):
    def pack(group: list[tuple[int | None, bytes]], first: int) -> Iterator[tuple]:
        rests = []
        for doc, ids in group:
            n = len(ids) // 4
            full = n - n % capacity
            for a in range(0, full, capacity):
                yield first, capacity, capacity, ids[4 * a : 4 * (a + capacity)], [(doc, a, capacity, n, 0)]
                first += 1
            if n > full:
                rests.append((doc, full, n, ids[4 * full :]))
        bins: dict[int, list] = {}
        for item, b in zip(rests, first_fit_decreasing([n - a for _, a, n, _ in rests], capacity), strict=True):
            bins.setdefault(b, []).append(item)
        for b in sorted(bins):
            pieces, offset = [], 0
            for doc, a, n, _ in bins[b]:
                pieces.append((doc, a, n - a, n, offset))
                offset += n - a
            yield first, offset, padded_length(offset, capacity), b"".join(x[3] for x in bins[b]), pieces
            first += 1

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "start", "length", "doc_tokens", "offset")
        columns = list(zip(*rows, strict=True))
        columns[4] = [[dict(zip(names, p, strict=True)) for p in x] for x in columns[4]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        following = (context.partitionId() if context else 0) * TASK
        group, tokens = [], 0

        def close():
            nonlocal group, tokens, following
            rows = list(pack(group, following))
            following += len(rows)
            group, tokens = [], 0
            for i in range(0, len(rows), 2000):
                yield table(rows[i : i + 2000])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                group.append((doc, ids))
                tokens += len(ids) // 4
                if tokens >= GROUP_TOKENS:
                    yield from close()
        if group:
            yield from close()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0) -> DataFrame:
    """sequence_id long, length int, padded int, ids binary (little-endian unsigned 32-bit), pieces array:
    one row for each sequence of at most capacity tokens.

    Each document's ids and the end id after them lie in its pieces, each id in exactly one. padded is the
    length to pad to: the capacity, or the length itself where that is a power of two. pieces: doc_id,
    start in the document, length, doc_tokens (with the end id), offset in the sequence, without gaps.

    Null or empty text: the end id alone. Null and repeated doc_ids: each row is a document of its own.
    Ties of length keep the order of the deal. Empty table: no rows. Other columns are left out. Very long
    texts become many full sequences. Which documents meet depends on the hash of doc_id and the row's
    place in the input, and is the same when a task is repeated.
    """
    refuse_clashes(docs, "doc_id", "text")
    deal = F.xxhash64("doc_id", F.monotonically_increasing_id())
    ids = docs.select(deal.alias("__deal"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(tokenizer, end), "__deal long, doc_id long, ids binary")
    return ids.repartition("__deal").sortWithinPartitions("__deal", "doc_id").select("doc_id", "ids").mapInArrow(_packed(capacity), SEQUENCES)


def pieces(sequences: DataFrame) -> DataFrame:
    """One row for each piece, with its own ids cut out of its sequence."""
    rows = sequences.select("sequence_id", "padded", "ids", F.explode("pieces").alias("p")).select("sequence_id", "padded", "ids", "p.*")
    return rows.withColumn("ids", F.expr("substring(ids, cast(4 * offset + 1 as int), cast(4 * length as int))"))
