"""Token counts by section: whole documents are encoded once, the tokens' character spans are joined to
the sections' intervals, and a token that crosses a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.llm.common import refuse_clashes
from arbolex.llm.pieces import encoder, slices

RULES = ("first", "last", "majority")
SCHEMA = "doc_id long, field string, section int, start int, end int, n_tokens long, n_crossing long, doc_tokens long"


def allocate(start: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token and whether it crosses a boundary. Sections lie between ascending edges
    and cover all characters; tokens are non-empty spans. first: the section of the token's first
    character; last: of its last; majority: that of most of its characters, the earlier on a tie."""
    a = np.searchsorted(edges, start, "right") - 1
    b = np.searchsorted(edges, end - 1, "right") - 1
    if rule == "first":
        return a, a != b
    if rule == "last":
        return b, a != b
    best, most = a.copy(), np.minimum(end, edges[a + 1]) - start
    for i in np.flatnonzero(a != b):
        for s in range(a[i] + 1, b[i] + 1):
            n = min(end[i], edges[s + 1]) - max(start[i], edges[s])
            if n > most[i]:
                best[i], most[i] = s, n
    return best, a != b


def _counted(tokenizer: str, fields: tuple[str, ...], rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in slices(batches, *(f"__{f}" for f in fields)):
            values = [[x or "" for x in batch.column(f"__{f}").to_pylist()] for f in fields]
            texts = ["\n".join(x) for x in zip(*values, strict=True)]
            ids, at, where = tool.encode_with_places(texts)
            out: list[list] = [[] for _ in range(8)]
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                names, sections, edges, place = [], [], [0], 0
                for f, v in zip(fields, (x[i] for x in values), strict=True):
                    lines = v.split("\n")
                    for j, line in enumerate(lines):
                        place += len(line) + 1  # with the newline after it
                        names.append(f)
                        sections.append(j)
                        edges.append(place)
                edges[-1] -= 1  # nothing follows the last line
                start = where[at[i] : at[i + 1]]
                end = np.maximum(start + 1, np.append(start[1:], len(texts[i]))) if len(start) else start
                edge = np.array(edges)
                own, cross = allocate(start, end, edge, rule)
                count = np.bincount(own, minlength=len(names))
                crossing = np.bincount(own[cross], minlength=len(names))
                for column, x in zip(out, ([doc] * len(names), names, sections, edges[:-1], edges[1:], count.tolist(), crossing.tolist(), [len(start)] * len(names)), strict=True):
                    column += x
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], SCHEMA.replace(",", "").split()[::2])

    return run


def token_counts(docs: DataFrame, tokenizer: str, fields: tuple[str, ...] = ("source", "lang", "text"), rule: str = "majority") -> DataFrame:
    """doc_id, field, section int (line of the field), start and end int (code points in the rendered
    document, each line with its newline), n_tokens long, n_crossing long (those of them that reach into
    another section), doc_tokens long: one row for each line of each field.

    The fields, joined by newlines, are encoded as one text; each token counts in exactly one section, so
    n_tokens adds up to doc_tokens. Null counts as empty: a section without characters (but its newline).
    Null and repeated doc_ids: each row is a document of its own. Empty table: no rows. Other columns are
    left out. Very long texts are whole.
    """
    if rule not in RULES:
        raise ValueError(rule)
    refuse_clashes(docs, "doc_id", *fields)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"__{f}") for f in fields])
    return rows.mapInArrow(_counted(tokenizer, fields, rule), SCHEMA)
