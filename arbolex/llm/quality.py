"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays.

Statistics of whole texts come from numpy over Arrow batches. Trees are grown on the driver from a
bounded sample of labelled documents (SAMPLE, a documented parameter); each is complete to its depth, so
node i's children are 2i + 1 and 2i + 2 and a batch goes down a tree in depth steps. On the MONOTONE
features the score never rises with the feature, whatever the sample: splits that would break this are
not taken, and leaf values stay between the bounds their ancestors' splits set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from arbolex.llm import textarrays
from arbolex.llm.common import of_row, refuse_clashes, row_name, whole_row

SAMPLE = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_digits", "n_marks", "n_wide", "n_lines")
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "wide", "line_words")
#: More symbols, repeated lines, repeated words or exclamation marks never make a document better.
MONOTONE = ("symbols", "dup_lines", "repeats", "marks")
_SYMBOL, _UPPER, _DIGIT, _MARK = (textarrays.byte_class([(ord(c), ord(c)) for c in s]) for s in ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?"))
_FIRST = textarrays.byte_class([(0x00, 0x7F), (0xC0, 0xFF)])
_WIDE = textarrays.byte_class([(0xC0, 0xFF)])
_NEWLINE = 0x0A


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each (row, hash) occurs, and whether it has occurred before."""
    key = textarrays.mix(hashes ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return count[inverse], first[inverse] != np.arange(len(key))


def counts(texts: pa.Array) -> np.ndarray:
    """One row of COUNTS for each text; null is empty.

    word_chars: code points in words; n_dup_lines: lines with a word, equal to an earlier line; n_repeat_words:
    words in 3-word windows that the text has twice or more; n_marks: of !?; n_wide: characters beyond ASCII.
    """
    out = []
    for _, bounds, data in textarrays.chunks(texts):
        n = len(bounds) - 1
        starts, ends, rows = textarrays.word_spans(data, bounds, textarrays.SPACE)
        words = textarrays.span_hashes(data, starts, ends)
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])  # noqa: B023, E731
        inside = ~textarrays.SPACE[data] & _FIRST[data]
        of_word = np.repeat(np.arange(n), np.diff(rows))
        repeated = np.zeros(len(words), bool)
        if len(words) >= 3:
            at = np.flatnonzero(of_word[2:] == of_word[:-2])
            windows, _ = textarrays.shingles(words, np.array([0, len(words)]), 3)
            often, _ = _repeats(of_word[at], windows[at])
            for j in range(3):
                repeated[at[often > 1] + j] = True
        breaks = np.flatnonzero(data == _NEWLINE)
        row_of_break = np.searchsorted(bounds, breaks, "right") - 1
        line_start = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
        line_row = np.sort(np.concatenate([np.arange(n), row_of_break]), kind="stable")
        line_end = np.append(line_start[1:] - 1, bounds[-1])
        last = np.append(line_row[1:] != line_row[:-1], True)
        line_end[last] = bounds[1:]
        has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
        _, before = _repeats(line_row, _line_hashes(data, line_start, line_end))
        per_row = lambda flags, of: np.bincount(of[flags], minlength=n)  # noqa: B023, E731
        out.append(np.column_stack([
            np.diff(rows), total(inside), total(_SYMBOL[data]), per_row(has_word & before, line_row), per_row(repeated, of_word), total(_FIRST[data]),
            total(_UPPER[data]), total(_DIGIT[data]), total(_MARK[data]), total(_WIDE[data]), np.bincount(line_row, minlength=n),
        ]))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, len(COUNTS)), np.int64)


def _line_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    full = end > start
    out[full] = textarrays.span_hashes(data, start[full], end[full])
    return out


def features(count: np.ndarray) -> np.ndarray:
    c = dict(zip(COUNTS, count.T.astype(float), strict=True))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_wide"] / chars, c["n_words"] / np.maximum(c["n_lines"], 1),
    ])


@dataclass
class Trees:
    """Flat arrays: trees x inner nodes, and trees x leaves. A row with value above the threshold goes right."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        total, row = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Newton boosting for logistic loss with histogram splits. monotone: -1, 0 or 1 for each feature."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    score = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        bound = {0: (-np.inf, np.inf)}
        weight = lambda g, h: g / (h + ridge)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            low, high = bound[i]
            best = (1e-9, None, None, None)
            g, h = gradient[rows].sum(), curve[rows].sum()
            for j in range(x.shape[1]) if len(rows) >= 2 * least else ():
                size = len(edges[j]) + 1
                at = binned[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(at, w, size))[:-1] for w in (gradient[rows], curve[rows], None))
                a, b = np.clip(weight(gs, hs), low, high), np.clip(weight(g - gs, h - hs), low, high)
                gain = lambda w, gg, hh: gg * w - 0.5 * (hh + ridge) * w * w
                won = gain(a, gs, hs) + gain(b, g - gs, h - hs) - gain(np.clip(weight(g, h), low, high), g, h)
                won[(ns < least) | (len(rows) - ns < least) | (monotone[j] * (b - a) < 0)] = -1
                if len(won) and (k := int(won.argmax())) is not None and won[k] > best[0]:
                    best = (won[k], j, k, (a[k], b[k]))
            _, j, k, pair = best
            left, right = (low, high), (low, high)
            if j is not None:
                feature[t, i], threshold[t, i] = j, edges[j][k]
                if monotone[j]:
                    middle = sum(pair) / 2
                    left, right = ((low, middle), (middle, high)) if monotone[j] > 0 else ((middle, high), (low, middle))
                node[rows] = 2 * i + 1 + (x[rows, j] > edges[j][k])
            else:
                node[rows] = 2 * i + 1
            bound[2 * i + 1], bound[2 * i + 2] = left, right
        for leaf in range(leaves):
            rows = np.flatnonzero(node == inner + leaf)
            value[t, leaf] = rate * float(np.clip(weight(gradient[rows].sum(), curve[rows].sum()), *bound[inner + leaf])) if len(rows) else rate * float(np.clip(0, *bound[inner + leaf]))
        score += value[t][node - inner]
    return Trees(feature, threshold, value, start)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "__text"]
        count = counts(batch.column("__text"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(c) for c in count.T)], [*rest, *COUNTS])


_TYPES = ", ".join(f"{c} long" for c in COUNTS)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from at most sample labelled documents, those of least hash of doc_id; of a doc_id's texts, the one of
    least hash. None without both labels."""
    few = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("__quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    rows = rows.groupBy("doc_id", "__quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("__text")).select("__quality", "__text")
    got = rows.mapInArrow(_counted, f"__quality {dict(few.dtypes)['__quality']}, {_TYPES}").toPandas()  # at most sample rows
    y = (got["__quality"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = features(got[list(COUNTS)].to_numpy())
    order = np.lexsort([*x.T, y])  # sums in one order, however the rows came
    return grow(x[order], y[order], np.array([-1 if f in MONOTONE else 0 for f in FEATURES]))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Columns of docs, then COUNTS as longs, base_failed boolean, score double, kept boolean.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed, and the trees' probability of good quality reaches the threshold (true, if labels do not
    hold both kinds: no trees then). Null or empty text: all counts 0 (one line), base_failed. Null and
    repeated doc_ids: each row by itself. Labels that repeat or disagree: the best counts. Empty table: no
    rows. Other columns pass through; one named as a result is replaced. Very long texts are whole.
    """
    refuse_clashes(docs, "doc_id", "text")
    refuse_clashes(labels, "doc_id", "quality")
    docs = docs.drop(*COUNTS, "base_failed", "score", "kept")
    trees = fit(docs, labels, sample)
    schema = StructType([StructField(row_name(docs), docs.schema), *[StructField(c, LongType()) for c in COUNTS], StructField("base_failed", BooleanType()), StructField("score", DoubleType()), StructField("kept", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            count = counts(row.field("text"))
            n, repeats = count[:, 0], count[:, 4]
            failed = (n < 50) | (100 * repeats > 50 * n)
            score = trees.score(features(count)) if trees else np.ones(len(n))
            yield pa.RecordBatch.from_arrays([row, *(pa.array(c) for c in count.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], [*schema.names[:1], *COUNTS, "base_failed", "score", "kept"])

    return docs.select(whole_row(docs)).mapInArrow(run, schema).select(*of_row(docs), *schema.names[1:])
