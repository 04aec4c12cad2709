"""Licence scans by diagonal voting.

All rolling hashes of word k-grams of the documents are joined, in Spark, to the templates' positions (a
fixed table of a few hundred rows, broadcast). A match votes for the diagonal document position - template
position; votes are summed by (document, template, diagonal) before the shuffle. Neighbouring diagonals of
a long template, which words put in or left out cause, are merged. Votes for passages only propose spans, by
one gram of two words: of SHARE of a passage's words, two at least are left side by side however the changed
ones are scattered. The spans are then verified word by word in the texts; only texts that hold a gram of a
template go through that shuffle. So that common pairs of words do not count, passages' grams are looked for
only where a window of WIDTH holds enough words of one passage, or where RARE_K words of one stand together.

Arrow workers take a batch of texts by chunks and send each chunk's rows before the next (and at most HELD spans at
a time), so that beside the batch itself they hold what a chunk needs, however many words a batch has.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbolex.llm import textarrays
from arbolex.llm.common import KEY, refuse_clashes, row_key, stored

# Phrases and passages of well-known licences.
#: Base phrases; each place counts.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: More phrases that must stand word for word.
PHRASES = {
    "all rights reserved": "proprietary",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "bsd license": "bsd",
    "public domain": "public-domain",
}
#: Passages that may differ in some words.
PASSAGES = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "apache": ["you may not use this file except in compliance with the license you may obtain a copy of the license at", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license", "you are free to share copy and redistribute the material in any medium or format and adapt remix transform and build upon the material"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"],
}
#: (words, label, base, exact)
TEMPLATES = [(p.split(), label, True, True) for p, label in BASE.items()] + [(p.split(), label, False, True) for p, label in PHRASES.items() if len(p.split()) > 1] + [(p.split(), label, False, False) for label, ps in PASSAGES.items() for p in ps]
#: Words of a gram for exact phrases and for passages, and of one that is rare; how far merged diagonals may lie apart; share of a passage's words that must be found.
PHRASE_K, PASSAGE_K, RARE_K, APART, SHARE = 2, 2, 4, 8, 0.7
#: Of a passage's words: how many texts' words it may lie among, as a factor.
WIDTH = 1.5
#: Spans that a worker holds before it sends their rows.
HELD = 10_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _limits(template: int) -> tuple[int, int]:
    """Least number of a passage's words, and the width of the window that they stand in."""
    n = len(TEMPLATES[template][0])
    return next(m for m in range(n + 1) if m / n >= SHARE), int(WIDTH * n)


@functools.cache
def _passages() -> tuple[np.ndarray, list[tuple[np.ndarray, int, int]], np.ndarray]:
    """Hashes of the passages' words in order; by passage which of them it has, and its limits; hashes of RARE_K words."""
    hashes = []
    for words, _, _, exact in TEMPLATES:
        data, bounds = np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))])
        starts, ends, _ = textarrays.word_spans(data, bounds, textarrays.NOT_ALNUM)
        hashes.append(np.zeros(0, np.uint64) if exact else textarrays.span_hashes(data, starts, ends))
    known = np.unique(np.concatenate(hashes))
    each = [(np.append(np.isin(known, h), False), *_limits(i)) for i, h in enumerate(hashes) if len(h)]
    return known, each, np.unique(np.concatenate([textarrays.shingles(h, np.array([0, len(h)]), RARE_K)[0] for h in hashes if len(h)]))


def _plausible(words: np.ndarray) -> np.ndarray:
    """Whether words lie where a passage may be; all where one is."""
    known, each, rare = _passages()
    n = len(words)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    at[known[at] != words] = len(known)
    change = np.zeros(n + 1, np.int32)
    for has, need, width in each:
        sums = np.concatenate([[0], np.cumsum(has[at], dtype=np.int32)])
        first = np.flatnonzero(sums[np.minimum(np.arange(n) + width, n)] - sums[:-1] >= need)
        np.add.at(change, first, 1)
        np.add.at(change, np.minimum(first + width, n), -1)
    if n >= RARE_K:
        first = np.flatnonzero(np.isin(textarrays.shingles(words, np.array([0, n]), RARE_K)[0], rare))
        np.add.at(change, first, 1)
        np.add.at(change, first + RARE_K, -1)
    return np.cumsum(change[:-1]) > 0


def _grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """By chunks: the first row, words' bounds by row, and for PHRASE_K and PASSAGE_K the hashes at the first word of each gram."""
    for first, bounds, data in textarrays.chunks(texts):
        data = textarrays.lowered(data)
        starts, ends, rows = textarrays.word_spans(data, bounds, textarrays.NOT_ALNUM)
        words = textarrays.span_hashes(data, starts, ends)
        n = len(words)
        out = []
        for j, k in enumerate((PHRASE_K, PASSAGE_K)):
            grams, _ = textarrays.shingles(words, np.array([0, n]), k) if n >= k else (np.zeros(0, np.uint64), None)
            whole = np.searchsorted(rows, np.arange(len(grams)), "right") == np.searchsorted(rows, np.arange(len(grams)) + k - 1, "right")
            at = np.flatnonzero(whole & _plausible(words)[: len(grams)] if j else whole)
            out.append((at, textarrays.mix(grams[at] ^ np.uint64(2 * k + j))))
        yield first, rows, out


def _template_grams() -> list[tuple[int, int, int]]:
    """(hash, template, position)"""
    out = []
    for i, (words, _, _, exact) in enumerate(TEMPLATES):
        (_, grams), = [(r, g) for _, r, g in _grams(pa.array([" ".join(words)]))]
        at, hashes = grams[0 if exact else 1]
        out += [(int(h), i, int(p)) for p, h in zip(at, hashes.view(np.int64), strict=True)]
    return out


_ROLLING = "__k1 long, __k2 long, grams array<struct<place:int,h:long>>"


def _rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its grams: place of the first word, and hash; those of phrases and of passages have different hashes."""
    for batch in batches:
        for first, rows, grams in _grams(batch.column("text")):
            part = batch.slice(first, len(rows) - 1)
            row = np.concatenate([np.searchsorted(rows, at, "right") - 1 for at, _ in grams])
            place = np.concatenate([at for at, _ in grams]) - rows[row]
            hashes = np.concatenate([h for _, h in grams])
            order = np.argsort(row, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(place[order].astype(np.int32)), pa.array(hashes[order].view(np.int64))], ["place", "h"])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), pa.ListArray.from_arrays(pa.array(offsets), each)], [*KEY, "grams"])


def spans(docs: DataFrame) -> DataFrame:
    """__k1, __k2, spans array<struct<template, start, end, votes>>: the candidates that voting proposes."""
    spark = docs.sparkSession
    h, template, at = zip(*_template_grams(), strict=True)  # from Arrow: no Python workers of their own, which would stay
    grams = spark.createDataFrame(pa.table({"h": pa.array(h, pa.int64()), "template": pa.array(template, pa.int32()), "at": pa.array(at, pa.int32())}))
    sizes = spark.createDataFrame(pa.table({"template": pa.array(range(len(TEMPLATES)), pa.int32()), "size": pa.array([len(t[0]) for t in TEMPLATES], pa.int32()), "exact": [t[3] for t in TEMPLATES]}))
    each = docs.select(*row_key("doc_id", "text"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_rolling, _ROLLING)
    votes = each.select(*KEY, F.explode("grams").alias("g")).select(*KEY, "g.*").join(F.broadcast(grams), "h")
    votes = votes.groupBy(*KEY, "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count_distinct("at").alias("votes"), F.min("place").alias("start"), F.max("place").alias("end"))
    votes = stored(votes, "votes").join(F.broadcast(sizes), "template")  # read twice below; texts are hashed once
    exact = votes.where("exact AND votes = size - 1").select(*KEY, "template", "start", (F.col("start") + F.col("size")).alias("end"), "votes")
    loose = votes.where("NOT exact")
    order = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > APART) | F.lag("diagonal").over(order).isNull()
    loose = loose.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    loose = loose.groupBy(*KEY, "template", "run").agg(F.min("start").alias("start"), (F.max("end") + PASSAGE_K).alias("end"), F.sum("votes").alias("votes"))
    loose = loose.select(*KEY, "template", "start", "end", "votes")
    return exact.unionByName(loose).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("template", "start", "end", "votes"))).alias("spans"))


def _suspects(hashes: np.ndarray):
    """Documents' number of words, and the text of those that hold a gram of a template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, grams in _grams(batch.column("text")):
                part = batch.slice(first, len(rows) - 1)
                some = np.zeros(len(part), bool)
                for at, h in grams:
                    some[np.searchsorted(rows, at[np.isin(h, hashes)], "right") - 1] = True
                texts = part.column("text").take(pa.array(np.arange(len(part)), mask=~some))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*KEY, "doc_id")), pa.array(np.diff(rows).astype(np.int64)), texts.cast(pa.string())], [*KEY, "doc_id", "n_words", "text"])

    return run


@functools.cache
def _marks(template: int) -> dict[str, int]:
    """Of each word of a template its places, as bits."""
    out: dict[str, int] = {}
    for i, w in enumerate(TEMPLATES[template][0]):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _common(words: list[str], template: int) -> list[int]:
    """How many of the template's words stand in order in words[: i + 1], for each i: longest common subsequences."""
    marks, n = _marks(template), len(TEMPLATES[template][0])
    v = full = (1 << n) - 1
    out, count = [], 0
    for w in words:
        if u := v & marks.get(w, 0):
            v = ((v + u) | (v - u)) & full
            count = n - v.bit_count()
        out.append(count)
    return out


def copies(words: list[str], template: int, a: int, b: int) -> list[tuple[int, int, float]]:
    """The copies of a passage in words[a:b], one after the other: first word, end, and the share of its words that
    stand there in order, in a window of WIDTH.

    The next copy holds the shortest of the windows with SHARE of the words that end first. It goes as far beyond as
    words of the passage outnumber others."""
    need, width = _limits(template)
    marks, n, out = _marks(template), len(TEMPLATES[template][0]), []
    sums = list(itertools.accumulate((w in marks for w in words[a:b]), initial=0))
    starts = [s for s in range(a, b) if words[s] in marks and sums[min(s + width, b) - a] - sums[s - a] >= need]
    while starts:
        core = None
        for s in starts:
            if core and s + need > core[0]:
                break
            common = _common(words[s : min(s + width, b)], template)
            if common[-1] >= need:
                e = s + bisect.bisect_left(common, need) + 1
                core = (e, s) if core is None or e <= core[0] else core
        if core is None:
            break
        e, s = core
        best = None
        for t in range(max(a, e - width), s + 1):
            if words[t] in marks:
                common = _common(words[t : min(t + width, b)], template)
                for i in range(e - t - 1, len(common)):
                    rank = (2 * common[i] - (i + 1), common[i], t)
                    best = max(best, (rank, t + i + 1)) if best else (rank, t + i + 1)
        (_, found, t), end = best
        out.append((t, end, found / n))
        a = end
        starts = [s for s in starts if s >= end]
    return out


def verify(words: list[str], template: int, start: int, end: int) -> tuple[int, int, float] | None:
    """The span (first word, end) and the share of the template's words that stand there in order; None if too few."""
    wanted, _, _, exact = TEMPLATES[template]
    if exact:
        return (start, start + len(wanted), 1.0) if words[start : start + len(wanted)] == wanted else None
    a, b = max(0, start - APART), min(len(words), end + APART)
    if _common(words[a:b], template)[-1] < SHARE * len(wanted):
        return None
    blocks = [x for x in difflib.SequenceMatcher(None, words[a:b], wanted, autojunk=False).get_matching_blocks() if x.size]
    share = sum(x.size for x in blocks) / len(wanted)
    return (a + blocks[0].a, a + blocks[-1].a + blocks[-1].size, share) if share >= SHARE else None


def found_in(words: list[str], spans: list[dict]) -> list[tuple[int, int, int, float]]:
    """(start, end, template, share) of what stands in the spans. Copies of a passage are looked for in spans with a
    window before and behind; of wider ones, where words were put in, in what voting has merged."""
    out, regions = set(), {}
    for s in spans:
        if TEMPLATES[s["template"]][3]:
            if got := verify(words, s["template"], s["start"], s["end"]):
                out.add((got[0], got[1], s["template"], got[2]))
        else:
            regions.setdefault(s["template"], []).append((s["start"], s["end"]))
    for i, places in regions.items():
        _, width = _limits(i)
        merged: list[list[int]] = []
        for start, end in sorted(places):
            a, b = max(0, start - width), min(len(words), end + width)
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        narrow = [x for a, b in merged for x in copies(words, i, a, b)]
        wide = [got for start, end in places if (got := verify(words, i, start, end))]
        out |= {(a, b, i, share) for a, b, share in narrow}
        out |= {(a, b, i, share) for a, b, share in wide if all(y <= a or b <= x for x, y, _ in narrow)}
    return sorted(out)


_FOUND = "array<struct<label:string,start:int,end:int,base:boolean,score:double>>"
_FOUND_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, held, out = 0, 0, []
        for i, (text, some) in enumerate(zip(batch.column("text"), batch.column("spans"), strict=True)):
            found = []
            for start, end, template, share in found_in(_WORD.findall(text.as_py().translate(_FOLD)), some.as_py()) if some.is_valid else ():
                _, label, base, _ = TEMPLATES[template]
                found.append({"label": label, "start": start, "end": end, "base": base, "score": share})
            out.append(sorted(found, key=lambda x: (x["start"], x["end"], x["label"])))
            held += len(found)
            if held >= HELD or i == len(batch) - 1:
                part = batch.slice(first, len(out))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), pa.array(out, _FOUND_ARROW)], ["doc_id", "n_words", "found"])
                first, held, out = i + 1, 0, []


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words long, found array<struct<label, start, end (words from 0), base, score>>: one row for each row of docs.

    Words: A-Z lower-cased, then runs of 0-9, a-z and characters beyond ASCII. Phrases must stand word for
    word, and each place counts; passages need SHARE of their words in order in a window of WIDTH, two of them side
    by side; score says how many. Of passages with more words put in, APART at a place, only those are found of
    which most words stand in long runs.

    Null or empty text: no words, nothing found. Null and repeated doc_ids, and rows that repeat: each row
    by itself. Empty table: no rows. Other columns are left out. Very long texts are whole.
    """
    refuse_clashes(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashes = np.array([h for h, _, _ in _template_grams()], np.int64).view(np.uint64)
    each = docs.select(*row_key("doc_id", "text"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_suspects(hashes), "__k1 long, __k2 long, doc_id long, n_words long, text string")
    found = each.join(spans(docs), KEY, "left").select("doc_id", "n_words", "text", "spans")
    return found.mapInArrow(_verified, f"doc_id long, n_words long, found {_FOUND}")
