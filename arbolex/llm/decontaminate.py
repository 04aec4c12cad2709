"""Benchmark decontamination: a broadcast hash set of normalised test n-grams; training windows are
scanned against it, hits are verified word by word, and spans or whole documents removed. DataFrame
functions only.

The scan probes few positions and still loses none: any occurrence of a window of L words covers a
position divisible by s = L // 2 (at least 1), with L - s + 1 words from there on inside it, so it is
enough to hash that many words at every s-th position and to have all such sub-grams of the windows in
the hash set. Documents with a hit are then compared window by window, as text, in a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.llm.common import KEY, lower_ascii, of_row, refuse_clashes, row_key, row_name, whole_row, words

#: Rows of the hash set up to which it is broadcast (8 bytes each and the table's overhead: under 100 MB);
#: a larger one is joined by a shuffle.
MAX_BROADCAST = 2_000_000


def _probe(size: int) -> tuple[int, int]:
    """At which steps windows of size words are probed, and how many words a probe takes."""
    step = max(1, size // 2)
    return step, size - step + 1


def _grams(w: str, sizes: list[int]) -> Column:
    """(pos, size, gram) of every window, for all sizes at once."""

    def of(size: int) -> Column:
        last = F.size(w) - size
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), F.array_join(F.slice(w, i + 1, F.lit(size)), " ").alias("gram")))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<pos:int,size:int,gram:string>>"))

    return F.concat(*map(of, sizes))


def _hashes(w: str, probes: list[tuple[int, int]]) -> Column:
    """Hashes of each probe's number of words at its steps, for all probes at once."""

    def of(step: int, part: int) -> Column:
        last = F.size(w) - part
        each = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(part))))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*(of(*p) for p in probes))


def windows(items: DataFrame, n: int) -> DataFrame:
    """item_id, size int, gram string: every window of n words; a shorter item, unless empty, is one window."""
    w = items.select("item_id", words(lower_ascii(F.col("text"))).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.size("w"), F.lit(n)))
    w = w.select("item_id", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("gram"))
    return w.distinct()


def hits(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """__k1, __k2 (the document's row_key), hit array<int> (word positions), item_ids array (sorted as
    strings): one row for each document in which a window of an item occurs."""
    grams = windows(items, n)
    sizes = {r["size"]: r["n"] for r in grams.groupBy("size").agg(F.count("*").alias("n")).collect()}  # n rows at most
    small = sum(sizes.values()) * n <= MAX_BROADCAST
    hint = F.broadcast if small else (lambda df: df)
    base = docs.select(*row_key("doc_id", "text"), words(lower_ascii(F.col("text"))).alias("w"))
    if not sizes:
        return docs.select(*row_key("doc_id", "text"), F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("item_ids")).where(F.lit(False))
    # one pass for all sizes of window
    keys = grams.select(F.explode(_hashes_of_gram(sorted(sizes))).alias("__h")).distinct()
    found = base.select(*KEY, F.explode(_hashes("w", sorted({_probe(s) for s in sizes}))).alias("__h")).join(hint(keys), "__h", "left_semi").select(*KEY)
    # texts are shuffled, which are smaller than arrays of words; their words are cut again afterwards
    suspects = docs.select(*row_key("doc_id", "text"), "text").join(found.distinct(), KEY, "left_semi").select(*KEY, words(lower_ascii(F.col("text"))).alias("w"))
    exact = suspects.select(*KEY, F.explode(_grams("w", sorted(sizes))).alias("g")).select(*KEY, "g.*").join(hint(grams), ["size", "gram"])
    exact = exact.groupBy(*KEY).agg(F.collect_set(F.struct("pos", "size")).alias("at"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    cover = F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["size"] - 1)))
    return exact.select(*KEY, F.array_distinct(cover).alias("hit"), "item_ids")


def _hashes_of_gram(sizes: list[int]) -> Column:
    """Of a window all hashes that a probe inside it may have."""
    w = F.split("gram", " ")
    part = F.element_at(F.create_map(*[F.lit(x) for s in sizes for x in (s, _probe(s)[1])]), F.col("size"))
    return F.transform(F.sequence(F.lit(1), F.size(w) - part + 1), lambda i: F.xxhash64(F.slice(w, i, part)))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "none") -> DataFrame:
    """Columns of docs, then n_words int, n_hit int, item_ids array<string>, contaminated boolean.

    remove="none" marks alone; "documents" leaves out contaminated documents; "spans" takes the hit words
    (with what stands before each, back to the word before) out of their texts.

    Null or empty text: no words, not contaminated. Null item text: no windows. Rows that repeat, and
    null or repeated doc_ids: each row has its own result. Null item_id: it hits, but has no id to list.
    Empty tables: no rows, or none contaminated. Very long texts are whole. Other columns pass through;
    one named as a result is replaced.
    """
    refuse_clashes(docs, "doc_id", "text")
    if remove not in ("none", "documents", "spans"):
        raise ValueError(remove)
    docs = docs.drop("n_words", "n_hit", "item_ids", "contaminated")
    found = hits(docs, items, n).withColumnRenamed("hit", "__hit")
    # words are counted before the join, so that texts nobody selects need not go through it
    out = docs.select(whole_row(docs), *row_key("doc_id", "text"), F.size(words(lower_ascii(F.col("text")))).alias("n_words")).join(found, KEY, "left")
    text = F.col(row_name(docs))["text"]
    if remove == "spans":
        whole = F.coalesce(text, F.lit(""))
        own = F.array_remove(F.split(whole, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
        between = F.split(whole, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__hit"))
        text = F.when(F.col("__hit").isNull(), text).otherwise(F.concat(F.array_join(F.transform(left, lambda i: F.concat(F.get(between, i), F.get(own, i))), ""), F.element_at(between, -1)))
    hit = F.col("__hit").isNotNull()
    if remove == "documents":
        out = out.where(~hit)
    return out.select(
        *[text.alias(c) if c == "text" else x for c, x in zip(docs.columns, of_row(docs), strict=True)],
        "n_words",
        F.coalesce(F.size("__hit"), F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        hit.alias("contaminated"),
    )
