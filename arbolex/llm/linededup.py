"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the
threshold, reassemble by position. DataFrame functions only.

Skew: a line that a third of all documents share is counted by partial aggregates before any shuffle.
Common lines with over 1 / HOT of all common lines' rows are fewer than HOT, so they are broadcast and
marked where they are read; on the way through the join of the others such rows are dealt out by their
document. Nothing is collected, and no group of rows is gathered but the dropped positions of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.llm.common import KEY, lower_ascii, of_row, refuse_clashes, row_key, row_name, stored, whole_row

#: Bound of the number of lines that are broadcast.
HOT = 2_000
#: White space that is stripped from a line for its key.
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.trim(lower_ascii(line), F.lit(SPACE))


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Columns of docs, then kept_text string, n_lines int (before), n_dropped int.

    A line's key is the line, stripped and with A-Z lower-cased. Keys of at least min_chars code points
    in at least min_docs different doc_ids lose all their lines but those in the smallest doc_id.

    Null or empty text: one empty line, kept. Null doc_ids count together as one document, larger than
    all others. Rows repeated with one doc_id are one document, and each keeps the same lines. A text
    whose every line goes becomes empty. Empty table: no rows. Other columns pass through untouched;
    one named as a result is replaced. Very long texts: their lines are rows.
    """
    refuse_clashes(docs, "doc_id", "text")
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"), *row_key("doc_id", "text"))
    lines = texts.select("doc_id", *KEY, F.posexplode(F.split("__text", "\n")).alias("__pos", "__line"))
    lines = lines.withColumn("__line", line_key(F.col("__line"))).where(F.length("__line") >= min_chars)
    lines = lines.select("doc_id", *KEY, "__pos", F.xxhash64("__line").alias("__h1"), F.xxhash64(F.lit(1), "__line").alias("__h2"))
    if min_docs == 2:  # two documents have the line iff its smallest and largest ids differ: one aggregate
        common = lines.groupBy("__h1", "__h2").agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last"), F.max(F.isnull("doc_id")).alias("__null"), F.count("*").alias("__rows"))
        common = common.where((F.col("__first") < F.col("__last")) | (F.col("__null") & F.col("__first").isNotNull()))
    else:
        common = lines.groupBy("__h1", "__h2", "doc_id").agg(F.count("*").alias("__n")).groupBy("__h1", "__h2")
        common = common.agg(F.count("*").alias("__docs"), F.min("doc_id").alias("__first"), F.sum("__n").alias("__rows")).where(F.col("__docs") >= min_docs)
    common = stored(common.select("__h1", "__h2", "__first", "__rows"), "common-lines")
    often = F.col("__rows") * HOT > common.agg(F.sum("__rows")).scalar()
    hot = common.where(often).select("__h1", "__h2", F.col("__first").alias("__least"), F.lit(True).alias("__hot"))  # under HOT rows
    marked = lines.join(F.broadcast(hot), ["__h1", "__h2"], "left")
    marked = marked.select("doc_id", *KEY, "__pos", "__least", "__hot", F.when(F.col("__hot"), F.col("__k1")).otherwise(F.col("__h1")).alias("__a"), F.when(F.col("__hot"), F.col("__k2")).otherwise(F.col("__h2")).alias("__b"))
    rest = common.where(~often).select(F.col("__h1").alias("__a"), F.col("__h2").alias("__b"), F.col("__first"), F.lit(True).alias("__cold"))
    drops = marked.join(rest, ["__a", "__b"], "left").where(F.col("__hot") | F.col("__cold"))
    drops = drops.where(~F.col("doc_id").eqNullSafe(F.when(F.col("__hot"), F.col("__least")).otherwise(F.col("__first"))))
    drops = drops.groupBy(*KEY).agg(F.collect_set("__pos").alias("__drops"))
    out = docs.select(whole_row(docs), *row_key("doc_id", "text")).join(drops, KEY, "left")
    text = F.coalesce(F.col(row_name(docs))["text"], F.lit(""))
    all_lines = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__drops")), lambda i: F.get(all_lines, i))
    return out.select(
        *of_row(docs),
        F.when(F.col("__drops").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size(all_lines).alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).alias("n_dropped"),
    )
