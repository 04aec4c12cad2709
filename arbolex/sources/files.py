"""Text formats: vocabularies, stop lists, token-lemma maps, relation files and tables, test pairs, extracted pairs.

An unterminated last line counts as a line everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.operators.examples import bad_lines
from arbolex.operators.vocab import indexed, only, without


#: Bytes of files up to which ``spread`` deals rows out anew.
SPREAD = 256 << 20


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows read from fewer files than there are cores, dealt out to all cores by the hash of keys: one small file
    is often one row group, and so one task. Larger inputs, of which each file gives many tasks, stay as they are."""
    spark = rows.sparkSession
    cores, paths = spark.sparkContext.defaultParallelism, rows.inputFiles()
    if not paths or len(paths) >= cores:
        return rows
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    at = [hadoop(spark._jvm.java.net.URI(p)) for p in paths]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in at)
    return rows.repartition(cores, *keys) if size <= SPREAD else rows


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def _parts(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def read_vocab(spark: SparkSession, path: str, whitelist: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """idx, word, cn of lines ``word count``. A line of another form is an error."""
    rows = _lines(spark, path).select("value", _parts(F.col("value")).alias("p")).where("value <> ''")
    if not rows.where((F.size("p") != 2) | F.try_to_number(F.get("p", 1), F.lit("9" * 18)).isNull()).isEmpty():
        raise ValueError(f"not a vocabulary: {path}")
    rows = rows.select(F.get("p", 0).alias("word"), F.get("p", 1).cast("long").alias("cn"))
    if whitelist is not None:
        rows = only(rows, whitelist)
    if stop is not None:
        rows = without(rows, stop)
    return indexed(rows)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """By falling count, ties by word."""
    vocab.orderBy(F.desc("cn"), "word").select(F.concat_ws(" ", "word", "cn")).write.text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word: stop lists and word lists, all words of every line."""
    return _lines(spark, path).select(F.explode(_parts(F.col("value"))).alias("word")).where("word <> ''").distinct()


def read_token_lemmas(spark: SparkSession, path: str) -> DataFrame:
    """token, lemma, cnt of lines ``token lemma count ...``. Lines with an even number of parts or fewer
    than three are skipped, and tokens with a count that is no number."""
    rows = _lines(spark, path).select(F.split("value", " ").alias("p")).where((F.size("p") >= 3) & (F.size("p") % 2 == 1))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 2, F.lit(1)), F.lit(2)), lambda i: F.struct(F.get("p", i).alias("lemma"), F.get("p", i + 1).try_cast("long").alias("cnt")))
    rows = rows.select(F.get("p", 0).alias("token"), pairs.alias("x")).where(F.forall("x", lambda x: x["cnt"].isNotNull()))
    return rows.select("token", F.explode("x").alias("x")).select("token", "x.*").groupBy("token", "lemma").agg(F.max("cnt").alias("cnt"))


def write_token_lemmas(pairs: DataFrame, vocab: DataFrame, path: str) -> None:
    """One line for each token, in the vocabulary's order, its lemmas by name."""
    rows = pairs.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("lemma", "cnt"))).alias("x"))
    rows = rows.join(vocab.select(F.col("word").alias("token"), "cn"), "token").orderBy(F.desc("cn"), "token")
    rows.select(F.concat_ws(" ", "token", F.array_join(F.transform("x", lambda x: F.concat_ws(" ", x["lemma"], x["cnt"].cast("string"))), " "))).write.text(path)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """line, items of a relation vocabulary. Lines of fewer than two items, or with one twice, are errors."""
    rows = _lines(spark, path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("line"), _parts(F.col("value")).alias("items"))
    if not bad_lines(rows).isEmpty():
        raise ValueError(f"a line needs two items at least, all different: {path}")
    return rows


TABLE = (("first", "int"), ("last", "int"), ("begin", "double"), ("end", "double"), ("file", "string"), ("algo", "int"), ("every", "int"), ("pack", "int"), ("limit", "double"))


def read_relation_table(spark: SparkSession, path: str) -> DataFrame:
    """The columns of TABLE; begin and end as fractions. Comments and lines of another form are skipped."""
    rows = _lines(spark, path).where("trim(value) <> '' AND NOT value LIKE '#%'").select(_parts(F.col("value")).alias("p")).where(F.size("p") == len(TABLE))
    rows = rows.select(*[F.get("p", i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(TABLE)]).dropna()
    return rows.withColumns({c: F.col(c) / 100 for c in ("begin", "end")})


def read_test(spark: SparkSession, path: str, yo: bool = False) -> DataFrame:
    """word1, word2, sim of a CSV file with a header; of repeated pairs the last. yo: ё becomes е."""
    rows = spark.read.csv(path, header=True).toDF("word1", "word2", "sim").withColumn("line", F.monotonically_increasing_id())
    if yo:
        rows = rows.withColumns({w: F.translate(w, "ё", "е") for w in ("word1", "word2")})
    from arbolex.operators.evaluation import deduplicated

    return deduplicated(rows.where("word2 IS NOT NULL AND sim IS NOT NULL").withColumn("sim", F.col("sim").cast("double")))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """word1, word2 of lines with exactly two commas."""
    rows = _lines(spark, path).select(F.split("value", ",").alias("p")).where(F.size("p") == 3)
    return rows.select(F.get("p", 0).alias("word1"), F.get("p", 1).alias("word2"))


def read_extracted(spark: SparkSession, path: str, suffix: str = "dep") -> DataFrame:
    """w1, w2, score of all files below a folder that have the suffix, or lie in a folder that has it (as
    ``write_extracted`` makes them); rows of another form are skipped. Other files are not read."""
    text = spark.read.option("recursiveFileLookup", True).text(path).where(F.col("_metadata.file_path").rlike(rf"\.{suffix}(/part-[^/]*)?$"))
    rows = text.select(F.split("value", " ").alias("p")).where(F.size("p") == 3)
    return rows.select(F.get("p", 0).alias("w1"), F.get("p", 1).alias("w2"), F.get("p", 2).try_cast("double").alias("score")).dropna()


def write_extracted(rows: DataFrame, path: str) -> None:
    rows.orderBy("w1", F.desc("score"), "w2").select(F.concat_ws(" ", "w1", "w2", F.format_string("%.6f", "score"))).write.text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """The one column's values as lines of one file, in the rows' order."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    part: list[str] = []
    try:
        for row in rows.toLocalIterator(prefetchPartitions=True):
            part.append(row[0] + "\n")
            if len(part) == 10_000:
                out.write("".join(part).encode())
                part = []
        out.write("".join(part).encode())
    finally:
        out.close()
