"""Frequency vocabularies of lemmas, tokens, suffixes and syntactic contexts.

Counting is explode and a hash aggregate with map-side partial sums, so frequent words are small before
the shuffle. A token's parent is looked up inside its sentence's array: no self-join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolex.functions.text import SUFFIX_MARK, is_number, oov_suffixes, suffixes

PUNC, NONE, STUB = "PUNC", "_", "STUB"


def tokens(sentences: DataFrame) -> DataFrame:
    """sent_id, pos (from 1), and the fields of each token. Rows that are tokens already, as those of views.flat, stay."""
    if "toks" not in sentences.columns:
        return sentences
    return sentences.select("sent_id", F.posexplode("toks").alias("__i", "t")).select("sent_id", (F.col("__i") + 1).alias("pos"), "t.*")


def _worded(sentences: DataFrame) -> DataFrame:
    """form, lemma, n of the tokens that are words. Rows may be sentences, tokens, or tokens counted before (n)."""
    rows = sentences.select(F.explode("toks").alias("t")).select("t.form", "t.lemma", "t.deprel") if "toks" in sentences.columns else sentences
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    return rows.where((F.col("deprel") != PUNC) & (F.col("lemma") != NONE)).select("form", "lemma", n.alias("n"))


def lemma_counts(sentences: DataFrame) -> DataFrame:
    """word, cn: lemmas but those of punctuation and missing ones."""
    return _worded(sentences).groupBy(F.col("lemma").alias("word")).agg(F.sum("n").alias("cn"))


def token_lemma_counts(sentences: DataFrame) -> DataFrame:
    """token, lemma, cnt."""
    return _worded(sentences).where(F.col("form") != NONE).groupBy(F.col("form").alias("token"), "lemma").agg(F.sum("n").alias("cnt"))


def token_counts(pairs: DataFrame) -> DataFrame:
    """word, cn, rolled up from token_lemma_counts."""
    return pairs.groupBy(F.col("token").alias("word")).agg(F.sum("cnt").alias("cn"))


def suffix_counts(sentences: DataFrame, longest: int = 5) -> DataFrame:
    """word (a marked suffix), cn: suffixes of forms whose lemma is no number."""
    rows = _worded(sentences).where((F.col("form") != NONE) & ~is_number(F.col("lemma"))).groupBy("form").agg(F.sum("n").alias("n"))  # each form's suffixes are cut once
    return rows.select("n", F.explode(oov_suffixes(F.col("form"), longest)).alias("word")).groupBy("word").agg(F.sum("n").alias("cn"))


def arcs(sentences: DataFrame, column: str = "lemma") -> DataFrame:
    """sent_id, pos, word (the token's value in column), deprel, head, parent (the head's value in column), parent_deprel,
    parent_misc: each token with its head in the sentence; heads out of range give no row."""
    if "toks" in sentences.columns:
        rows = sentences.select("sent_id", "toks", F.posexplode("toks").alias("__i", "t"))
        head = F.when(F.col("t.head").rlike("^[0-9]{1,9}$"), F.col("t.head")).otherwise("0").cast("int")
        rows = rows.select("sent_id", (F.col("__i") + 1).alias("pos"), F.col(f"t.{column}").alias("word"), "t.deprel", head.alias("head"), F.get("toks", head - 1).alias("p"))
        return rows.where(F.col("p").isNotNull()).select("sent_id", "pos", "word", "deprel", "head", F.col(f"p.{column}").alias("parent"), F.col("p.deprel").alias("parent_deprel"), F.col("p.misc").alias("parent_misc"))
    rows = sentences.where(F.col("parent_deprel").isNotNull())
    return rows.select("sent_id", "pos", F.col(column).alias("word"), "deprel", "head", F.col(f"parent_{column}").alias("parent"), "parent_deprel", "parent_misc")


def context_counts(sentences: DataFrame, column: str = "lemma", use_deprel: bool = True) -> DataFrame:
    """word (a context), cn. With relations: child<relation, seen from the head, and head>relation, seen
    from the child; a stub gives no context of its own. Without: the column's values."""
    if not use_deprel:
        rows = tokens(sentences)
        n = F.col("n") if "n" in rows.columns else F.lit(1)
        return rows.where((F.col("deprel") != PUNC) & (F.col(column) != NONE)).groupBy(F.col(column).alias("word")).agg(F.sum(n).alias("cn"))
    stub = F.col("parent_misc") == STUB
    rows = arcs(sentences, column).where((F.col("deprel") != PUNC) & (F.col("word") != NONE) & (F.col("deprel") != NONE) & (F.col("parent_deprel") != PUNC) & ((F.col("parent") != NONE) | stub))
    # both views of an arc are counted at once, by value, mark and relation: as many groups as there are contexts, however many arcs
    child, head = (F.struct(F.col(v).alias("v"), F.lit(mark).alias("mark"), F.col("deprel").alias("r")) for v, mark in (("word", "<"), ("parent", ">")))
    seen = rows.select(F.explode(F.when(stub, F.array(head)).otherwise(F.array(child, head))).alias("x")).select("x.*")
    return seen.groupBy("v", "mark", "r").agg(F.count("*").alias("cn")).select(F.concat("v", "mark", "r").alias("word"), "cn")


def totals(sentences: DataFrame) -> DataFrame:
    """sentences, tokens: one row; sentences without tokens do not count."""
    rows = tokens(sentences).groupBy("sent_id").agg(F.count("*").alias("n")) if "toks" not in sentences.columns else sentences.select(F.size("toks").alias("n")).where("n > 0")
    return rows.agg(F.count("*").alias("sentences"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens"))


def at_least(vocab: DataFrame, count: int, exempt: DataFrame | None = None, exempt_count: int = 5) -> DataFrame:
    """Words of at least count; words of the exempt list from exempt_count on."""
    if exempt is None:
        return vocab.where(F.col("cn") >= count)
    listed = exempt.select("word").distinct().withColumn("__listed", F.lit(True))
    return vocab.join(listed, "word", "left").where((F.col("cn") >= count) | ((F.col("cn") >= exempt_count) & F.col("__listed"))).drop("__listed")


def without(vocab: DataFrame, words: DataFrame) -> DataFrame:
    return vocab.join(words.select("word").distinct(), "word", "left_anti")


def only(vocab: DataFrame, words: DataFrame) -> DataFrame:
    return vocab.join(words.select("word").distinct(), "word", "left_semi")


def frequent_suffixes(suffix_vocab: DataFrame, token_vocab: DataFrame, longest: int = 5, least: int = 50) -> DataFrame:
    """The suffixes in which at least so many different tokens end."""
    df = token_vocab.select(F.explode(suffixes(F.col("word"), longest)).alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return suffix_vocab.join(df.select(F.concat(F.lit(SUFFIX_MARK), "s").alias("word")), "word", "left_semi")


def indexed(vocab: DataFrame) -> DataFrame:
    """Adds idx: the place by falling count, words ascending among equals. A vocabulary that a threshold
    has reduced goes through one task here, as an index must; corpora do not."""
    return vocab.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("cn"), "word")) - 1)


def held(vocab: DataFrame) -> DataFrame:
    """A vocabulary that a threshold has reduced, made once: it goes through the driver, so that nothing that reads it
    goes through the corpus again."""
    return vocab.sparkSession.createDataFrame(vocab.toArrow(), vocab.schema)


def sampling_probability(cn: Column, all_cn: Column, threshold: float) -> Column:
    """min(1, r + sqrt(r)), r = total * threshold / count; 1 without a threshold."""
    if threshold <= 0:
        return F.lit(1.0)
    r = all_cn.cast("double") * F.lit(threshold) / cn
    return F.least(F.lit(1.0), r + F.sqrt(r))


def with_sampling(vocab: DataFrame, threshold: float) -> DataFrame:
    total = vocab.agg(F.sum("cn")).scalar()  # a scalar subquery: no join
    return vocab.withColumn("p", sampling_probability(F.col("cn"), total, threshold))


def noise_distribution(vocab: DataFrame, threshold: float) -> DataFrame:
    """word, share: of the draws for negative examples, in proportion to count times sampling probability."""
    weighted = with_sampling(vocab, threshold).withColumn("__w", F.col("cn") * F.col("p"))
    return weighted.select("word", (F.col("__w") / weighted.agg(F.sum("__w")).scalar()).alias("share"))


def subsampling_report(vocab: DataFrame, thresholds: list[float], percents: tuple[int, ...] = (1, 5, 10, 25, 50)) -> DataFrame:
    """threshold, percent, cn, p: at each percentile place of the vocabulary by falling count, the count
    there and the sampling probability at each threshold."""
    ranked = indexed(vocab)
    facts = vocab.agg(F.sum("cn").alias("total"), F.count("*").alias("n"))
    points = facts.select("total", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.floor(F.col("n") * p / 100).alias("idx")) for p in percents])).alias("x")).select("total", "x.*")
    rows = ranked.join(F.broadcast(points), "idx").select("percent", "cn", "total", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    r = F.col("total") * F.col("threshold") / F.col("cn")
    return rows.select("threshold", "percent", "cn", F.least(F.lit(1.0), r + F.sqrt(r)).alias("p"))


def build(sentences: DataFrame, min_main: int, min_tokens: int, min_context: int, longest: int = 5, stop: DataFrame | None = None, use_deprel: bool = True, least: int = 50) -> dict[str, DataFrame]:
    """All vocabularies at once: main, tokens, token_lemmas, suffixes, contexts."""
    pairs = token_lemma_counts(sentences)
    words = token_counts(pairs)
    words = at_least(without(words, stop) if stop is not None else words, min_tokens)
    return {
        "main": indexed(at_least(lemma_counts(sentences), min_main)),
        "tokens": indexed(words),
        "token_lemmas": pairs.join(words.select(F.col("word").alias("token")), "token", "left_semi"),
        "suffixes": indexed(frequent_suffixes(suffix_counts(sentences, longest), words, longest, least)),
        "contexts": indexed(at_least(context_counts(sentences, use_deprel=use_deprel), min_context)),
    }
