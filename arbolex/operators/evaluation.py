"""Evaluation of similarities (word1, word2, sim, usim) and diagnostics of vector spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbolex.functions import vectors as V

LIMIT, STEP = 3.0, 0.03


def deduplicated(test: DataFrame) -> DataFrame:
    """One row for each (word1, word2): the last by line."""
    return test.groupBy("word1", "word2").agg(F.max_by("sim", "line").alias("sim"))


def pearson(rows: DataFrame) -> DataFrame:
    return rows.agg(F.corr(F.col("sim").cast("double"), F.col("usim").cast("double")).alias("value"))


def spearman(rows: DataFrame) -> DataFrame:
    """Ranks are of distinct values, which are few and counted before they are ordered."""
    for c in ("sim", "usim"):
        counts = rows.groupBy(c).agg(F.count("*").alias("__n"))
        above = F.coalesce(F.sum("__n").over(Window.orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = counts.select(c, (above + (F.col("__n") + 1) / 2.0).alias(f"__{c}"))
        rows = rows.join(ranks, c)
    return rows.agg(F.corr("__sim", "__usim").alias("value"))


def _curve(rows: DataFrame) -> DataFrame:
    """By falling usim, a row for each value: recall and precision so far."""
    groups = rows.groupBy("usim").agg(F.count("*").alias("n"), F.sum((F.col("sim") == 1).cast("long")).alias("good"))
    so_far = Window.orderBy(F.desc("usim")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = rows.agg(F.sum((F.col("sim") == 1).cast("long"))).scalar()
    curve = groups.select("usim", F.sum("n").over(so_far).alias("n"), F.sum("good").over(so_far).alias("good"))
    return curve.select("usim", (F.col("good") / total).alias("recall"), (F.col("good") / F.col("n")).alias("precision"))


def average_precision(rows: DataFrame, trapezoid: bool = False) -> DataFrame:
    """Area under precision over recall: by steps, or by trapezoids that begin at precision 1."""
    order = Window.orderBy(F.desc("usim"))
    height = (F.coalesce(F.lag("precision").over(order), F.lit(1.0)) + F.col("precision")) / 2 if trapezoid else F.col("precision")
    area = (F.col("recall") - F.coalesce(F.lag("recall").over(order), F.lit(0.0))) * height
    return _curve(rows).select(area.alias("__a")).agg(F.sum("__a").alias("value"))


def predicted(rows: DataFrame) -> DataFrame:
    """Adds predict: 1 for the better half of each word1, rounded down; ties by word2."""
    first = Window.partitionBy("word1")
    place = F.row_number().over(first.orderBy(F.desc("usim"), "word2"))
    return rows.withColumn("predict", (place <= F.floor(F.count("*").over(first) / 2)).cast("int"))


def accuracy(rows: DataFrame) -> DataFrame:
    return predicted(rows).agg(F.avg((F.col("sim") == F.col("predict")).cast("double")).alias("value"))


def known_only(rows: DataFrame, model: DataFrame) -> DataFrame:
    """usim = sim where the model knows both words, else 0: what a perfect model of this vocabulary could reach."""
    for w in ("word1", "word2"):
        rows = rows.join(model.select(F.col("word").alias(w), F.lit(True).alias(f"__{w}")), w, "left")
    both = F.col("__word1").isNotNull() & F.col("__word2").isNotNull()
    return rows.withColumn("usim", F.when(both, F.col("sim").cast("double")).otherwise(0.0)).drop("__word1", "__word2")


def suite(test: DataFrame, model: DataFrame, sizes: tuple[int, int, int], a_ratio: float = 1.0, kind: str = "binary") -> dict[str, float]:
    """Scores of one test set: Spearman for graded sets, average precision and accuracy for binary ones;
    and the same with limit_, for the vocabulary's coverage."""
    from arbolex.operators.similarity import pairs

    rows = pairs(test, model, sizes, a_ratio).withColumnRenamed("all", "usim")
    scores = {"": rows, "limit_": known_only(test, model)}
    out = {}
    for name, r in scores.items():
        metrics = {"spearman": spearman} if kind == "graded" else {"average_precision": average_precision, "average_precision_trapezoid": lambda x: average_precision(x, True), "accuracy": accuracy}
        out |= {f"{name}{m}": f(r).first()[0] for m, f in metrics.items()}
    return out


def _values(model: DataFrame) -> DataFrame:
    return model.select("word", F.posexplode("vec").alias("dim", "x"))


def extremes(model: DataFrame, count: int = 5) -> DataFrame:
    """kind (min or max), value, word, dim: the count least and greatest values, each value once (its least word and dimension)."""
    values = _values(model).groupBy("x").agg(F.min(F.struct("word", "dim")).alias("at"))
    take = lambda kind, order: values.orderBy(order).limit(count).select(F.lit(kind).alias("kind"), F.col("x").cast("double").alias("value"), "at.word", "at.dim")
    return take("min", F.asc("x")).union(take("max", F.desc("x")))


def zero_shift(model: DataFrame, count: int = 5) -> DataFrame:
    """dim, shift: the dimensions whose mean is farthest from zero."""
    means = _values(model).groupBy("dim").agg(F.abs(F.avg(F.col("x").cast("double"))).alias("shift"))
    return means.orderBy(F.desc("shift"), "dim").limit(count)


def histogram(model: DataFrame, dim: int, step: float = STEP, limit: float = LIMIT) -> DataFrame:
    """bin, n: values of one dimension by bin, bin b holding ((b - 1) * step, b * step]; values beyond the
    limit in the last bins. Empty bins between the first and the last are left to the reader."""
    x = F.get("vec", dim).cast("double")
    return model.select(F.greatest(F.lit(-limit), F.least(F.lit(limit), x)).alias("x")).groupBy(F.ceil(F.col("x") / step).alias("bin")).agg(F.count("*").alias("n"))


def all_histograms(model: DataFrame, step: float = STEP, limit: float = LIMIT) -> DataFrame:
    """dim, bin, n: the bins of every dimension, as those of ``histogram``."""
    x = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("x").cast("double")))
    return _values(model).groupBy("dim", F.ceil(x / step).alias("bin")).agg(F.count("*").alias("n"))


def float_classes(model: DataFrame) -> DataFrame:
    """class, n: of all components."""
    return model.select(F.explode("vec").alias("x")).groupBy(V.float_class(F.col("x")).alias("class")).agg(F.count("*").alias("n"))


def predictions(test: DataFrame, model: DataFrame, sizes: tuple[int, int, int], a_ratio: float = 1.0) -> DataFrame:
    """word1, word2, sim, usim, predict: the rows that a binary set's scores are made of."""
    from arbolex.operators.similarity import pairs

    return predicted(pairs(test, model, sizes, a_ratio).withColumnRenamed("all", "usim")).select("word1", "word2", "sim", "usim", "predict")


def probe_report(rows: DataFrame) -> DataFrame:
    """list, mean, least and greatest similarity and the pairs they are of. rows: list, word1, word2, usim."""
    pair = F.concat_ws(" ", "word1", "word2")
    return rows.groupBy("list").agg(F.avg("usim").alias("mean"), F.min("usim").alias("least"), F.min_by(pair, F.struct("usim", pair)).alias("least_pair"), F.max("usim").alias("greatest"), F.max_by(pair, F.struct("usim", pair)).alias("greatest_pair"))
