"""Command line: python -m arbolex TASK -name value ...

Unknown names are ignored; files are whatever paths Spark reads and writes (folders of text for
vocabularies and corpora, single files for models).
"""

from __future__ import annotations

import sys
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.operators import evaluation, examples, fit, models, mwe, similarity, training, vocab
from arbolex.sources import conll, files
from arbolex.sources import models as model_files

# Defaults of the parameters.
DEFAULTS = {
    "tl_map": "token2lemmas.map", "min-count_l": "50", "min-count_t": "50", "min-count_d": "50", "min-count_o": "10000", "exclude_nums": "0",
    "max_oov_sfx": "5", "col_ctx_d": "3", "use_deprel": "1", "size_d": "60", "size_a": "40", "size_g": "20", "negative_d": "5", "negative_a": "5", "alpha_d": "0.025",
    "alpha_a": "0.025", "alpha_g": "0.025", "inflection": "0.15", "iter": "5", "sample_w": "1e-4", "sample_d": "1e-4", "sample_a": "1e-5", "threads": "8", "a_ratio": "1.0",
    "g_ratio": "0.1", "st_yo": "0", "model_fmt": "bin", "mwe_collapse": "1", "fsim_fmt": "detail", "rr_min_sim": "0.6",
}
REPORT = [0.0, 1e-1, 1e-2, 5e-3, 1e-3, 5e-4, 1e-4, 5e-5, 1e-5, 5e-6, 1e-6, 1e-7, 1e-8, 1e-9]


class Parameters(dict):
    """Given values over defaults; ``given`` holds those that the user set."""

    def __init__(self, argv: list[str]):
        self.given = {argv[i].lstrip("-"): argv[i + 1] for i in range(0, len(argv) - 1) if argv[i].startswith("-") and not argv[i][1:2].isdigit()}
        super().__init__(DEFAULTS | self.given)

    def __missing__(self, name: str):
        raise SystemExit(f"-{name} must be given")

    def number(self, name: str) -> float:
        return float(self[name])

    def integer(self, name: str) -> int:
        return int(self[name])

    def flag(self, name: str) -> bool:
        return self[name] != "0"


def _model(spark: SparkSession, p: Parameters) -> tuple[model_files.Header, DataFrame]:
    return model_files.read_model(spark, p["model"])


def _phrases(spark: SparkSession, p: Parameters, words: DataFrame | None = None) -> list[mwe.Phrase]:
    if "vocab_e" not in p.given:
        return []
    found = mwe.parse_list([r["value"] for r in spark.read.text(p["vocab_e"]).collect()])  # a list of phrases, hundreds of lines
    return mwe.in_vocabulary(found, words) if words is not None else found


def task_fit(spark: SparkSession, p: Parameters) -> None:
    conll.write_conll(fit.fit(conll.read_conll(spark, p["fit_input"]), p.flag("exclude_nums")), p["train"])


def task_punct(spark: SparkSession, p: Parameters) -> None:
    head, m = _model(spark, p)
    _replace(spark, models.reindexed(models.with_punctuation(m)), p["model"], head.sizes)


def _replace(spark: SparkSession, m: DataFrame, path: str, sizes: tuple[int, int, int]) -> None:
    """Writes a model over the one it is made from: beside it first."""
    model_files.write_model(m, path + ".new", sizes)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(hadoop(path), False)
    system.rename(hadoop(path + ".new"), hadoop(path))


def task_vocab(spark: SparkSession, p: Parameters) -> None:
    sentences = conll.read_conll(spark, p["train"])
    phrases = _phrases(spark, p)
    safe = files.read_words(spark, p["ca_vocab"]) if "ca_vocab" in p.given else None
    main = vocab.at_least(vocab.lemma_counts(mwe.rewrite(sentences, phrases)), p.integer("min-count_l"), safe)
    files.write_vocab(main, p["vocab_l"])
    main = files.read_vocab(spark, p["vocab_l"])
    sentences = mwe.rewrite(sentences, mwe.in_vocabulary(phrases, main)) if phrases else sentences
    pairs = vocab.token_lemma_counts(sentences)
    words = vocab.token_counts(pairs)
    if "stop_t" in p.given:
        words = vocab.without(words, files.read_words(spark, p["stop_t"]))
    words = vocab.at_least(words, p.integer("min-count_t"))
    if "vocab_t" in p.given:
        files.write_vocab(words, p["vocab_t"])
        files.write_token_lemmas(pairs, words, p["tl_map"])
    if "vocab_o" in p.given:
        longest = p.integer("max_oov_sfx")
        found = vocab.at_least(vocab.suffix_counts(sentences, longest), p.integer("min-count_o"))
        files.write_vocab(vocab.frequent_suffixes(found, words, longest), p["vocab_o"])
    if "vocab_d" in p.given:
        column = conll.FIELDS[p.integer("col_ctx_d") - 1]
        files.write_vocab(vocab.at_least(vocab.context_counts(sentences, column, p.flag("use_deprel")), p.integer("min-count_d")), p["vocab_d"])


def _relations(spark: SparkSession, p: Parameters, words: DataFrame) -> list[training.Relation]:
    if "vocabs_tab" not in p.given:
        return []
    out = []
    for r in files.read_relation_table(spark, p["vocabs_tab"]).collect():  # a table of tens of rows
        pairs = examples.relation_pairs(files.read_relations(spark, r["file"]), {0: "first", 2: "weighted"}.get(r["algo"], "all"))
        found = examples.in_vocabulary(pairs, words).select("idx1", "idx2").toPandas().to_numpy(int)
        out.append(training.Relation(r["first"], r["last"], r["begin"], r["end"], r["algo"], r["every"], r["pack"], r["limit"], found))
    return out


def _settings(p: Parameters, relations: list[training.Relation], tokens: bool = False) -> training.Settings:
    return training.Settings(
        p.integer("size_d"), p.integer("size_a"), p.number("alpha_d"), p.number("alpha_a"), p.number("inflection"), p.integer("negative_d"), p.integer("negative_a"),
        p.integer("iter"), tokens=tokens, relations=relations,
    )


def _numbers(rows: DataFrame, column: str) -> np.ndarray:
    return rows.orderBy("idx").select(column).toPandas()[column].to_numpy()


def task_train(spark: SparkSession, p: Parameters, tokens: bool = False) -> None:
    column = "form" if tokens else "lemma"
    head, old = _model(spark, p) if tokens else (None, None)
    words = files.read_vocab(spark, p["vocab_t" if tokens else "vocab_l"], old)
    contexts = vocab.with_sampling(files.read_vocab(spark, p["vocab_d"]), p.number("sample_d"))
    stop = files.read_words(spark, p["stop_a"]) if "stop_a" in p.given else None
    phrases = [] if tokens else _phrases(spark, p, words)
    sentences = mwe.rewrite(conll.read_conll(spark, p["train"]), phrases)
    rows = examples.draws(sentences, words, contexts, stop, column, conll.FIELDS[p.integer("col_ctx_d") - 1], p.flag("use_deprel"), p.number("sample_w"), p.number("sample_a"))
    noise = vocab.noise_distribution(contexts.select("word", "cn"), p.number("sample_d")).join(contexts.select("word", "idx"), "word")
    names, seen = ([r["word"] for r in v.orderBy("idx").select("word").toLocalIterator()] for v in (words, contexts))
    shares, counts = _numbers(noise, "share"), _numbers(words, "cn")
    s = _settings(p, [] if tokens else _relations(spark, p, words), tokens)
    if tokens:  # the model's tokens against the contexts that its lemmas were trained with
        s.dep, s.assoc = head.dep, head.assoc
        start = training.start_from(words, old, training.restore_contexts(spark, seen, p["restore"]), counts, s)
    else:
        start = training.restore(spark, names, p["restore"]) if "restore" in p.given else None
    w = training.train(rows, counts, shares, len(shares), s, start)
    m = training.as_model(spark, words, w)
    if phrases and p.flag("mwe_collapse"):
        weights = models.collapse_weights(words.select("word", "cn"), mwe.transient_table(spark, phrases))
        m = models.reindexed(models.collapsed(m, weights))
    if tokens:
        special = old.join(words.select("word"), "word", "left_anti").where(~F.col("word").startswith("_OOV_"))
        m = models.reindexed(models.merge(m.select("word", "vec"), special))
        _replace(spark, m, p["model"], (s.dep, s.assoc, 0))
    else:
        model_files.write_model(m, p["model"], (s.dep, s.assoc, 0))
    if "backup" in p.given:
        training.save(spark, w, names, p["backup"], seen)


def task_toks(spark: SparkSession, p: Parameters) -> None:
    head, m = _model(spark, p)
    rows = models.token_vectors(files.read_token_lemmas(spark, p["tl_map"]), m)
    _replace(spark, models.reindexed(rows), p["model"], (head.dep, head.assoc, 0))


def task_toks_train(spark: SparkSession, p: Parameters) -> None:
    task_train(spark, p, tokens=True)


def task_toks_gramm(spark: SparkSession, p: Parameters) -> None:
    head, m = _model(spark, p)
    tokens = files.read_vocab(spark, p["vocab_t"]).select("word", "cn")
    suffix = files.read_vocab(spark, p["vocab_o"]).select("word", "cn") if "vocab_o" in p.given else None
    words = vocab.indexed(tokens.union(suffix) if suffix is not None else tokens)
    size = p.integer("size_g")
    rows = examples.grammar_examples(conll.read_conll(spark, p["train"]), words.select("word", "idx"), "form", p.integer("max_oov_sfx") if suffix is not None else 0)
    w = training.train_grammar(rows, words.count(), size, p.integer("iter"), p.number("alpha_g"))
    vectors = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(w)], "idx int, vec array<float>")
    grammar = words.select("idx", "word").join(vectors, "idx").select("word", "vec")
    base = m.select("word", "vec")
    if suffix is not None:
        marks = suffix.select(F.expr("substring(word, 6)").alias("word"))
        means = models.suffix_means(base.where(F.length("word") >= 6), marks).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"].cast("float")).alias("vec"))
        base = models.merge(base, means.select(F.concat(F.lit("_OOV_"), "word").alias("word"), "vec"))
    out = models.with_grammar(base, grammar, p.number("g_ratio"), size)
    _replace(spark, models.reindexed(out), p["model"], (head.dep, head.assoc, size))


def task_balance(spark: SparkSession, p: Parameters) -> None:
    head, m = _model(spark, p)
    _replace(spark, models.balance(m, head.sizes, p.number("a_ratio")), p["model"], head.sizes)


def task_sub(spark: SparkSession, p: Parameters) -> None:
    _, m = _model(spark, p)
    first, end = p.integer("sub_l"), p.integer("sub_r")
    model_files.write_model(models.sub_model(m, first, end), p["model"] + ".new", (end - first, 0, 0), "bin")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(p["model"]).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(hadoop(p["model"]), False)
    system.rename(hadoop(p["model"] + ".new"), hadoop(p["model"]))


def task_spl_m(spark: SparkSession, p: Parameters) -> None:
    head, m = _model(spark, p)
    counts = models.known_lemmas(files.read_token_lemmas(spark, p["tl_map"]), m)
    suffix = files.read_vocab(spark, p["vocab_o"]).select(F.expr("substring(word, 6)").alias("word"))
    stems, grammar, forms = models.split_model(m, models.stems(counts, suffix), suffix, head.gramm, head.size)
    for rows, end, size in ((stems, "stems", head.size - head.gramm), (grammar, "sfx", head.gramm), (forms, "forms", head.size)):
        model_files.write_model(models.reindexed(rows), f"{p['model']}.{end}", (size, 0, 0), "bin")


def task_rue(spark: SparkSession, p: Parameters) -> None:
    """MODEL.lex: the sizes, then the rows' vectors alone; MODEL.t2lex: lines of token and row. Marks have rows of their own."""
    head, m = _model(spark, p)
    counts = files.read_token_lemmas(spark, p["tl_map"])
    rows, names = models.shared_rows(counts, m)
    models.shared_row_totals(counts, m).show()
    marks = models.punctuation(m).orderBy("word").collect()  # 35 marks
    first = rows.count()
    extra = spark.createDataFrame([(first + i, r["word"], list(r["vec"])) for i, r in enumerate(marks)], "row long, token string, vec array<float>")
    model_files.write_rows(rows.select(F.col("row").cast("long").alias("row"), "vec").unionByName(extra.select("row", "vec")), p["model"] + ".lex", head.sizes)
    files.write_lines(names.select(F.col("token"), F.col("row").cast("long").alias("row")).unionByName(extra.select("token", "row")).orderBy("token").select(F.concat_ws(" ", "token", "row")), p["model"] + ".t2lex")


def task_fsim(spark: SparkSession, p: Parameters) -> None:
    head, m = _model(spark, p)
    given, spaces = files.read_pairs(spark, p["fsim_file"]), ("all", "dep", "assoc")
    if p["fsim_fmt"] != "detail":  # the first line is a header, and said again
        first = spark.read.text(p["fsim_file"]).first()["value"]
        print(first)
        given, spaces = given.where(F.concat_ws(",", "word1", "word2") != first.rpartition(",")[0]), ("all",)
    rows = similarity.pairs(given, m, head.sizes, p.number("a_ratio"), spaces)
    for r in rows.toLocalIterator():
        print(",".join(map(str, r)))


def task_sim(spark: SparkSession, p: Parameters) -> None:
    """Reads words, pairs of words and commands (DIM=ALL|DEP|ASSOC|GRAMM, MOD=WORD|PAIR, SHORTEST, LONGEST, EXIT) from
    standard input. In MOD=PAIR a pair may also be two lines, one word each."""
    head, m = _model(spark, p)
    m, which, paired, before = m.cache(), "all", False, None
    for line in sys.stdin:
        said = line.split()
        if not said:
            continue
        if said[0] == "EXIT":
            break
        if said[0].startswith("DIM="):
            which = said[0][4:].lower()
        elif said[0].startswith("MOD="):
            paired, before = said[0][4:].upper() == "PAIR", None
        elif paired and len(said) == 1 and said[0] not in ("SHORTEST", "LONGEST") and before is None:
            before = said[0]
        elif said[0] in ("SHORTEST", "LONGEST"):
            (similarity.shortest if said[0] == "SHORTEST" else similarity.longest)(m, head.sizes, which).show(100, False)
        elif len(said) == 2 or paired:
            said, before = (said if len(said) == 2 else [before, said[0]]), None
            rows = similarity.pairs(spark.createDataFrame([tuple(said)], "word1 string, word2 string"), m, head.sizes, p.number("a_ratio"), (which,), None)
            print(rows.first()[which])
        else:
            similarity.nearest(m, said[0], head.sizes, which, p.number("a_ratio")).show(40, False)


def task_extract(spark: SparkSession, p: Parameters) -> None:
    head, m = _model(spark, p)
    fused = similarity.fused(similarity.related(m, head.sizes, p.number("rr_min_sim")))
    files.write_extracted(fused, p["rr_vocab"] + ".dep")
    files.write_extracted(fused.limit(0), p["rr_vocab"] + ".assoc")  # there is a file of this kind, and nothing in it


def task_emerge(spark: SparkSession, p: Parameters) -> None:
    for end in ("dep", "assoc"):
        files.write_extracted(similarity.merged(files.read_extracted(spark, p["rr_vocab"], end)), f"r.{end}")


def task_sseval(spark: SparkSession, p: Parameters) -> None:
    v = files.read_vocab(spark, p["eval_vocab"])
    v.agg(F.count("*").alias("words"), F.sum("cn").alias("sum"), F.max("cn").alias("max"), F.min("cn").alias("min"), *[F.round(100 * F.avg((F.col("cn") >= t).cast("double")), 4).alias(f"share_{t}") for t in (1_000_000, 100_000, 10_000, 1_000)]).show()
    vocab.subsampling_report(v, REPORT, tuple(range(10, 100, 10))).orderBy(F.desc("threshold"), "percent").show(len(REPORT) * 9, False)


def task_selftest(spark: SparkSession, p: Parameters) -> None:
    head, m = _model(spark, p)
    m = m.cache()
    evaluation.float_classes(m).show()
    evaluation.extremes(m).show()
    shifts = evaluation.zero_shift(m)
    shifts.show()
    evaluation.histogram(m, shifts.first()["dim"]).orderBy("bin").show(300)
    for name in sorted(p.given):
        if name.startswith("test_probe"):  # -test_probe_NAME file: pairs that should be near, or far
            given = files.read_pairs(spark, p[name]).withColumn("list", F.lit(name))
            rows = similarity.pairs(given, m, head.sizes, p.number("a_ratio"), ("dep", "assoc"), None)
            for space in ("dep", "assoc"):
                print(space)
                evaluation.probe_report(rows.where(F.col(space).isNotNull()).withColumn("usim", F.col(space))).show(100, False)
        elif name.startswith("test_"):  # -test_graded_NAME file or -test_binary_NAME file
            kind = "graded" if name.startswith("test_graded") else "binary"
            print(name, evaluation.suite(files.read_test(spark, p[name], p.flag("st_yo")), m, head.sizes, p.number("a_ratio"), kind))


def task_export(spark: SparkSession, p: Parameters) -> None:
    head, m = _model(spark, p)
    model_files.write_model(m, p["rfile"], head.sizes, p["model_fmt"])


def task_import(spark: SparkSession, p: Parameters) -> None:
    head, m = model_files.read_model(spark, p["rfile"], p["model_fmt"])
    dep = p.integer("size_d") if "size_d" in p.given else head.size
    model_files.write_model(m, p["model"], (dep, head.size - dep, 0))


TASKS = {k[5:]: f for k, f in globals().items() if k.startswith("task_")}


def main(argv: list[str]) -> int:
    p = Parameters(argv)
    task = TASKS.get(p.get("task", argv[0] if argv else ""))
    if task is None:
        print(f"Tasks: {', '.join(sorted(TASKS))}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName(f"arbolex {task.__name__[5:]}").getOrCreate()
    began = time.perf_counter()
    task(spark, p)
    print(f"{time.perf_counter() - began:.1f} s", file=sys.stderr)
    return 0
