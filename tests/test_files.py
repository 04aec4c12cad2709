"""File formats: round trips and the edge rows of each."""

import numpy as np
import pytest

from arbolex.operators import examples, training
from arbolex.operators import models as M
from arbolex.sources import files, models


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path}/{name}"


def test_vocab(spark, tmp_path):
    path = write(tmp_path, "v", "b 5\na 5\nc 9\nd 1")
    got = files.read_vocab(spark, path)
    assert [tuple(r) for r in got.select("idx", "word", "cn").orderBy("idx").collect()] == [(0, "c", 9), (1, "a", 5), (2, "b", 5), (3, "d", 1)]
    files.write_vocab(got, f"file://{tmp_path}/out")
    assert files.read_vocab(spark, f"file://{tmp_path}/out").count() == 4
    assert [r.word for r in files.read_vocab(spark, path, stop=files.read_words(spark, write(tmp_path, "s", "c d\na"))).collect()] == ["b"]
    for bad in ("a b c\n", "a x\n"):
        with pytest.raises(ValueError):
            files.read_vocab(spark, write(tmp_path, "bad", bad))


def test_token_lemmas(spark, tmp_path):
    path = write(tmp_path, "t", "банка банк 60 банка 70\nодин\nеще раз\nплохо плохо x\nкот кот 90\n")
    got = files.read_token_lemmas(spark, path)
    assert {tuple(r) for r in got.collect()} == {("банка", "банк", 60), ("банка", "банка", 70), ("кот", "кот", 90)}


def test_relations(spark, tmp_path):
    rows = files.read_relations(spark, write(tmp_path, "r", "a b c\n\nd e\n"))
    pairs = lambda mode: {(r.word1, r.word2) for r in examples.relation_pairs(rows, mode).collect()}
    assert pairs("first") == {("a", "b"), ("a", "c"), ("d", "e")} and pairs("all") == pairs("first") | {("b", "c")}
    weighted = examples.relation_pairs(spark.createDataFrame([(1, ["a", "b", "0.5", "c", "2"])], "line long, items array<string>"), "weighted")
    assert {tuple(r)[1:] for r in weighted.collect()} == {("a", "b", 0.5), ("a", "c", 2.0)}
    for bad in ("a\n", "a b a\n"):
        with pytest.raises(ValueError):
            files.read_relations(spark, write(tmp_path, "bad", bad))
    table = files.read_relation_table(spark, write(tmp_path, "tab", "# c\n0 59 10 100 x.vocab 1 5 3 0.2\n1 2 3\n0 x 1 2 f 1 1 1 1\n")).collect()
    assert [tuple(r) for r in table] == [(0, 59, 0.1, 1.0, "x.vocab", 1, 5, 3, 0.2)]


def test_tests_and_extracted(spark, tmp_path):
    got = files.read_test(spark, write(tmp_path, "t.csv", "word1,word2,sim\nёж,кот,0.5\nеж,кот,0.7\n"), yo=True).collect()
    assert [tuple(r) for r in got] == [("еж", "кот", 0.7)]
    assert [tuple(r) for r in files.read_pairs(spark, write(tmp_path, "p", "a,b,\nc,d\n")).collect()] == [("a", "b")]
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "m.dep").write_text("a b 0.5\nbad\na c x\n")
    assert [tuple(r) for r in files.read_extracted(spark, f"file://{tmp_path}/x").collect()] == [("a", "b", 0.5)]


@pytest.mark.parametrize("kind", models.FORMATS)
def test_model_round_trip(spark, tmp_path, kind):
    rows = [(0, "кот", [1.5, -2.0, 0.25]), (1, "a b"[:1], [0.0, 3.0, 4.0]), (2, "\n"[:0] + "x", [1e-3, 10.0, -1.0])]
    m = spark.createDataFrame(rows, "idx int, word string, vec array<float>")
    path = f"file://{tmp_path}/m.{kind}"
    models.write_model(m, path, (2, 1, 0), kind)
    head, got = models.read_model(spark, path, kind)
    assert (head.words, head.size) == (3, 3) and (kind != "parts" or head.sizes == (2, 1, 0))
    back = got.orderBy("idx").collect()
    assert [r.word for r in back] == [w for _, w, _ in rows]
    assert np.allclose([r.vec for r in back], [v for *_, v in rows], atol=1e-6)
    _, unit = models.read_model(spark, path, kind, normalise=True)
    assert np.allclose(np.linalg.norm([r.vec for r in unit.collect()], axis=1), 1, atol=1e-5)


def test_zero_vectors_are_not_normalised(spark, tmp_path):
    path = f"file://{tmp_path}/z"
    models.write_model(spark.createDataFrame([(0, "a", [0.0, 0.0])], "idx int, word string, vec array<float>"), path, (2, 0, 0))
    with pytest.raises(ValueError):
        models.read_model(spark, path, normalise=True)


def test_punctuation_and_shared_rows(spark):
    m = spark.createDataFrame([(i, w, [float(i), 1.0, -1.0 - i]) for i, w in enumerate("abc")], "idx int, word string, vec array<float>")
    marks = {r.word: r.vec for r in M.punctuation(m).collect()}
    assert len(marks) == 35 and all(abs(v[0] - 2.01) < 2.01 * 0.12 for v in marks.values()) and len({tuple(v) for v in marks.values()}) > 8
    counts = spark.createDataFrame([("a1", "a", 60), ("a2", "a", 70), ("x", "a", 100), ("x", "b", 100), ("y", "zz", 99), ("z", "c", 3)], "token string, lemma string, cnt long")
    rows, names = M.shared_rows(counts, m)
    place = {r.token: r.row for r in names.collect()}
    assert place == {"a1": 0, "a2": 0, "x": 1}
    assert {r.row: [round(x, 4) for x in r.vec] for r in rows.collect()} == {0: [0.0, 1.0, -1.0], 1: [0.5, 1.0, -1.5]}


def test_grammar_is_appended(spark):
    m = spark.createDataFrame([(0, "a", [1.0]), (1, "@num@", [2.0]), (2, "b", [3.0])], "idx int, word string, vec array<float>")
    g = spark.createDataFrame([("a", [1.0, 2.0]), ("одиннадцать", [5.0, 6.0])], "word string, vec array<float>")
    got = {r.word: [round(x, 5) for x in r.vec] for r in M.with_grammar(m, g, 0.1, 2).collect()}
    assert got == {"a": [1.0, 0.1, 0.2], "@num@": [2.0, 0.5, 0.6], "b": [3.0, 0.1, 0.0]}


def test_split_model(spark):
    words = ["дорога", "дороге", "дорогу", "_OOV_а", "_OOV_е", "_OOV_у", "кот", "дорог"]
    m = spark.createDataFrame([(i, w, [float(i), float(-i), 7.0]) for i, w in enumerate(words)], "idx int, word string, vec array<float>")
    counts = spark.createDataFrame([("дорога", "дорога"), ("дороге", "дорога"), ("дорогу", "дорога"), ("кот", "кот")], "token string, lemma string")
    suffixes = spark.createDataFrame([("а",), ("е",), ("у",)], "word string")
    found = M.stems(counts, suffixes)
    assert [(r.stem, r.lemma, r.tokens) for r in found.collect()] == [("дорог", "дорога", ["дорога", "дороге", "дорогу"])]
    heads, grammar, forms = M.split_model(m, found, suffixes, 1, 3)
    assert {r.word: len(r.vec) for r in heads.collect()} == {"дорог": 2, "_OOV_а": 2, "_OOV_е": 2, "_OOV_у": 2}
    assert {r.word: r.vec for r in grammar.collect()} == {"_OOV_а": [7.0], "_OOV_е": [7.0], "_OOV_у": [7.0]}
    assert {r.word for r in forms.collect()} == {"кот", "дорог"}


def test_training(spark):
    """Words that share contexts and sentences end nearer to each other than to the rest."""
    r = np.random.default_rng(0)
    rows = []
    for i in range(1500):
        side = i % 2
        words = (r.permutation(4)[:3] + 4 * side).tolist()
        rows += [(i, j, w, [int(r.integers(0, 3)) + 3 * side], [x for x in words if x != w]) for j, w in enumerate(words)]
    df = spark.createDataFrame(rows, "sent_id long, pos int, word int, dep array<int>, assoc array<int>").repartition(2)
    s = training.Settings(dep=8, assoc=8, rate_dep=0.25, rate_assoc=0.25, epochs=5, rounds=2, negative_dep=4, negative_assoc=4)
    w = training.train(df, np.full(8, 500), np.full(6, 1 / 6), 6, s)
    for m in (w.dep, w.assoc):
        assert np.isfinite(m).all() and np.abs(m).max() <= 3
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        same = (u[:4] @ u[:4].T)[np.triu_indices(4, 1)].mean() + (u[4:] @ u[4:].T)[np.triu_indices(4, 1)].mean()
        assert same / 2 > (u[:4] @ u[4:].T).mean() + 0.3
    frozen = training.train(df, np.full(8, 500), np.full(6, 1 / 6), 6, training.Settings(dep=8, assoc=8, epochs=1, tokens=True), training.Weights(w.dep.copy(), w.ctx.copy(), w.assoc.copy()))
    assert (frozen.ctx == w.ctx).all() and (frozen.assoc == w.assoc).all() and (frozen.dep != w.dep).any()


def test_training_state(spark, tmp_path):
    w = training.start(np.array([5, 9]), 3, training.Settings(dep=2, assoc=2))
    training.save(spark, w, ["a", "b"], f"file://{tmp_path}/w")
    back = training.restore(spark, ["a", "b"], f"file://{tmp_path}/w")
    assert all(np.allclose(x, y) for x, y in zip(w.kinds(), back.kinds(), strict=True))
    with pytest.raises(ValueError):
        training.restore(spark, ["b", "a"], f"file://{tmp_path}/w")


def test_schedules_and_attraction():
    assert training.rate(1, 0.0, 0.15) == 0.001 and abs(training.rate(1, 0.15, 0.15) - 1) < 1e-9 and abs(training.rate(1, 1.0, 0.15) - 0.001) < 1e-9
    assert training.grammar_rate(1, 0.5) == 0.5 and training.grammar_rate(1, 1) == 1e-4
    assert [training.subsampling(8, f) for f in (0, 0.4, 0.7, 0.9)] == [8, 4, 2, 1]
    assert training.sigmoid(np.array([20.0, -20.0])).tolist() == [0.99999999, 1e-8]
    a, b = np.array([1.0, -1.0]), np.array([-1.0, -2.0])
    training.attract_signs(a, b, False, 0.0)
    assert b[0] > -1 and b[1] == -2 and a.tolist() == [1, -1]
    training.attract_euclid(a, b, 0.0, 0.5)
    assert np.allclose(a, a) and abs(a[1] + 1.5) < 1e-9


def test_examples_are_drawn_anew(spark):
    """Associations have a threshold of their own, draws differ by step, and words are kept less late in training."""
    word = lambda w, i: (str(i), w, w, "_", "_", "_", str(i - 1), "r", "_", "_")
    fields = "id form lemma upos xpos feats head deprel deps misc".split()
    sentences = spark.createDataFrame([(i, [word("a", 1), word("b", 2)]) for i in range(2000)], f"sent_id long, toks array<struct<{','.join(f'{f}:string' for f in fields)}>>")
    words = spark.createDataFrame([("a", 0, 2000), ("b", 1, 2000)], "word string, idx int, cn long")
    contexts = spark.createDataFrame([("a>r", 0, 1.0)], "word string, idx int, p double")
    draw = examples.draws(sentences, words, contexts, sample_w=0.0, sample_a=1e-3)
    rows = draw(0, 0.0).collect()
    assert len(rows) == 4000 and 0 < sum(len(r.assoc) for r in rows) < 400
    draw = examples.draws(sentences, words, contexts, sample_w=0.05, sample_a=0.0)
    kept = [{(r.sent_id, r.pos) for r in draw(*x).collect()} for x in ((0, 0.0), (1, 0.2), (2, 0.9))]
    assert kept[0] != kept[1] and abs(len(kept[0]) - len(kept[1])) < 200 and len(kept[2]) < len(kept[0]) / 2
    halves = examples.draws(sentences, words, contexts, sample_w=0.0, sample_a=0.0, rounds=2)
    parts = [{(r.sent_id, r.pos) for r in halves(i, 0.0).collect()} for i in (0, 1)]
    assert not parts[0] & parts[1] and len(parts[0] | parts[1]) == 4000


def test_saturated_products_shrink_the_space(spark, monkeypatch):
    df = spark.createDataFrame([(i, 0, 0, [0], []) for i in range(20)], "sent_id long, pos int, word int, dep array<int>, assoc array<int>").coalesce(2)
    s = training.Settings(dep=4, assoc=2, epochs=1, negative_dep=1)
    full = lambda: training.Weights(*(np.full((1, n), 2.9, np.float32) for n in (4, 4, 2)))
    monkeypatch.setattr(training, "SATURATED", 41)
    as_is = training.train(df, np.array([20]), np.array([1.0]), 1, s, full())
    monkeypatch.setattr(training, "SATURATED", 40)  # 20 of contexts, 20 of noise
    shrunk = training.train(df, np.array([20]), np.array([1.0]), 1, s, full())
    assert np.allclose(shrunk.dep, 0.9 * as_is.dep, atol=1e-4) and np.allclose(shrunk.ctx, 0.8 * as_is.ctx, atol=1e-4) and np.allclose(shrunk.assoc, as_is.assoc)
