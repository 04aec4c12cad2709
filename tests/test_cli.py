"""Tasks of the command line on a small corpus, one after the other."""

import numpy as np
import pytest

from arbolex import cli
from arbolex.sources import files, models


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    r, out = np.random.default_rng(3), []
    words = [f"слово{c}" for c in "абвгде"]
    for _ in range(300):
        n = int(r.integers(3, 7))
        rows = [f"{i + 1}\t{w.capitalize()}ми\t{w}\t_\t_\tNcmsny\t{i}\tатриб\t_\t_" for i, w in enumerate(r.choice(words, n))]
        out.append("\n".join([*rows, f"{n + 1}\t.\t.\t_\t_\t-\t1\tPUNC\t_\t_"]))
    (at / "raw.conll").write_text("\n\n".join(out) + "\n", encoding="utf-8")
    (at / "mwe").write_text("слово_аб\t[слово[а]]\nпара\t[слова[словоб]]\nаб\t[словоа[словоб]]\n", encoding="utf-8")
    return f"file://{at}"


def run(corpus, task, **given):
    argv = ["-task", task]
    for k, v in given.items():
        argv += ["-" + k.replace("__", "-"), f"{corpus}/{v[1:]}" if str(v).startswith("@") else str(v)]
    assert cli.main(argv) == 0


def test_from_raw_text_to_models(spark, corpus, capsys):
    run(corpus, "fit", fit_input="@raw.conll", train="@fit")
    run(corpus, "vocab", train="@fit", vocab_l="@l", vocab_t="@t", tl_map="@tl", vocab_o="@o", vocab_d="@d", vocab_e="@mwe", min__count_l=5, min__count_t=5, min__count_o=5, min__count_d=5)
    lemmas = {r.word: r.cn for r in files.read_vocab(spark, f"{corpus}/l").collect()}
    assert "аб" in lemmas and len(lemmas) == 7
    run(corpus, "train", train="@fit", vocab_l="@l", vocab_d="@d", vocab_e="@mwe", model="@m", size_d=4, size_a=3, iter=1, sample_w=0, sample_d=0, backup="@w")
    head, m = models.read_model(spark, f"{corpus}/m")
    assert head.sizes == (4, 3, 0) and {r.word for r in m.collect()} == set(lemmas) - {"аб"}  # phrases are collapsed
    run(corpus, "export", model="@m", rfile="@m.txt", model_fmt="txt")
    run(corpus, "import", model="@back", rfile="@m.txt", model_fmt="txt", size_d=4)
    assert models.read_model(spark, f"{corpus}/back")[0].sizes == (4, 3, 0)
    run(corpus, "balance", model="@back", a_ratio=0.5)
    run(corpus, "extract", model="@m", rr_vocab="@rr", rr_min_sim=-1)
    assert files.read_extracted(spark, f"{corpus}/rr.dep").count() == 30
    assert files.read_extracted(spark, f"{corpus}/rr.assoc").count() == 0
    run(corpus, "rue", model="@m", tl_map="@tl")
    names = dict(r.value.rsplit(" ", 1) for r in spark.read.text(f"{corpus}/m.t2lex").collect())
    lex = bytes(spark.read.format("binaryFile").load(f"{corpus}/m.lex").first().content)
    line, _, body = lex.partition(b"\n")
    count = len(set(names.values()))
    assert "«" in names and line == f"{count} 7 4 3".encode() and len(body) == count * 7 * 4
    run(corpus, "toks", model="@m", tl_map="@tl")
    assert models.read_model(spark, f"{corpus}/m")[0].words == 6
    run(corpus, "toks_gramm", model="@m", train="@fit", vocab_t="@t", size_g=2, iter=1)
    head, m = models.read_model(spark, f"{corpus}/m")
    assert head.sizes == (4, 3, 2) and all(len(r.vec) == 9 for r in m.collect())
    run(corpus, "punct", model="@m")
    assert models.read_model(spark, f"{corpus}/m")[0].words == 6 + 35
    run(corpus, "selftest", model="@m")
    run(corpus, "sseval", eval_vocab="@l")
    run(corpus, "sub", model="@back", sub_l=1, sub_r=3)
    assert models.read_model(spark, f"{corpus}/back", "bin")[0].size == 2
    assert "normal" in capsys.readouterr().out


def test_interactive(spark, corpus, capsys, monkeypatch):
    import io

    m = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [1.0, 1.0]), (2, "c", [0.0, 1.0])], "idx int, word string, vec array<float>")
    models.write_model(m, f"{corpus}/tiny", (2, 0, 0))
    monkeypatch.setattr("sys.stdin", io.StringIO("DIM=ALL\nMOD=PAIR\na\nb\na c\nMOD=WORD\na\nEXIT\nb\n"))
    run(corpus, "sim", model="@tiny")
    out = capsys.readouterr().out.splitlines()
    assert abs(float(out[0]) - 0.5**0.5) < 1e-6 and float(out[1]) == 0.0 and sum("|b" in x for x in out) == 1


def test_unknown_task(capsys):
    assert cli.main(["-task", "nothing"]) == 1
    assert "vocab" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.Parameters(["-model", "m"])["vocab_l"]
    p = cli.Parameters(["-size_d", "7", "-sub_l", "-3"])
    assert (p.integer("size_d"), p.integer("size_a"), p["sub_l"]) == (7, 40, "-3")


def test_tokens_are_trained_against_restored_contexts(spark, corpus):
    run(corpus, "fit", fit_input="@raw.conll", train="@fit2")
    run(corpus, "vocab", train="@fit2", vocab_l="@l2", vocab_t="@t2", tl_map="@tl2", vocab_d="@d2", min__count_l=5, min__count_t=5, min__count_d=5)
    given = {"train": "@fit2", "vocab_d": "@d2", "model": "@m2", "size_d": 4, "size_a": 3, "iter": 3, "alpha_d": 0.25, "sample_w": 0, "sample_d": 0}
    run(corpus, "train", vocab_l="@l2", backup="@w2", **given)
    run(corpus, "toks", model="@m2", tl_map="@tl2")
    before = {r.word: r.vec for r in models.read_model(spark, f"{corpus}/m2")[1].collect()}
    with pytest.raises(SystemExit):
        run(corpus, "toks_train", vocab_t="@t2", **given)
    run(corpus, "toks_train", vocab_t="@t2", restore="@w2", **given)
    after = {r.word: r.vec for r in models.read_model(spark, f"{corpus}/m2")[1].collect()}
    assert set(after) == set(before) and len(after) == 6
    for word, v in before.items():
        assert not np.allclose(after[word][:4], v[:4], atol=1e-7) and np.allclose(after[word][4:], v[4:])


def test_selftest_reports_probe_lists(spark, tmp_path, capsys):
    m = spark.createDataFrame([(0, "а", [1.0, 0.0, 1.0]), (1, "б", [1.0, 0.0, -1.0]), (2, "в", [0.0, 1.0, 1.0])], "idx int, word string, vec array<float>")
    models.write_model(m, f"file://{tmp_path}/p", (2, 1, 0))
    (tmp_path / "near.csv").write_text("а,б,\nа,в,\nа,нет,\n", encoding="utf-8")
    run(f"file://{tmp_path}", "selftest", model="@p", test_probe_near="@near.csv")
    said = capsys.readouterr().out.split("dep\n")[1]
    dep, assoc = said.split("assoc\n")
    assert "test_probe_near" in dep and "|0.5 " in dep and "а б" in dep and "|-1.0 " in assoc
