"""Rules of the clean-up, on hand-written sentences."""

import pytest
from pyspark.sql import functions as F

from arbolex.functions.text import fold_number
from arbolex.operators.fit import Sentence, fit
from arbolex.operators.mwe import PatternError, Rewriter, parse_list, parse_tree, rewrite
from arbolex.sources.conll import FIELDS, read_conll, write_conll

SAMPLE = """# a comment
1\tКот\tкот\t_\t_\tNcmsny\t2\tпредик\t_\t_
2\tспит\tспать\t_\t_\tVmip3s-a-p\t0\tROOT\t_\t_
3\tв\tв\t_\t_\tSp-l\t2\tобст\t_\t_
4\tдоме\tдом\t_\t_\tNcmsln\t3\tпредл\t_\t_
5\t.\t.\t_\t_\t-\t2\tPUNC\t_\t_

1\tbad\tline

1\ta\tb\t_\t_\tC\t0\t_\t_\t_
3\tgap\tgap\t_\t_\tC\t0\t_\t_\t_

1\tА\tа\t_\t_\tNpmsny\t0\tпредик\t_\t_
"""


def sentence(*rows):
    """(form, lemma, feats, head, deprel) each."""
    return [dict.fromkeys(FIELDS, "_") | {"id": str(i + 1), "form": f, "lemma": m, "feats": x, "head": str(h), "deprel": r} for i, (f, m, x, h, r) in enumerate(rows)]


def arcs(toks):
    return [(t["head"], t["deprel"]) for t in toks]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_read_fit_write(spark, tmp_path, end):
    (tmp_path / "in.conll").write_bytes(SAMPLE.replace("\n", end).encode())
    rows = read_conll(spark, f"file://{tmp_path}/in.conll")
    assert [len(r.toks) for r in rows.orderBy("sent_id").collect()] == [5, 2, 1]
    out = [[t.asDict() for t in r.toks] for r in fit(rows).orderBy("sent_id").collect()]
    assert len(out) == 2  # ids with a gap go
    assert [t["form"] for t in out[0]] == ["кот", "спит", "в", "доме", "."]
    assert arcs(out[0]) == [("2", "предик"), ("0", "_"), ("4", "ud_prepos"), ("2", "в__loc"), ("2", "PUNC")]
    assert out[1][0]["lemma"] == "а_NP"
    write_conll(rows, f"file://{tmp_path}/out")
    again = read_conll(spark, f"file://{tmp_path}/out")
    assert sorted(map(str, (r.toks for r in again.collect()))) == sorted(map(str, (r.toks for r in rows.collect())))


def test_plain_prepositions():
    toks = sentence(("х", "х", "V", 0, "_"), ("чрез", "чуждый", "S", 1, "обст"), ("лес", "лес", "Ncmsgn", 2, "предл"), ("и", "и", "S", 1, "_"), ("дом", "дом", "Ncmsgn", 4, "предл"))
    s = Sentence(toks)
    s.prepositions(True)
    assert arcs(toks)[2] == ("2", "предл")  # the table does not know it
    s.prepositions(False)
    assert arcs(toks) == [("0", "_"), ("3", "ud_prepos"), ("1", "обст"), ("5", "ud_prepos"), ("4", "_")]


def test_completives_copulas_and_auxiliaries():
    toks = sentence(("дал", "дать", "V", 0, "_"), ("ему", "он", "Ncmsdy", 1, "2-компл"))
    Sentence(toks).completives()
    assert toks[1]["deprel"] == "компл-d"
    toks = sentence(("он", "он", "Ncmsny", 2, "предик"), ("был", "быть", "V", 0, "_"), ("врач", "врач", "Ncmsny", 2, "присвяз"))
    Sentence(toks).copulas()
    assert toks[0]["head"] == "3"
    toks = sentence(("он", "он", "Ncmsny", 2, "предик"), ("будет", "быть", "V", 0, "_"), ("петь", "петь", "V", 2, "аналит"), ("бы", "бы", "Q", 2, "аналит"))
    Sentence(toks).analytic()
    assert arcs(toks) == [("3", "предик"), ("0", "_"), ("2", "аналит"), ("3", "аналит")]


def test_passive():
    toks = sentence(("дом", "дом", "Ncmsnn", 2, "предик"), ("был", "быть", "V", 0, "_"), ("построен", "построить", "V", 2, "пасс-анал"))
    Sentence(toks).passive()
    # the subject is visited before the auxiliary moves it, and renamed by the auxiliary
    assert arcs(toks) == [("3", "предик-пасс"), ("0", "_"), ("2", "пасс-анал")]
    toks = sentence(("дом", "дом", "Ncmsnn", 2, "предик"), ("построенный", "построить", "Vmps-smpx", 0, "_"))
    Sentence(toks).passive()
    assert toks[0]["deprel"] == "предик-пасс"


def test_coordination():
    toks = sentence(("вижу", "видеть", "V", 0, "_"), ("лес", "лес", "Ncmsan", 1, "1-компл"), ("и", "и", "C", 2, "сочин"), ("дом", "дом", "Ncmsan", 3, "соч-союзн"), ("но", "но", "C", 2, "сочин"), ("сад", "сад", "Ncmsan", 5, "соч-союзн"))
    Sentence(toks).coordination()
    assert arcs(toks)[3] == ("1", "1-компл") and arcs(toks)[5][1] == "_" and arcs(toks)[2][1] == "_"
    toks = sentence(("а", "а", "Nc", 2, "сочин"), ("б", "б", "Nc", 1, "сочин"), ("в", "в", "Nc", 9, "сочин"), ("г", "г", "Nc", 5, "сочин"), ("д", "д", "Nc", 0, "аппоз"))
    Sentence(toks).coordination()  # a circle, a head out of range, an apposition
    assert [t["deprel"] for t in toks[:4]] == ["_"] * 4


def test_function_words_hang_from_stubs():
    toks = Sentence(sentence(("не", "не", "Q", 0, "_"), ("что", "что", "Cs", 0, "_"), ("и", "и", "Cc", 0, "сочин"), ("или", "или", "Cc", 0, "_"))).toks
    s = Sentence(toks)
    s.function_words()
    assert arcs(toks)[:4] == [("5", "q"), ("6", "cs"), ("0", "сочин"), ("6", "cc")]
    assert [(t["id"], t["misc"], t["head"]) for t in toks[4:]] == [("5", "STUB", "0"), ("6", "STUB", "0")]


def test_numbers(spark):
    words = ["15-летие", "5-6-этажный", "12", "7‐кратный", "что-то", "3-x", "1,5-литровый", "-летие", "10--летие"]
    got = [r.x for r in spark.createDataFrame([(w,) for w in words], "w string").select(fold_number(F.col("w")).alias("x")).collect()]
    assert got == ["@num@-летие", "@num@-этажный", "12", "@num@-кратный", "что-то", "3-x", "@num@-литровый", "-летие", "10--летие"]
    toks = [tuple(t[f] for f in FIELDS) for t in sentence(("15-Летие", "@num@", "Nc", 0, "обст"), ("15-летие", "15-летие", "Nc", 0, "обст"))]
    df = spark.createDataFrame([(1, toks)], f"sent_id long, toks array<struct<{', '.join(f'{f}: string' for f in FIELDS)}>>")
    out = fit(df, exclude_numbers=True).first().toks
    assert [(t.form, t.lemma) for t in out] == [("@num@", "@num@"), ("@num@-летие", "@num@-летие")]


def test_patterns():
    tree = parse_tree("{^[противоречить]точка{зрение(noun)}}")
    assert (tree.word, tree.replaced, tree.head.word, tree.head.replaced) == ("точка", True, "противоречить", False)
    assert (tree.children[0].word, tree.children[0].replaced, tree.children[0].pos) == ("зрение", True, "noun")
    assert parse_tree("[омар(tомару)]").form == "омару"
    for bad in ("точка", "[a", "[]", "[a]b", "[a b]]", "[a(x)]"):
        with pytest.raises(PatternError):
            parse_tree(bad)
    phrases = parse_list(["# no", "", "a_b\t[[a]b]", "+\t[b[c]]"])
    assert [(p.name, p.word, len(p.trees), p.transient) for p in phrases] == [("a_b", "b", 2, True)]
    with pytest.raises(PatternError):
        parse_list(["a_b\t[[a]b]", "+\t[c]"])


def test_rewriting(spark):
    toks = sentence(("моя", "мой", "A", 2, "опред"), ("точка", "точка", "Nc", 4, "предик"), ("зрения", "зрение", "Nc", 2, "квазиагент"), ("ясна", "ясный", "A", 0, "_"), (".", ".", "-", 4, "PUNC"))
    r = Rewriter(parse_list(["точка_зрения\t{точка{зрение}}", "ясный_взгляд\t[[точка_зрения]ясный]"]))
    out = r.rewrite([dict(t) for t in toks])
    assert [(t["id"], t["lemma"], t["head"]) for t in out] == [("1", "мой", "2"), ("2", "точка_зрения", "3"), ("3", "ясный_взгляд", "0"), ("4", ".", "3")]
    up = Rewriter(parse_list(["т\t[^[ясный]точка]"])).rewrite([dict(t) for t in toks])
    assert up[1]["lemma"] == "т"
    assert Rewriter(parse_list(["т\t[точка[зрение(tx)]]"])).rewrite([dict(t) for t in toks])[1]["lemma"] == "точка"
    odd = [dict(t) | {"head": "x"} for t in toks]
    assert r.rewrite(odd) == odd
    rows = [tuple(t[f] for f in FIELDS) for t in toks]
    df = spark.createDataFrame([(1, rows), (2, rows[3:4])], f"sent_id long, toks array<struct<{', '.join(f'{f}: string' for f in FIELDS)}>>")
    got = {r.sent_id: [t.lemma for t in r.toks] for r in rewrite(df, list(p for ps in r.by_word.values() for p in ps)).collect()}
    assert got == {1: ["мой", "точка_зрения", "ясный_взгляд", "."], 2: ["ясный"]}


def test_sentences_with_null_lemmas_stay(spark):
    rows = [(1, [("a",), (None,)]), (2, [("b",), (None,)]), (3, [("b",)])]
    names = "id form lemma upos xpos feats head deprel deps misc".split()
    rows = [(i, [tuple({"id": str(j + 1), "form": "f", "lemma": t[0], "head": str(j)}.get(n, "_") for n in names) for j, t in enumerate(toks)]) for i, toks in rows]
    df = spark.createDataFrame(rows, f"sent_id long, toks array<struct<{','.join(f'{n}:string' for n in names)}>>")
    assert sorted(r.sent_id for r in rewrite(df, parse_list(["a_b\t[a[b]]"])).collect()) == [1, 2, 3]


def test_sentences_without_moving_relations_are_arrays(monkeypatch):
    """Only sentences with a relation that a rule follows are taken one by one, with the same results."""
    import random

    import pyarrow as pa

    from arbolex.operators import fit as module
    from arbolex.sources.conll import FIELDS

    r = random.Random(5)

    def sentence(relations):
        n = r.randrange(1, 9)
        return [dict.fromkeys(FIELDS, "_") | {"id": r.choice([str(i + 1)] * 9 + [f"{i + 1}a"]), "form": r.choice("ab,."), "lemma": r.choice(["и", None]), "feats": r.choice(["Cc", "Q", "Ncmsny", ""]), "head": str(r.randrange(n + 2)), "deprel": r.choice(relations)} for i in range(n)]

    sentences = [sentence(module.RELATIONS + ["_"]) if i % 2 else sentence(["_", "PUNC", "атриб"]) for i in range(400)]
    clean = lambda s: [{k: v or "" for k, v in t.items()} for t in s]
    want = [module.Sentence(clean(s)).rewrite() for s in sentences if module._in_order([t["id"] for t in s])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(sentences, pa.list_(pa.struct([(f, pa.string()) for f in FIELDS])))], ["sent_id", "toks"])
    monkeypatch.setattr(module, "TOKENS", 40)
    assert [t for out in module._rewritten(iter([batch])) for t in out.column("toks").to_pylist()] == want
    plain = pa.RecordBatch.from_arrays([c.filter(pa.array([i % 2 == 0 and all(t["id"] == str(j) for j, t in enumerate(s, 1)) for i, s in enumerate(sentences)])) for c in batch.columns], batch.schema.names)
    monkeypatch.setattr(module, "Sentence", None)
    assert sum(map(len, module._rewritten(iter([plain])))) == len(plain) > 0
