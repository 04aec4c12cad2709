"""Every registered query against its SQL in DuckDB, on the smallest tables; streaming; the entry module."""

import math
import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry_module
from arbolex.plans import queries as plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        at = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return int(x) if hasattr(x, "numerator") and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = plans.QUERIES[name](spark, DATA)
    want = con.sql(plans.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", ["fit_sentences", "mwe_rewrite", "punctuation_vectors"])
def test_query_has_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["word", "cn", "idx"]
    assert set(plans.QUERIES) <= set(entry_module.queries()) and set(plans.ORACLE_SQL) <= set(entry_module.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_context_lookup_is_not_a_join(spark):
    from arbolex.operators.vocab import context_counts
    from arbolex.plans.views import flat

    plan = context_counts(flat(spark.read.parquet(f"{DATA}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ReadSchema: struct<text:string>" in plan


def test_lemmas_are_made_once(spark):
    """A word's lemma is worked out in one place of the plan, after words are counted."""
    from arbolex.operators.vocab import lemma_counts
    from arbolex.plans.views import counted

    plan = lemma_counts(counted(spark.read.parquet(f"{DATA}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.index("regexp_replace") < plan.index("partial_count")


def test_related_in_blocks(spark, monkeypatch):
    """Many small blocks give the pairs that one block gives."""
    from arbolex.operators import similarity

    m = plans._model(spark, DATA)
    ask = lambda: sorted((r.w1, r.w2, round(r.dep, 9), round(r.assoc, 9)) for r in similarity.related(m, plans.SIZES, 0.2, 7, cyrillic=False).collect())
    whole = ask()
    monkeypatch.setattr(similarity, "BLOCK", 90)
    monkeypatch.setattr(similarity, "ROWS", 13)
    assert whole and ask() == whole


def test_random_pairs_repeat(spark):
    from arbolex.operators.examples import random_pairs

    lines = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["d", "e"])], "line int, items array<string>")
    one = [tuple(r) for r in random_pairs(lines, 2, 5).collect()]
    assert len(one) == 2 and one == [tuple(r) for r in random_pairs(lines.repartition(3), 2, 5).collect()]


def test_streaming_vocabulary(spark, tmp_path):
    from arbolex.streaming.vocab import lemma_stream, sentence_stream

    (tmp_path / "in").mkdir()
    line = "1\tКот\tкот\t_\t_\tNcmsny\t0\tпредик\t_\t_\n\n"
    (tmp_path / "a").write_text(line * 3, encoding="utf-8")
    shutil.move(tmp_path / "a", tmp_path / "in" / "a.txt")
    stream = lemma_stream(sentence_stream(spark, f"file://{tmp_path}/in"), "lemmas", f"file://{tmp_path}/state")
    try:
        stream.processAllAvailable()
        assert [tuple(r) for r in spark.sql("SELECT * FROM lemmas").collect()] == [("кот", 3)]
        (tmp_path / "b").write_text(line.replace("кот", "пёс") + line, encoding="utf-8")
        shutil.move(tmp_path / "b", tmp_path / "in" / "b.txt")
        stream.processAllAvailable()
        assert {tuple(r) for r in spark.sql("SELECT * FROM lemmas").collect()} == {("кот", 4), ("пёс", 1)}
    finally:
        stream.stop()


def test_token_training_moves_tokens(spark):
    rows = plans.QUERIES["toks_train"](spark, DATA).collect()
    assert rows and not any(r.bad for r in rows) and sum(r.moved for r in rows) > len(rows) / 2
