"""The pipeline, stage by stage, against brute force on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from arbolex.llm.pieces import Encoder
from arbolex.llm.quality import quality_rules
from arbolex.llm.queries import ORACLE_SQL, QUERIES

from tests.llm.conftest import prose

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    item = prose(500, 30)
    texts = [prose(i, 60 + i) for i in range(30)]
    texts += [texts[3], texts[4].replace("\n", " ") + "more", "tiny", "", None, "\n".join(["same line of text again", prose(41, 70)]), "\n".join([prose(42, 70), "Same line of text again"]), prose(43, 60) + item + prose(44, 60)]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = (before, {r.doc_id: r.text for r in docs.collect()})
    before, after = kept["quality rules"]
    verdict = {r.doc_id for r in quality_rules(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("kept").collect()}
    assert set(after) == verdict and not {32, 33, 34} & set(after) and all(after[d] == before[d] for d in after)
    before, after = kept["line dedup"]
    assert set(after) == set(before) and "ame line of text again" in after[35] and "ame line of text again" not in after[36]
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    before, after = kept["near dedup"]
    shingles = lambda t: {tuple(w) for w in zip(*(re.findall("[^\x20\x09-\x0d]+", t.translate(FOLD))[i:] for i in range(5)), strict=False)}
    dup = {b for a in before for b in before if a < b and 100 * len(shingles(before[a]) & shingles(before[b])) >= 80 * len(shingles(before[a]) | shingles(before[b])) > 0}
    assert set(before) - set(after) == dup == {31}
    before, after = kept["decontamination"]
    assert set(before) - set(after) == {37} & set(before) and 37 in before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tool, ids = Encoder(public_tokenizers.path("byte_bpe_50k.json")).library, defaultdict(list)
    for r in out:
        ids[r.doc_id].append((r.start, bytes(r.ids)))
    for d, t in after.items():
        assert b"".join(x for _, x in sorted(ids[d])) == np.array([*tool.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert set(ids) == set(after)
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.start, r.length, bytes(r.ids))
    assert Counter(d for d, *_ in map(key, whole)).keys() == Counter(d for d, *_ in map(key, out)).keys()


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ["op4_benchmark_decontamination", "op6_secret_scans", "op8_line_dedup"])
def test_native_plans_have_no_python(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert spark.range(1).select(F.lit(1)).count() == 1
