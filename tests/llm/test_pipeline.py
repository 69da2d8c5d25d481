"""The pipeline stage by stage against plain restatements of what each decides."""

import re

import pytest

import corpus_pipeline
from quarry.llm.common import ascii_lower

from .test_decontaminate import brute as contamination
from .test_near_dedup import brute as components
from quarry.llm.near_dedup import Rule

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read as a run does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs, result))
        docs = result
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "benchmark", "pieces"]
    for name in ("language", "exact", "near", "benchmark"):
        assert stages[name][1].columns == stages[name][0].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_keeps_clean_documents(stages):
    before, after = map(rows, stages["language"])
    gone = before.keys() - after.keys()
    worded = [i for i in gone if len(re.findall(r"[^\W\d_]{2,}", before[i] or "")) > 10]
    assert len(worded) <= 0.005 * len(before) and all(before[i] == t for i, t in after.items())


def test_exact_keeps_the_largest_id_of_equal_texts(stages):
    before, after = map(rows, stages["exact"])
    best = {}
    for i, t in before.items():
        best[ascii_lower(t)] = max(i, best.get(ascii_lower(t), i))
    assert after.keys() == set(best.values())


def test_near_keeps_the_smallest_id_of_each_component(stages):
    before, after = map(rows, stages["near"])
    expected = components(list(before.items()), Rule(shingle=5, percent=80))
    assert after.keys() == {i for i, (_, c) in expected.items() if i == c}


def test_benchmark_drops_contaminated_documents(spark, stages):
    before, after = map(rows, stages["benchmark"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = {r[0] for r in contamination(list(before.items()), items) if not r[-1]}
    assert after.keys() == expected and len(expected) < len(before)


def test_pieces_make_up_the_texts(stages):
    before, after = stages["pieces"]
    found = {r.doc_id: r for r in after.collect()}
    assert found.keys() == rows(before).keys() and all(r.round_trip for r in found.values())


def test_run_gives_the_rows_of_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages["pieces"][1].collect()))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows(spark, odd_docs, no_docs, name, stage):
    """Nulls, repeats, long texts and clashing columns."""
    out = stage(spark, odd_docs, SF)
    assert out.count() <= odd_docs.count() and stage(spark, no_docs, SF).count() == 0
    if name != "pieces":
        assert out.columns == odd_docs.columns


def test_sql(spark):
    assert corpus_pipeline.ORACLE_SQL is None
