"""Every registered query against its SQL, and the guard around the optional part."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from quarry.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.sql(sql).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (sorted(map(str, df[columns].values.tolist())) for df in (got, want))
    assert a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["vec_id", "label", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_works_without_the_optional_part(tmp_path, left):
    """A copy without the training-data operators still imports and lists the other queries, with the pipeline's file left in place too."""
    import shutil

    root = Path(__spark_entry__.__file__).parent
    for name in left:
        if not (root / name).exists():
            pytest.skip(f"{name} is not there")
        shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(catalogue.queries())), "False", str(len(catalogue.oracle_sql()))]


def test_hash_embedding_reads_as_much_as_the_operator(spark, tmp_path):
    from quarry.plugins import HashEmbedder

    texts = ["a" * 1000 + x + "a" * 1000 for x in "bc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.embedding for r in catalogue.queries()["hash_embedding"](spark, str(tmp_path)).collect()}
    assert got[0] != got[1]
    for i, text in enumerate(texts):
        assert list(got[i]) == pytest.approx(HashEmbedder().embed_query(text), abs=1e-4)
