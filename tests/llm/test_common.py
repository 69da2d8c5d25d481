"""Odd columns for all operators and stages, shared storage, salted joins."""

from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, files
from quarry.llm.decontaminate import decontaminate
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.language import identify_languages
from quarry.llm.licenses import scan_licenses
from quarry.llm.near_dedup import near_dedup
from quarry.llm.pieces import encode_pieces
from quarry.llm.queries import tokenizer_path
from quarry.llm.secrets import scan_secrets
from quarry.llm.token_files import token_corpus
from quarry.llm.urls import filter_urls
from quarry.llm.warc import round_trip

SF = "/root/testdata/sf0.01"
OPERATORS = {
    "op1": exact_dedup, "op2": lambda d: encode_pieces(d, tokenizer_path("piece_bpe_32k.model")), "op3": scan_licenses, "op4": scan_secrets, "op5": lambda d: filter_urls(d, id_col="doc_id", url_col="source"),
    "op6": lambda d: decontaminate(d, d.sparkSession.read.parquet(f"{SF}/benchmark.parquet")), "op7": identify_languages, "op8": near_dedup,
    "op9": lambda d: round_trip(d, "doc_id", "text"), "op10": lambda d: token_corpus(d, tokenizer_path("byte_bpe_50k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_bear_any_columns(strange_docs, name):
    assert Counter(r.doc_id for r in OPERATORS[name](strange_docs).collect()) == Counter(r.doc_id for r in strange_docs.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_ids_and_texts_have_any_names(strange_docs, name):
    """An operator's own columns may be called anything, too."""
    if name in ("op5", "op9"):
        pytest.skip("covered above: both are told their columns")
    renamed = strange_docs.select(F.col("doc_id").alias("my.id"), F.col("text").alias("the text"), "lang", "source")
    calls = {
        "op1": exact_dedup, "op2": lambda d, *a: encode_pieces(d, tokenizer_path("piece_bpe_32k.model"), 4, *a), "op3": scan_licenses, "op4": scan_secrets,
        "op6": lambda d, i, t: decontaminate(d, d.sparkSession.read.parquet(f"{SF}/benchmark.parquet"), i, text_col=t), "op7": lambda d, i, t: identify_languages(d, i, text_col=t),
        "op8": lambda d, i, t: near_dedup(d, id_col=i, text_col=t), "op10": lambda d, *a: token_corpus(d, tokenizer_path("byte_bpe_50k.json"), *a),
    }
    out = calls[name](renamed, "my.id", "the text")
    assert out.columns[0] == "my.id" and out.count() == renamed.count()


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_bear_any_columns(spark, strange_docs, name, stage):
    out = stage(spark, strange_docs, SF)
    rows = out.collect()
    if name != "pieces":
        assert out.columns == strange_docs.columns and out.schema["m"].dataType == strange_docs.schema["m"].dataType
        whole = {(r.doc_id, str(r)) for r in strange_docs.collect()}
        assert rows and {(r.doc_id, str(r)) for r in rows} <= whole


def test_a_cluster_must_name_its_shared_folder(spark):
    conf = SimpleNamespace(get=lambda *a: None)
    remote = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_root(remote)
    assert common.scratch_root(spark).startswith("file:/")


def test_paths_are_those_of_spark(spark, tmp_path):
    assert common.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    with pytest.raises(ValueError, match="no scheme"):
        files.read_bytes(f"{tmp_path}/x")
    with files.create(f"file:{tmp_path}/new", "a", ".bin") as (uri, stream):
        stream.write(b"content")
    assert files.read_bytes(uri) == b"content" and [r.content for r in spark.read.format("binaryFile").load(uri).collect()] == [b"content"]
    assert [files.arrow_uri(u) for u in ("s3a://bucket/x", "hdfs://h:1/x", "file:/x", "file:///x")] == ["s3://bucket/x", "hdfs://h:1/x", "file:///x", "file:///x"]


def test_hot_keys_meet_their_fact_on_all_salts(spark):
    """Identical rows of one key, a third of all, part; nothing is lost or doubled."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS k", "'same' AS v")
    facts = rows.select("k").distinct().withColumn("n", F.length("k"))
    out = common.send_back(rows, "k", facts, salts=10)
    assert out.count() == 3000 and out.columns == ["k", "v", "n"] and out.where("n != length(k)").count() == 0
    assert common.hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), 3000, 10) == ["hot"]
    binary = rows.withColumn("k", F.encode("k", "utf-8"))
    assert common.send_back(binary, "k", binary.select("k").distinct(), salts=10).count() == 3000
    assert common.send_back(rows.limit(0), "k", facts).count() == 0


def test_likely_rows_are_all_wanted_ones_and_few_others(spark):
    rows = spark.range(100_000).selectExpr("IF(id % 1000 = 7, NULL, id) AS id", "'x' AS v")
    wanted = spark.range(0, 100_000, 50)
    found = common.likely(rows, "id", wanted, 2000)
    ids = {r.id for r in found.collect()}
    assert found.columns == ["id", "v"] and {r.id for r in wanted.collect()} - {i for i in range(100_000) if i % 1000 == 7} <= ids and len(ids) < 10_000
    assert common.likely(rows, "id", wanted.limit(0), 0).count() == 0
    assert common.likely(rows.withColumn("id", F.col("id").cast("string")), "id", wanted.select(F.col("id").cast("string").alias("id")), 2000).count() >= 2000


def test_hashes_of_long_words_never_stay():
    hashes = common.WordHashes()
    assert hashes[b"x" * 10_000] == hashes[b"x" * 10_000] != hashes[b"x"] and list(hashes) == [b"x"]
