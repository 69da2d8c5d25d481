"""A corpus through five stages: language, exact copies, near copies, benchmark passages, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import materialise, scratch_scope
from quarry.llm.decontaminate import without_contaminated
from quarry.llm.exact_dedup import without_copies
from quarry.llm.language import with_known_language
from quarry.llm.near_dedup import Rule, without_near_copies
from quarry.llm.pieces import encode_pieces
from quarry.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is accepted."""
    return with_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, that with the largest id."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest id."""
    return without_near_copies(docs, Rule(shingle=5, percent=80))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't contaminated by the benchmark."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces (doc_id, n_pieces, score, round_trip and digests of ids, text and the n best)."""
    return encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"), digests=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("pieces", pieces)]
#: Language posteriors, near-copy search and piece lattices have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written and read again.

    Once a stage's table is written, the one before it and all that the stage wrote on its way go.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as paths:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            own = paths.pop()
            paths += before
        before = [own]
    return STAGES[-1][1](spark, docs, sf_dir)
