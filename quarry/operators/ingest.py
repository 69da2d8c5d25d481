"""From scanned files to rows of files, chunks, embeddings and sparse weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import is_blank
from quarry.operators.merge import diff
from quarry.plugins import EmbeddingModel
from quarry.sources.parsers import ParserRegistry


def changed_files(scanned: DataFrame, files: DataFrame, salt: str = "") -> DataFrame:
    """Scanned rows that are new or have another hash; a file's id is the hash of its path.

    salt (a model's id) is part of the comparison, so another model indexes all anew.
    """
    marked = scanned.withColumn("content_hash", F.sha2(F.concat("content_hash", F.lit(salt)), 256)) if salt else scanned
    changes = diff(marked, files).where(F.col("change").isin("new", "changed")).select("path")
    return marked.join(changes, "path", "left_semi").withColumn("id", F.sha2("path", 256))


def file_rows(changed: DataFrame) -> DataFrame:
    return changed.select("id", "path", "file_type", "size", "modified_at", F.date_trunc("second", F.current_timestamp()).alias("indexed_at"), "content_hash")


def chunk_rows(changed: DataFrame, registry: ParserRegistry) -> DataFrame:
    """A row a part that isn't blank, numbered after blank ones are gone."""
    parsed = registry.parse(changed.select("id", "path", "content"))
    parts = parsed.select(F.col("id").alias("file_id"), F.posexplode(F.filter("parts", lambda p: ~is_blank(p["text"]))).alias("chunk_index", "part"))
    return parts.select(F.concat_ws(":", "file_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "file_id", "chunk_index", F.col("part.kind").alias("kind"), F.col("part.text").alias("content"))


def embedding_rows(chunks: DataFrame, model: EmbeddingModel, image_model: EmbeddingModel | None = None) -> DataFrame:
    """Vectors of contents; with an image model, parts of images go to that one alone."""

    def of(rows: DataFrame, m: EmbeddingModel) -> DataFrame:
        return rows.select("chunk_id", F.lit(m.model_id).alias("model_id"), F.lit(m.dim).alias("dim"), m.embed(F.col("content")).alias("embedding"))

    if image_model is None:
        return of(chunks, model)
    return of(chunks.where("kind <> 'image'"), model).unionByName(of(chunks.where("kind = 'image'"), image_model))


def sparse_rows(chunks: DataFrame, model: EmbeddingModel) -> DataFrame | None:
    weights = model.sparse(F.col("content"))
    return None if weights is None else chunks.select("chunk_id", F.lit(model.model_id).alias("model_id"), weights.alias("weights"))
