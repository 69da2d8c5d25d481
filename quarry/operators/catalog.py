"""Queries over the files and chunks tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get_file(files: DataFrame, file_id: str | None = None, path: str | None = None) -> DataFrame:
    return files.where(F.col("id") == file_id) if file_id is not None else files.where(F.col("path") == path)


def chunks_of(chunks: DataFrame, file_id: str) -> DataFrame:
    return chunks.where(F.col("file_id") == file_id).orderBy("chunk_index")


def list_files(files: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page, latest first, ties by id."""
    return files.orderBy(F.desc("indexed_at"), "id").offset(offset).limit(limit)


def count_in_dir(files: DataFrame, folder: str) -> DataFrame:
    """Files below a folder, by exact prefix."""
    return files.where(F.startswith(F.col("path"), F.lit(folder.rstrip("/") + "/"))).agg(F.count("*").alias("n_files"))


def files_by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count("*").alias("n_files"))


def stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: total_files, total_chunks, files_by_type, index_size_bytes (of all contents)."""
    by_type = files_by_type(files).agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("total_files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_type", "n_files")))).alias("files_by_type"))
    held = chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("index_size_bytes"))
    # two rows of totals, side by side
    return by_type.withColumn("one", F.lit(1)).join(held.withColumn("one", F.lit(1)), "one").select("total_files", "total_chunks", "files_by_type", "index_size_bytes")


def with_chunks(embeddings: DataFrame, chunks: DataFrame, dim: int | None = None) -> DataFrame:
    """Embeddings with their chunks' columns, of one dimension if asked for."""
    rows = embeddings if dim is None else embeddings.where(F.size("embedding") == dim)
    return rows.join(chunks, "chunk_id")


def list_models(models: DataFrame) -> DataFrame:
    return models.orderBy("model_id")
