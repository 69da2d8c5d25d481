"""Modes of search over chunks, embeddings, sparse weights and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import snippet
from quarry.operators import fusion, keyword, postings, sparse, vector
from quarry.plugins import EmbeddingModel
from quarry.schema import RESULTS, SearchMode, SearchQuery

#: Rows of an ordered take up to which it is broadcast; more are joined by an exchange.
BROADCAST_ROWS = 10_000


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _vector_arm(tables: dict[str, DataFrame], query: list[float], k: int, scale: str, model_id: str, index: vector.InvertedFile | None = None) -> DataFrame:
    """The best chunk ids and scores, from an index if there is one; contents are fetched for those alone."""
    if index is not None:
        return index.search(query, k, scale=scale).select("chunk_id", "score")
    return vector.top_k(tables["embeddings"].where(F.col("model_id") == model_id), query, k, scale=scale).select("chunk_id", "score")


def image_hits(tables: dict[str, DataFrame], query: SearchQuery, model: EmbeddingModel) -> DataFrame:
    """The best images of an image model, scored by cosine."""
    k = fusion.image_fetch(query.limit + query.offset, SearchMode.of(query.mode).value)
    return _with_chunks(_vector_arm(tables, model.embed_query(query.text), k, "cosine", model.model_id), tables["chunks"], k)


def _with_chunks(best: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """best, k rows at most, with the chunks' columns."""
    return chunks.join(_small(best, k), "chunk_id").withColumn("snippet", snippet(F.col("content"))).select("chunk_id", "file_id", "chunk_index", "snippet", "score")


def _keyword_arm(tables: dict[str, DataFrame], text: str, weights: dict[int, float] | None, k: int, strict: bool) -> DataFrame:
    if weights is None and "postings" in tables and len(keyword.clean(text)) >= postings.RUN:
        return _with_chunks(postings.best(tables["postings"], text, k, strict=strict), tables["chunks"], k)
    if weights is None:
        return keyword.keyword_search(tables["chunks"], text, k, strict=strict).select("chunk_id", "file_id", "chunk_index", "snippet", "score")
    return _with_chunks(sparse.sparse_search(tables["sparse"], weights, k).select("chunk_id", "score"), tables["chunks"], k)


def search(
    spark: SparkSession, tables: dict[str, DataFrame], query: SearchQuery, model: EmbeddingModel, *, scale: str = "shifted", strict: bool = False,
    pushdown_types: bool = False, images: DataFrame | None = None, index: vector.InvertedFile | None = None,
) -> DataFrame:
    """Rows of RESULTS, best first, ties by chunk.

    Vector mode keeps scores above the floor; keyword mode is BM25, or sparse weights where the
    model has them; hybrid fuses both. Types are filtered after the limit, or before with
    pushdown_types. image_hits (chunk_id, file_id, chunk_index, snippet, score) are merged
    in; an index of the model's vectors stands for the scan unless types are pushed down. A blank query finds nothing.
    """
    if not query.text.strip() or query.limit <= 0:
        return spark.createDataFrame([], RESULTS)
    mode, limit = SearchMode.of(query.mode), query.limit + query.offset
    files = tables["files"]
    if pushdown_types and query.file_types:
        index = None
        files = files.where(F.col("file_type").isin(*query.file_types))
        own = files.select(F.col("id").alias("file_id"))
        chunks = tables["chunks"].join(own, "file_id", "left_semi")
        ids = chunks.select("chunk_id")
        tables = tables | {"chunks": chunks} | {name: tables[name].join(ids, "chunk_id", "left_semi") for name in ("embeddings", "sparse", "postings") if name in tables}
    weights = model.sparse_query(query.text) if "sparse" in tables else None
    if mode is SearchMode.VECTOR:
        k = max(3 * limit, vector.LEAST_FETCH)
        near = _vector_arm(tables, model.embed_query(query.text), k, scale, model.model_id, index)
        hits = _with_chunks(vector.floor_or_fallback(near, limit), tables["chunks"], k)
    elif mode is SearchMode.KEYWORD:
        hits = _keyword_arm(tables, query.text, weights, limit, strict)
    else:
        k = limit * fusion.OVERFETCH
        near = _with_chunks(_vector_arm(tables, model.embed_query(query.text), k, scale, model.model_id, index), tables["chunks"], k)
        hits = fusion.hybrid(near, _keyword_arm(tables, query.text, weights, k, strict), limit, query.vector_weight, query.keyword_weight)
    hits = hits.select("chunk_id", "file_id", "chunk_index", "snippet", "score", F.lit(mode.value).alias("match_type"))
    if images is not None and mode is not SearchMode.KEYWORD:
        hits = fusion.merge_images(hits, images.select("chunk_id", "file_id", "chunk_index", "snippet", "score", F.lit("vector").alias("match_type")), limit, mode.value)
    record = files.select(F.col("id").alias("file_id"), F.struct(*[F.col(c) for c in ("id", "path", "file_type", "size", "modified_at", "indexed_at", "content_hash")]).alias("file_record"))
    rows = record.join(_small(hits, limit), "file_id")
    if query.file_types and not pushdown_types:
        rows = rows.where(F.col("file_record.file_type").isin(*query.file_types))
    return rows.orderBy(F.desc("score"), "chunk_id").offset(query.offset).limit(query.limit).select("file_record", F.col("score").cast("double").alias("score"), "snippet", "match_type", "chunk_index")
