"""Nearest vectors: exact, and by an inverted file of k-means cells with exact scores."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vectors as V

#: Vectors from which search is approximate, floor of vector mode and rows below it, least fetched.
ANN_FROM, FLOOR, FALLBACK, LEAST_FETCH = 2000, 0.45, 5, 30
#: Cells of the inverted file at most, rows of the sample for each at least, and the recall that the number of cells read is chosen for.
MOST_CELLS, LEAST_CELL, RECALL = 1024, 8, 0.95
#: Queries that are broadcast together.
QUERY_BLOCK = 10_000


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "embedding", scale: str = "shifted") -> DataFrame:
    """The k best of the query's dimension with score, ties by key.

    The query is a literal: a scan, a projection and an ordered take, no join.
    """
    if not query or k <= 0:
        return vectors.limit(0).withColumn("score", F.lit(0.0))
    same = vectors.where(F.size(vector) == len(query))
    return same.withColumn("score", V.score(V.dot(F.col(vector), V.literal(query)), scale)).orderBy(F.desc("score"), key).limit(k)


def _best(scored: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    """k rows a query; Spark limits each task's rows to k a query before the exchange."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, query_key: str, query_vector: str, block: int) -> list[DataFrame]:
    """The queries, (query_key, __q, __dim), in parts that may be broadcast: of some block queries each."""
    n = -(-queries.count() // block) or 1
    own = queries.select(query_key, F.col(query_vector).alias("__q"), F.size(query_vector).alias("__dim"))
    return [own] if n == 1 else [own.where(F.pmod(F.xxhash64(query_key), F.lit(n)) == i) for i in range(n)]


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query", block: int = QUERY_BLOCK) -> DataFrame:
    """The k best rows of each query, (query_key, key, score, rank).

    Queries are a stated set and never come to the driver. They are broadcast, in blocks of a
    bounded number, and join vectors by dimension; k rows a query leave each task.
    """
    rows = vectors.select(key, F.col(vector).alias("__v"), F.size(vector).alias("__dim"))
    met = [rows.join(F.broadcast(q), "__dim").select(query_key, key, V.dot(F.col("__v"), F.col("__q")).alias("score")) for q in _blocks(queries, query_key, query_vector, block)]
    return reduce(DataFrame.unionByName, [_best(m, k, query_key, key) for m in met])


def top_k_by_group(vectors: DataFrame, query: list[float], k: int, group: str, key: str = "chunk_id", vector: str = "embedding", scale: str = "shifted") -> DataFrame:
    """The k best of each group, with score and rank."""
    scored = vectors.where(F.size(vector) == len(query)).withColumn("score", V.score(V.dot(F.col(vector), V.literal(query)), scale))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def floor_or_fallback(ranked: DataFrame, limit: int, key: str = "chunk_id", floor: float = FLOOR, fallback: int = FALLBACK) -> DataFrame:
    """Of a few ranked rows, those with the floor's score up to limit; if there are none, the first few."""
    w = Window.orderBy(F.desc("score"), key)
    marked = ranked.withColumn("__nth", F.row_number().over(w)).withColumn("__top", F.max("score").over(Window.partitionBy()))
    some = F.col("__top") >= floor
    kept = marked.where((some & (F.col("score") >= floor) & (F.col("__nth") <= limit)) | (~some & (F.col("__nth") <= min(fallback, limit))))
    return kept.drop("__nth", "__top")


def vector_search(vectors: DataFrame, query: list[float], limit: int, key: str = "chunk_id", vector: str = "embedding", scale: str = "shifted") -> DataFrame:
    """Vector mode: over-fetched top rows above the floor, or a few below it."""
    return floor_or_fallback(top_k(vectors, query, max(3 * limit, LEAST_FETCH), key, vector, scale), limit, key)


@dataclass
class InvertedFile:
    """Every vector under its nearest of a bounded number of centroids.

    There are about as many cells as the root of the rows, MOST_CELLS at most. Centroids are
    fitted on a bounded sample (sample_rows, by hash order); all rows are assigned. How many
    cells a query reads is the least number that found RECALL of the true neighbours of a
    sample of rows.
    """

    cells: DataFrame
    centroids: np.ndarray
    key: str
    vector: str
    probes: int = 1

    @classmethod
    def build(cls, vectors: DataFrame, dim: int, n_cells: int | None = None, sample_rows: int = 20_000, seed: int = 7, key: str = "chunk_id", vector: str = "embedding", path: str | None = None, probes: int | None = None) -> InvertedFile:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        same = vectors.where(F.size(vector) == dim)
        n = same.count()
        sample = same.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.xxhash64(key).alias("h")).orderBy("h").limit(min(n, sample_rows))
        k = min(n_cells or max(1, min(MOST_CELLS, round(n**0.5))), min(n, sample_rows) // LEAST_CELL)
        if k > 1:
            centroids = np.array([list(c) for c in KMeans(k=k, seed=seed, maxIter=10).fit(sample.select("features")).clusterCenters()])
        else:
            centroids = np.zeros((1, dim))
        index = cls(same, centroids, key, vector, len(centroids))
        index.cells = same.withColumn("cell", F.element_at(index.nearest(F.col(vector), 1), 1))
        if path:
            index.cells.write.mode("overwrite").partitionBy("cell").parquet(path)
            index.cells = vectors.sparkSession.read.parquet(path)
        index.probes = probes or index.measured_probes()
        return index

    def nearest(self, value: Column, n: int) -> Column:
        """array<int>: the n nearest cells of each vector, nearest first; the centroids travel with the function."""
        centroids, half = self.centroids, (self.centroids**2).sum(1) / 2

        @F.arrow_udf("array<int>")
        def cells(vectors: pa.Array) -> pa.Array:
            rows = np.array(vectors.to_pylist(), np.float64).reshape(len(vectors), centroids.shape[1])
            order = np.argsort(half - rows @ centroids.T, axis=1, kind="stable")[:, :n].astype(np.int32)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * order.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.reshape(-1)))

        return cells(value)

    def measured_probes(self, k: int = 10, asked: int = 64) -> int:
        """The least number of cells that holds RECALL of the k nearest rows of a sample of rows, by brute force."""
        if len(self.centroids) == 1:
            return 1
        rows = self.cells.select(F.col(self.key).alias("query_id"), F.col(self.vector).alias("query"))
        sample = rows.orderBy(F.xxhash64("query_id", F.lit("asked"))).limit(asked)
        true = batch_top_k(self.cells, sample, k, self.key, self.vector).join(self.cells.select(self.key, "cell"), self.key)
        order = sample.select("query_id", self.nearest(F.col("query"), len(self.centroids)).alias("order"))
        places = [r.place for r in true.join(order, "query_id").select(F.array_position("order", F.col("cell")).alias("place")).collect()]  # k a row of the sample
        return int(np.sort(places)[max(0, math.ceil(RECALL * len(places)) - 1)]) if places else 1

    def probe(self, query: list[float], n: int | None = None) -> list[int]:
        scores = (self.centroids**2).sum(1) / 2 - self.centroids @ np.array(query, np.float64)
        return np.argsort(scores, kind="stable")[: n or self.probes].tolist()

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None, query_key: str = "query_id", query_vector: str = "query", block: int = QUERY_BLOCK) -> DataFrame:
        """(query_key, key, score, rank): a stated set of queries, broadcast in blocks, each against the rows of its cells."""
        rows = self.cells.select(self.key, F.col(self.vector).alias("__v"), "cell")
        parts = [q.withColumn("cell", F.explode(self.nearest(F.col("__q"), probes or self.probes))) for q in _blocks(queries, query_key, query_vector, max(1, block // (probes or self.probes)))]
        met = [rows.join(F.broadcast(q), "cell").select(query_key, self.key, V.dot(F.col("__v"), F.col("__q")).alias("score")) for q in parts]
        return reduce(DataFrame.unionByName, [_best(m, k, query_key, self.key) for m in met])

    def search(self, query: list[float], k: int, probes: int | None = None, scale: str = "cosine") -> DataFrame:
        """Exact scores of all rows in the nearest cells; a partitioned index reads those cells alone."""
        return top_k(self.cells.where(F.col("cell").isin(*self.probe(query, probes))), query, k, self.key, self.vector, scale).drop("cell")


def use_ann(n_vectors: int, mode: str = "auto") -> bool:
    """mode: auto, force or off."""
    return mode == "force" or mode == "auto" and n_vectors >= ANN_FROM
