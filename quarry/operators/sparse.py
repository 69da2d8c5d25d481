"""Sparse lexical search over maps or postings of token weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import sparse_dot


def sparse_search(rows: DataFrame, query: dict[int, float], limit: int, key: str = "chunk_id", weights: str = "weights") -> DataFrame:
    """Rows with a positive product, best first, with raw and score = raw / (raw + 1)."""
    scored = rows.withColumn("raw", sparse_dot(F.col(weights), query)).where("raw > 0")
    best = scored.orderBy(F.desc("raw"), key).limit(limit if query else 0)
    return best.withColumn("score", to_score(F.col("raw")))


def to_score(raw: Column) -> Column:
    return raw / (raw + 1.0)


def postings(rows: DataFrame, key: str = "chunk_id", weights: str = "weights") -> DataFrame:
    """(token_id, key, weight): what an inverted index holds."""
    return rows.select(key, F.explode(weights).alias("token_id", "weight"))


def search_postings(index: DataFrame, query: dict[int, float], limit: int, key: str = "chunk_id") -> DataFrame:
    """The same from postings: the query's tokens reach the scan as a filter; sums combine before the exchange."""
    if not query:
        return index.limit(0).select(key, F.lit(0.0).alias("raw"), F.lit(0.0).alias("score"))
    q = F.create_map(*[F.lit(x) for t, w in sorted(query.items()) for x in (int(t), float(w))])
    sums = index.where(F.col("token_id").isin(*query)).groupBy(key).agg(F.sum(F.col("weight").cast("double") * F.element_at(q, F.col("token_id"))).alias("raw"))
    return sums.where("raw > 0").orderBy(F.desc("raw"), key).limit(limit).withColumn("score", to_score(F.col("raw")))


def max_pool(tokens: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Maps of the largest positive weight of each token id. tokens: (key, token_id, weight)."""
    best = tokens.where("weight > 0").groupBy(key, "token_id").agg(F.max("weight").alias("weight"))
    return best.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token_id", "weight")))).alias("weights"))
