"""Score-aware reciprocal rank fusion and the merging of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Constant of ranks; over-fetch of each arm; floors, factors and cap of image hits.
RANK_K, OVERFETCH = 60.0, 3
IMAGE_FLOOR = {"vector": 0.15, "hybrid": 0.25}
IMAGE_CAP = 8


def ranked(rows: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Adds the rank from 1, by score, ties by key. For lists that are already limited."""
    return rows.withColumn(rank, F.row_number().over(Window.orderBy(F.desc("score"), key)))


def rrf(vector: DataFrame, keyword: DataFrame, limit: int, vector_weight: float = 1.0, keyword_weight: float = 1.0, key: str = "chunk_id", rank: bool = True) -> DataFrame:
    """(key, score) of two short lists (key, score[, rank]): weighted scores over 60 + rank, against the best that can be.

    With rank, lists are ranked by score; else they bring their own ranks.
    """
    arms = []
    for rows, weight in ((vector, vector_weight), (keyword, keyword_weight)):
        own = ranked(rows.select(key, "score"), key) if rank else rows.select(key, "score", "rank")
        arms.append(own.select(key, (F.lit(float(weight)) * F.col("score") / (F.lit(RANK_K) + F.col("rank"))).alias("part")))
    best = (vector_weight + keyword_weight) / (RANK_K + 1)
    best = best if best > 0 else 1.0
    sums = arms[0].unionByName(arms[1]).groupBy(key).agg(F.sum("part").alias("raw"))
    return sums.select(key, F.least(F.greatest(F.col("raw") / F.lit(best), F.lit(0.0)), F.lit(1.0)).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def first_of(lists: list[DataFrame], key: str = "chunk_id") -> DataFrame:
    """All rows of short lists with the same columns; of a key, that of the first list."""
    both = None
    for i, rows in enumerate(lists):
        marked = rows.withColumn("__list", F.lit(i))
        both = marked if both is None else both.unionByName(marked)
    return both.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy("__list"))).where("__nth = 1").drop("__list", "__nth")


def hybrid(vector: DataFrame, keyword: DataFrame, limit: int, vector_weight: float = 1.0, keyword_weight: float = 1.0, key: str = "chunk_id") -> DataFrame:
    """Fused rows with the payload of the vector list first, match_type hybrid."""
    fused = rrf(vector, keyword, limit, vector_weight, keyword_weight, key)
    columns = [c for c in vector.columns if c in keyword.columns and c != "score"]
    payload = first_of([vector.select(*columns), keyword.select(*columns)], key)
    return payload.join(fused, key).withColumn("match_type", F.lit("hybrid"))


def merge_images(text_hits: DataFrame, image_hits: DataFrame, limit: int, mode: str = "hybrid", key: str = "chunk_id") -> DataFrame:
    """Image hits above their floor (a few in hybrid mode) that text didn't find, sorted in among the text hits."""
    good = image_hits.where(F.col("score") >= IMAGE_FLOOR["vector" if mode == "vector" else "hybrid"])
    if mode != "vector":
        good = good.orderBy(F.desc("score"), key).limit(IMAGE_CAP)
    new = good.join(text_hits.select(key), key, "left_anti")
    return text_hits.unionByName(new.select(*text_hits.columns)).orderBy(F.desc("score"), key).limit(limit)


def image_fetch(limit: int, mode: str = "hybrid") -> int:
    return 2 * limit if mode == "vector" else IMAGE_CAP * 4
