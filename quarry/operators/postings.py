"""An index for keyword search: where each run of three characters stands in each chunk.

A term's places are those at which all runs that cover it stand at their distances, so
matches and counts are exact without a look at any text. A query reads the rows of its own
runs, which reach the scan as a filter, and one narrow row a chunk for the corpus statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import keyword
from quarry.schema import POSTINGS

#: Characters of a run, the term of the row that each chunk has whatever it holds, characters that a worker indexes at a time.
RUN, WHOLE, SLICE = 3, -1, 1 << 20
_BITS = 21


def gram(run: str) -> int:
    """The number of a run of three characters."""
    return sum(ord(c) << _BITS * (RUN - 1 - i) for i, c in enumerate(run))


def build(chunks: DataFrame, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """(key, term, length, places) of each run in each chunk, and one row of term WHOLE a chunk. Keys are unique.

    length is that of BM25: runs in the chunk. Null contents have none.
    """
    rows = chunks.select(F.col(key), F.lower(F.coalesce(F.col(content), F.lit(""))).alias("text"))
    return rows.mapInArrow(_rows, T.StructType([rows.schema[0], *[POSTINGS[c] for c in ("term", "length", "places")]]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        n_chars = np.array([len(t) for t in texts], np.int64)
        # a slice is as many texts as have SLICE characters together, one at least
        slices = np.cumsum(n_chars) // SLICE
        bounds = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(texts)]
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                yield from _slice(batch.column(0).slice(a, b - a), batch.schema.names[0], texts[a:b], n_chars[a:b])


def _slice(keys: pa.Array, name: str, texts: list[str], n_chars: np.ndarray) -> Iterator[pa.RecordBatch]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    runs = np.maximum(n_chars - RUN + 1, 0)
    owner = np.repeat(np.arange(len(texts)), runs)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = np.repeat(np.cumsum(n_chars) - n_chars, runs) + place
    term = np.zeros(len(at), np.int64)
    for i in range(RUN):
        term = term << _BITS | codes[at + i]
    order = np.lexsort((term, owner))  # stable: places ascend
    owner, term, place = owner[order], term[order], place[order]
    heads = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])]) if len(order) else np.zeros(0, np.int64)

    def rows(of: np.ndarray, terms: np.ndarray, ends: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(terms, pa.int64()), pa.array(runs[of], pa.int32()), lists], names=[name, "term", "length", "places"])

    yield rows(np.arange(len(texts)), np.full(len(texts), WHOLE), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64))
    if len(heads):
        yield rows(owner[heads], term[heads], np.r_[heads, len(order)], place)


def _cover(term: str) -> list[int]:
    """Where the runs begin that cover a term."""
    return sorted({*range(0, len(term) - RUN + 1, RUN), len(term) - RUN})


def _occurrences(term: str, places: dict[int, Column]) -> Column:
    def starts(o: int) -> Column:
        return F.transform(places[gram(term[o : o + RUN])], lambda x: x - F.lit(o))

    return F.coalesce(F.size(reduce(F.array_intersect, map(starts, _cover(term)))), F.lit(0))


def bm25(postings: DataFrame, query: str, key: str = "chunk_id", strict: bool = False) -> DataFrame:
    """(key, bm25) of the rows that match, as keyword.bm25 finds them."""
    tree = keyword.parse(keyword.clean(query), strict)
    if tree is None:
        return postings.limit(0).select(key, F.lit(0.0).alias("bm25"))
    terms = sorted(set(tree.terms()))
    asked = sorted({gram(t[o : o + RUN]) for t in terms for o in _cover(t)})
    # a chunk has one row a run, so the largest is the only one
    found = postings.where(F.col("term").isin(asked)).groupBy(key).agg(F.max("length").alias("__d"), *[F.max(F.when(F.col("term") == g, F.col("places"))).alias(f"__g{i}") for i, g in enumerate(asked)])
    places = {g: F.col(f"__g{i}") for i, g in enumerate(asked)}
    counted = found.select(key, "__d", F.array(*[_occurrences(t, places) for t in terms]).alias("__f"))
    whole = postings.where(F.col("term") == WHOLE).agg(F.count("*").alias("n"), F.avg("length").alias("avg")).first()
    have = counted.agg(*[F.sum((F.col("__f")[i] > 0).cast("long")).alias(f"n{i}") for i in range(len(terms))]).first()
    return keyword.scored(counted, tree, terms, whole.n, whole.avg, list(have))


def best(postings: DataFrame, query: str, limit: int, key: str = "chunk_id", strict: bool = False) -> DataFrame:
    """(key, score) of the best rows, ties by key, for queries of three characters or more when cleaned."""
    rows = bm25(postings, query, key, strict).orderBy("bm25", key).limit(limit)
    return rows.select(key, keyword.to_score(F.col("bm25")).alias("score"))
