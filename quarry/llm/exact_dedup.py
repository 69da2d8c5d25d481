"""Exact deduplication by skew-safe combining.

Three stages, each of which compares whole contents and not only digests:

1. local: each task keeps a bounded table of the texts it has seen and emits one row a
   distinct text with the ids of its copies; the table is flushed when it is full;
2. salted: local rows of a digest are dealt by (digest, salt), so a hot text meets in
   as many tasks as there are salts, and equal contents are merged;
3. global: the winners of the salts (at most one row a salt and text) are merged.

The winner then travels down the same edges to the local rows, whose id lists are
expanded. A salted group is named by the least place of its local rows, so that texts which
share a digest, and ids or the lack of them, stay apart. No task ever holds a whole group of copies: a local row is bounded by the
flush, a salted group by its salt, a global group by the number of salts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import ascii_lower, column, lowered, partitions, release, row_of, rows_back, with_field

#: A task's table of distinct texts is flushed beyond either.
FLUSH_BYTES, FLUSH_ROWS = 16 << 20, 20_000


def sha256_hex(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _combine(digest: Callable[[bytes], str], id_type: pa.DataType, flush_bytes: int, flush_rows: int) -> Callable:
    schema = pa.schema([("ids", pa.list_(id_type)), ("digest", pa.string()), ("content", pa.binary()), ("place", pa.int64())])

    def out(table: dict[str, list[tuple[bytes, list]]], places: Iterator[int]) -> Iterator[pa.RecordBatch]:
        rows = [(ids, d, content, next(places)) for d, variants in table.items() for content, ids in variants]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table: dict[str, list[tuple[bytes, list]]] = {}
        size = rows = 0
        places = count(TaskContext.get().partitionId() << 40)  # of the rows that go out
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = ascii_lower(text.as_py())
                rows += 1
                variants = table.setdefault(digest(content), [])
                for known, ids in variants:
                    if known == content:
                        ids.append(doc_id)
                        break
                else:
                    variants.append((content, [doc_id]))
                    size += len(content)
                if size > flush_bytes or rows >= flush_rows:
                    yield from out(table, places)
                    table, size, rows = {}, 0, 0
        yield from out(table, places)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: Callable[[bytes], str] = sha256_hex, salts: int | None = None, flush_bytes: int = FLUSH_BYTES, flush_rows: int = FLUSH_ROWS) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The largest id of a group
    stays. Null text counts as empty; an empty table gives an empty result. Null ids
    are members but never winners while another id is there; a group of null ids alone
    has keep_id null and its rows are kept. A repeated row (same id and text) counts
    again in group_size, and all its repeats say the same. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[kind]
    n = salts or max(8, partitions(spark))
    local = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(
        _combine(digest, arrow, flush_bytes, flush_rows),
        T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("digest", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("place", T.LongType())]),
    )
    # both uses of the merged rows below keep the same columns and filters up to their
    # exchange, so that Spark runs that exchange, the one that moves all texts, only once
    salted = local.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(n))).where("digest IS NOT NULL AND salt IS NOT NULL")
    equal = Window.partitionBy("digest", "salt", "content")
    merged = (
        salted.withColumn("nth", F.row_number().over(equal.orderBy("place")))
        .withColumn("top", F.max(F.array_max("ids")).over(equal))
        .withColumn("group", F.min("place").over(equal))
        .withColumn("copies", F.sum(F.size("ids").cast("long")).over(equal))
    )
    winners = merged.where("nth = 1").select(F.col("digest").alias("w_digest"), F.col("salt").alias("w_salt"), F.col("group").alias("w_group"), F.col("top").alias("w_top"), "copies", "content")
    across = Window.partitionBy("w_digest", "content")
    final = winners.select("w_digest", "w_salt", "w_group", F.max("w_top").over(across).alias("keep_id"), F.sum("copies").over(across).alias("group_size"))
    members = merged.where("nth > 0").select("digest", "salt", "group", "ids")
    joined = members.join(final, (F.col("digest") == F.col("w_digest")) & (F.col("salt") == F.col("w_salt")) & (F.col("group") == F.col("w_group")))
    rows = joined.select(F.explode("ids").alias("id"), "keep_id", "group_size", "digest")
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def _best_rows(digest: Callable[[bytes], str], id_at: int, text_at: int, rows_at_once: int = 2048) -> Callable:
    """Of the equal texts of some neighbouring rows, the row with the largest id; places are those of the row's columns."""

    def best_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        best: dict[str, list[tuple[bytes, int]]] = {}
        ids = batch.column(0).field(id_at).to_pylist()
        for i, text in enumerate(batch.column(0).field(text_at)):
            content = ascii_lower(text.as_py())
            variants = best.setdefault(digest(content), [])
            for k, (known, j) in enumerate(variants):
                if known == content:
                    if ids[j] is None or ids[i] is not None and ids[i] > ids[j]:
                        variants[k] = (known, i)
                    break
            else:
                variants.append((content, i))
        rows = [(i, d) for d, variants in best.items() for _, i in variants]
        kept = batch.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
        return pa.RecordBatch.from_arrays([kept, pa.array([d for _, d in rows], pa.string())], names=["row", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                yield best_of(batch.slice(at, rows_at_once))

    return run


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: Callable[[bytes], str] = sha256_hex, salts: int | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps; of a repeated row one.

    The same three stages on whole rows: the best of a batch, of a salt, of all; texts
    are compared anew in each. Nothing is joined, since only winners go on. Columns of docs
    can have any names and types.
    """
    n = salts or max(8, partitions(docs.sparkSession))
    rows = row_of(docs)
    places = docs.columns.index(id_col), docs.columns.index(text_col)
    local = rows.mapInArrow(_best_rows(digest, *places), with_field(rows.schema["row"].dataType, "row", ("digest", T.StringType())))
    top, content = F.desc_nulls_last(F.col("row")[id_col]), lowered(F.col("row")[text_col])

    def winners(rows: DataFrame, *keys: str) -> DataFrame:
        ranked = rows.withColumn("content", content).withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "content").orderBy(top)))
        return ranked.where("nth = 1").select("row", "digest")

    salted = local.withColumn("salt", F.pmod(F.xxhash64(F.col("row")[id_col]), F.lit(n)))
    first = winners(salted.repartition("digest", "salt"), "digest", "salt")
    return rows_back(winners(first.repartition("digest"), "digest"))
