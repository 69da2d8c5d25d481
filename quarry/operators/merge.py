"""Changes of tables: differences by hash, keyed merges, deletes that cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables that hang on a file by its chunks.
DEPENDENT = ("embeddings", "sparse", "postings")


def diff(scanned: DataFrame, known: DataFrame, key: str = "path", hash_col: str = "content_hash", full_sync: bool = False) -> DataFrame:
    """(key, change): new, changed or unchanged; with full_sync also deleted for what the scan no longer finds."""
    a = scanned.select(F.col(key), F.col(hash_col).alias("new_hash"), F.lit(True).alias("here"))
    b = known.select(F.col(key), F.col(hash_col).alias("old_hash"), F.lit(True).alias("there"))
    both = a.join(b, key, "full_outer" if full_sync else "left")
    change = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull(), "new").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows inserted or put in the place of those with their keys."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def replace_files(tables: dict[str, DataFrame], new: dict[str, DataFrame], file_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables in which all that belonged to some files (file_id) is replaced, so a file that shrank leaves nothing behind."""
    left = delete_files(tables, file_ids)
    return {name: left[name].unionByName(new[name].select(*left[name].columns)) if name in new else left[name] for name in tables}


def delete_files(tables: dict[str, DataFrame], file_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without some files (file_id), their chunks, embeddings and sparse weights."""
    gone = file_ids.select("file_id").distinct()
    out = dict(tables)
    out["files"] = tables["files"].join(gone, tables["files"]["id"] == gone["file_id"], "left_anti")
    out["chunks"] = tables["chunks"].join(gone, "file_id", "left_anti").select(*tables["chunks"].columns)
    for name in DEPENDENT:
        if name in tables:
            chunk_ids = tables["chunks"].join(gone, "file_id", "left_semi").select("chunk_id")
            out[name] = tables[name].join(chunk_ids, "chunk_id", "left_anti").select(*tables[name].columns)
    return out
