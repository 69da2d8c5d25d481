"""Versioned tables in buckets: a batch writes new folders for the buckets that it touches, then one file names what counts.

All that belongs to a file lies in the same bucket of each table, by hash of the file's id.
Readers see whole versions only; a batch that fails leaves the old one in place. The
last versions are kept for readers that still use them. Of two writers that begin from the
same version, one fails.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import ConcurrentChange
from quarry.schema import TABLES

#: Versions that stay; buckets of a new store; seconds after which a writer that never ended is passed over.
KEEP, BUCKETS, STALE = 3, 64, 3600.0
#: The file that a row belongs to.
FILE_OF = {"files": "id", "chunks": "file_id", "embeddings": "substring_index(chunk_id, ':', 1)", "sparse": "substring_index(chunk_id, ':', 1)", "postings": "substring_index(chunk_id, ':', 1)"}
#: Columns that rows are sorted by within files, so that a filter on them reads few pages.
SORTED_BY = {"files": "path", "chunks": "chunk_id", "postings": "term"}


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        layout = f"{self.root}/layout.json"
        if not self._fs.exists(self._path(layout)):
            self._write_json(layout, {"buckets": buckets})
        self.buckets: int = self._read_json(layout)["buckets"]

    def _read_json(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write_json(self, path: str, value: dict) -> None:
        temporary = self._path(f"{path}.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if not self._fs.rename(temporary, self._path(path)):
            raise OSError(f"can't write {path}")

    def setting(self, name: str) -> str | None:
        """A stored choice, if there is one."""
        path = f"{self.root}/settings/{name}.json"
        return self._read_json(path)["value"] if self._fs.exists(self._path(path)) else None

    def set(self, name: str, value: str) -> None:
        path = f"{self.root}/settings/{name}.json"
        self._fs.mkdirs(self._path(f"{self.root}/settings"))
        self._fs.delete(self._path(path), False)
        self._write_json(path, {"value": value})

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(self._path(f"{self.root}/versions")) if s.getPath().getName().endswith(".json") and s.getPath().getName()[:-5].isdigit())

    def current(self) -> dict[str, dict[str, str]]:
        """Folders of the tables' buckets, relative to the root, as of the last version."""
        v = self.versions()
        return self._read_json(self._version(v[-1])) if v else {}

    def _version(self, n: int) -> str:
        return f"{self.root}/versions/{n:012d}.json"

    def bucket(self, file_id: str) -> Column:
        """The bucket of an expression that gives a file's id."""
        return F.pmod(F.xxhash64(F.expr(file_id)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, file_ids: DataFrame) -> list[int]:
        """Buckets of some files (file_id): at most one row a bucket."""
        return sorted(r.b for r in file_ids.select(self.bucket("file_id").alias("b")).distinct().collect())

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        folders = self.current().get(name, {})
        paths = [f"{self.root}/{f}" for b, f in sorted(folders.items()) if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true").parquet(*paths)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def write(self, tables: dict[str, DataFrame], buckets: list[int] | None = None) -> None:
        """Writes some tables, whole or the stated buckets of them, and makes them count, all at once."""
        v = self.versions()
        folders = self._read_json(self._version(v[-1])) if v else {}
        n = v[-1] + 1 if v else 0
        self._claim(n)
        try:
            for name, rows in tables.items():
                folder = f"data/{name}-{uuid.uuid4().hex}"
                number = self.bucket(FILE_OF[name]) if name in FILE_OF else F.lit(0)
                dealt = rows.select(*TABLES[name].fieldNames(), number.alias("bucket")).hint("rebalance", "bucket")
                dealt.sortWithinPartitions("bucket", *([SORTED_BY[name]] if name in SORTED_BY else [])).write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
                kept = {b: f for b, f in folders.get(name, {}).items() if buckets is not None and int(b) not in buckets}
                made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.isDirectory()]
                folders[name] = kept | {m.partition("=")[2]: f"{folder}/{m}" for m in made if m.startswith("bucket=")}
            self._write_json(self._version(n), folders)
        finally:
            self._fs.delete(self._path(self._version(n) + ".claim"), False)
        self._prune()

    def _claim(self, n: int) -> None:
        """Makes this writer the only one of version n."""
        claim = self._path(self._version(n) + ".claim")
        if self._fs.exists(claim) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > STALE:
            self._fs.delete(claim, False)
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError as e:
            raise ConcurrentChange(f"another writer is at version {n}") from e
        if self._fs.exists(self._path(self._version(n))):
            self._fs.delete(claim, False)
            raise ConcurrentChange(f"another writer has made version {n}")

    def _prune(self) -> None:
        """Deletes what only versions before the last ones name."""
        v = self.versions()
        of = lambda n: {f for folders in self._read_json(self._version(n)).values() for f in folders.values()}
        live = set().union(*map(of, v[-KEEP:]))
        for n in v[:-KEEP]:
            for folder in of(n) - live:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)
                above = folder.rpartition("/")[0]
                if not any(f.startswith(above + "/") for f in live):
                    self._fs.delete(self._path(f"{self.root}/{above}"), True)
            self._fs.delete(self._path(self._version(n)), False)
