"""What the training-data operators share: text rules, scratch tables, skew-safe joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

V = TypeVar("V")
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: Bytes that part words of the form [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased; the rest of ASCII becomes a space.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b) in string.digits + LOWER else 0x20 for b in range(256))
#: The same for words of the form [^\x20\x09-\x0D]+.
SPACE_BYTES = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))


#: Words of which a worker remembers hashes, and their bytes at most.
HASH_WORDS, HASH_BYTES = 500_000, 48
#: Rows below which no key is worth salting.
HOT_ROWS = 16


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z alone lower-cased; null counts as empty. bytes.lower() touches ASCII only."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII digits, a-z and non-ASCII characters."""
    return ascii_lower(text).translate(WORD_BYTES).split()


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return ascii_lower(text).translate(SPACE_BYTES).split()


def chunks_of(texts: pa.Array, chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters; never more of a batch than that stands in memory as Python strings."""
    part, n = [], 0
    for at in range(0, len(texts), 64):
        for t in texts.slice(at, 64).to_pylist():
            part.append(t)
            n += len(t or "")
            if n >= chars:
                yield part
                part, n = [], 0
    if part:
        yield part


class WordHashes(dict):
    """64-bit hashes of words, never 0; short words are remembered, the rest never stay."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) or 1
        if len(word) <= HASH_BYTES:
            if len(self) >= HASH_WORDS:
                self.clear()
            self[word] = value
        return value


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], V]) -> V:
    """What a Python worker keeps from task to task: the state of one operator, so that those of several never add up."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Gives back what another operator has kept."""
    held(None, lambda: None)


def lowered(col: Column | str) -> Column:
    """A-Z lower-cased in the JVM; null counts as empty."""
    return F.translate(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, as a whole URI.

    Only a local session, where all tasks share this machine's disks, gets one of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarry-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return qualified(spark, root).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Spark itself would give it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the session ends."""
    path = f"{scratch_root(spark)}/quarry-{uuid.uuid4().hex}-{label}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    for paths in _SCOPES:
        paths.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Yields the paths that scratch_path() gives out within; at its end those still in the list are deleted."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.pop()  # scopes end in the order opposite to their begin
        for path in paths:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: written once as Parquet in the shared folder, so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes a table that materialise() wrote, once a later one replaces it."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(docs: DataFrame) -> DataFrame:
    """Whole rows as the struct "row", so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*map(column, docs.columns)).alias("row"))


def rows_back(judged: DataFrame) -> DataFrame:
    """What row_of() took: the fields of "row" as columns."""
    names = judged.schema["row"].dataType.names
    return judged.select(*[F.col("row")[name].alias(name) for name in names])


def with_field(kind: T.DataType, name: str, *more: tuple[str, T.DataType]) -> T.StructType:
    """A schema of one column of any type, and more of the given types."""
    return T.StructType([T.StructField(name, kind), *(T.StructField(n, k) for n, k in more)])


#: Bits of a bitmap's row, and rows of a bitmap at most (32 MB in all).
BITMAP_BITS, BITMAP_ROWS = 1 << 15, 1 << 13


def likely(rows: DataFrame, key: str, wanted: DataFrame, n: int) -> DataFrame:
    """Rows whose key is among some n wanted ones (a column of that name), and a few others: to be joined with them afterwards.

    A bitmap of the wanted keys' hashes, of 16 bits a key and 32 MB at most, goes to all
    tasks, so that what is not wanted is dropped where it is read and never shuffled.
    """
    size = 1
    while size < BITMAP_ROWS and size * BITMAP_BITS < 16 * n:
        size *= 2
    place = F.pmod(F.xxhash64(key), F.lit(size * BITMAP_BITS))
    row, bit = F.floor(place / BITMAP_BITS).cast("int"), F.pmod(place, F.lit(BITMAP_BITS))
    maps = wanted.select(row.alias("__map"), bit.alias("__bit")).groupBy("__map").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    octet = F.conv(F.hex(F.expr("substring(__bits, CAST(__bit DIV 8 + 1 AS int), 1)")), 16, 10).cast("int")
    met = rows.withColumns({"__map": row, "__bit": bit}).join(F.broadcast(maps), "__map")
    return met.where(F.getbit(octet, F.pmod("__bit", F.lit(8)).cast("int")) == 1).drop("__map", "__bit", "__bits")


def hot_keys(counts: DataFrame, total: int, salts: int, n: str = "n") -> list:
    """Keys (first column) with more than a quarter of a task's share of the rows: at most four a task."""
    most = max(HOT_ROWS, total // (4 * salts))
    found = counts.where((F.col(n) > most) & F.col(counts.columns[0]).isNotNull()).orderBy(F.desc(n)).limit(4 * salts).select(counts.columns[0]).collect()
    return [bytes(k) if isinstance(k, bytearray) else k for (k,) in found]


def send_back(rows: DataFrame, key: str, facts: DataFrame, hot: list | None = None, salts: int | None = None) -> DataFrame:
    """Joins rows with facts (one row a key, no null) though a key may hold most of the rows.

    A hot key's rows are dealt over all salts by their place, so that repeated rows part
    too, and its fact goes to each salt; other keys have one salt. Keys are counted unless
    hot names those that hold many rows (see hot_keys).
    """
    n = salts or max(8, partitions(rows.sparkSession))
    if hot is None:
        hot = hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), rows.count(), n)
    if not hot:
        return rows.join(facts, key)
    is_hot, one = F.col(key).isin(hot), F.lit(0).cast("long")
    place = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(n))).otherwise(one)
    every = F.when(is_hot, F.sequence(one, F.lit(n - 1).cast("long"))).otherwise(F.array(one))
    return rows.withColumn("__salt", place).join(facts.withColumn("__salt", F.explode(every)), [key, "__salt"]).drop("__salt")
