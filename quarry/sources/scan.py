"""Scans of folders into rows of files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths


def scan(spark: SparkSession, root: str, ignore: paths.IgnoreConfig = paths.IgnoreConfig(), with_content: bool = True) -> DataFrame:
    """Supported files below root outside ignored folders: path, file_type, size, modified_at, content, content_hash.

    Ignored folders are never entered. Files are read by Spark's binary file source; one that
    has gone or can't be read is passed over.
    """
    return _rows(spark, list_folder(spark, root, ignore), with_content)


def scan_whole(spark: SparkSession, root: str, ignore: paths.IgnoreConfig = paths.IgnoreConfig(), with_content: bool = True) -> DataFrame:
    """The same rows, listed by Spark's tasks instead of the driver: for trees of very many files of which little is ignored."""
    found = _reader(spark).option("recursiveFileLookup", "true").load(root)
    kept = found.where(paths.is_supported(F.col("path")) & ~ignore.ignored_dir(paths.relative_to(F.col("path"), root)))
    return kept.select(*_columns(with_content))


def _reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")


def _columns(with_content: bool) -> list[Column]:
    columns = [
        F.col("path"), paths.file_type(paths.extension(F.col("path"))).alias("file_type"), F.col("length").alias("size"),
        F.date_trunc("second", F.col("modificationTime")).alias("modified_at"),
    ]
    return columns + ([F.col("content"), F.sha2(F.col("content"), 256).alias("content_hash")] if with_content else [])


def _rows(spark: SparkSession, found: list[str], with_content: bool) -> DataFrame:
    if not found:
        kind = "path string, file_type string, size long, modified_at timestamp" + ", content binary, content_hash string" * with_content
        return spark.createDataFrame([], kind)
    return _reader(spark).option("recursiveFileLookup", "true").load(found).select(*_columns(with_content))


def list_folder(spark: SparkSession, root: str, ignore: paths.IgnoreConfig = paths.IgnoreConfig()) -> list[str]:
    """Paths of supported files, found by walking on the driver; ignored folders are not entered, unreadable ones are passed over."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, open_ = [], [top]
    while open_:
        folder = open_.pop()
        try:
            inside = fs.listStatus(folder)
        except Py4JJavaError:
            if folder is top:
                raise
            continue
        for status in inside:
            name = status.getPath().getName()
            if status.isDirectory():
                if not ignore.skips(name):
                    open_.append(status.getPath())
            elif name.rpartition(".")[2].lower() in {e for exts in paths.PARSED.values() for e in exts}:
                out.append(status.getPath().toString())
    return sorted(out)


def scan_paths(spark: SparkSession, found: list[str]) -> DataFrame:
    """The same rows for stated paths."""
    return _rows(spark, found, True)
