"""Parsers of files and their registry."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import UnsupportedFileType
from quarry.functions import paths
from quarry.functions import text as tf
from quarry.plugins import ChunkStrategy, Code, FileParser, Markdown, Transcriber
from quarry.sources import images, pdf

PARTS = "array<struct<kind:string,text:string>>"


def _part(kind: str, text: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text"))).cast(PARTS)


def _texts(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"))).cast(PARTS)


def decode_text(content: Column) -> Column:
    """UTF-8, broken bytes as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


class TextParser(FileParser):
    extensions = tuple(paths.PARSED["text"])

    def __init__(self, strategies: dict[str, ChunkStrategy] | None = None, overlap: bool = True):
        self.strategies = {e: s.split for e, s in ({"md": Markdown(), "markdown": Markdown()} | dict.fromkeys(tf.CODE, Code()) | (strategies or {})).items()}
        self.overlap = overlap

    def extract(self, content: Column) -> Column:
        return decode_text(content)

    def parts(self, path: Column, name: Column, ext: Column, extracted: Column) -> Column:
        return _texts(tf.keep_quality(tf.chunk_by_extension(extracted, ext, self.overlap, self.strategies)))


@F.arrow_udf(T.StringType())
def _pdf_text(content: pa.Array) -> pa.Array:
    out = []
    for data in content:
        try:
            out.append(pdf.extract_text(data.as_py() or b""))
        except Exception:  # noqa: BLE001 - a damaged file is named by its path instead
            out.append("")
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def _image_size(content: pa.Array) -> pa.Array:
    sizes = (images.dimensions(data.as_py() or b"") for data in content)
    return pa.array([f"{s[0]}×{s[1]}" if s else None for s in sizes], pa.string())


class PdfParser(FileParser):
    extensions = ("pdf",)

    def extract(self, content: Column) -> Column:
        return _pdf_text(content)

    def parts(self, path: Column, name: Column, ext: Column, extracted: Column) -> Column:
        text = tf.trim(extracted)
        return _texts(F.when(text == "", F.array(tf.pdf_fallback(path))).otherwise(tf.pdf_windows(text)))


class ImageParser(FileParser):
    extensions = tuple(paths.PARSED["image"])

    def extract(self, content: Column) -> Column:
        return _image_size(content)

    def parts(self, path: Column, name: Column, ext: Column, extracted: Column) -> Column:
        sized = F.concat(F.lit("Image: "), name, F.lit(" ("), extracted, F.lit(" pixels)"))
        return _part("image", F.coalesce(sized, F.concat(F.lit("Image file: "), name)))


class AudioParser(FileParser):
    extensions = tuple(paths.PARSED["audio"])

    def __init__(self, transcriber: Transcriber | None = None):
        self.transcriber = transcriber

    def extract(self, content: Column) -> Column:
        return F.lit(None).cast("string") if self.transcriber is None else self.transcriber.transcribe(content)

    def parts(self, path: Column, name: Column, ext: Column, extracted: Column) -> Column:
        return _part("audio_transcript", F.coalesce(extracted, F.concat(F.lit("Audio ("), ext, F.lit("): "), name)))


class VideoParser(FileParser):
    extensions = tuple(paths.PARSED["video"])

    def parts(self, path: Column, name: Column, ext: Column, extracted: Column) -> Column:
        return _part("video_keyframe", F.concat(F.lit("Video file: "), name))


class ParserRegistry:
    """Parsers by extension; of two for the same, the later counts."""

    def __init__(self, parsers: list[FileParser] | None = None):
        self.by_extension: dict[str, FileParser] = {}
        for p in parsers if parsers is not None else [TextParser(), PdfParser(), ImageParser(), AudioParser(), VideoParser()]:
            self.register(p)

    def register(self, parser: FileParser) -> None:
        self.by_extension |= dict.fromkeys(parser.extensions, parser)

    def get(self, path: str) -> FileParser:
        ext = path.rpartition("/")[2].rpartition(".")[2].lower()
        if ext not in self.by_extension:
            raise UnsupportedFileType(path)
        return self.by_extension[ext]

    def supports(self, path: Column) -> Column:
        return paths.extension(path).isin(*self.by_extension)

    def parse(self, files: DataFrame) -> DataFrame:
        """Files (path, content) with parts instead of content; each parser sees its own extensions alone."""
        ext, name = paths.extension(F.col("path")), F.element_at(F.split("path", "/"), -1)
        groups: dict[int, tuple[FileParser, list[str]]] = {}
        for e, p in self.by_extension.items():
            groups.setdefault(id(p), (p, []))[1].append(e)
        out = None
        for parser, exts in groups.values():
            own = files.where(ext.isin(*exts)).withColumn("content", parser.extract(F.col("content")))
            own = own.withColumn("parts", parser.parts(F.col("path"), name, ext, F.col("content"))).drop("content")
            out = own if out is None else out.unionByName(own)
        return out
