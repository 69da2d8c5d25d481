"""Previews of files: text, or content in base64 up to a size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.sources.parsers import decode_text

# Characters of text, bytes of content by type, media types.
TEXT_CHARS = 12_000
MOST_BYTES = {"pdf": 20 << 20, "image": 6 << 20, "audio": 50 << 20}
MEDIA = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml",
    "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac", "ogg": "audio/ogg", "aac": "audio/aac", "m4a": "audio/mp4", "opus": "audio/opus", "wma": "audio/x-ms-wma",
}
_OTHER = {"image": "image/jpeg", "audio": "audio/mpeg"}


def preview(files: DataFrame) -> DataFrame:
    """(path, type, ext, size, text, data) of rows (path, content): data is base64, for pdf bare and else a data URL."""
    ext = paths.extension(F.col("path"))
    kind = paths.file_type(ext)
    size = F.octet_length("content").cast("long")
    limits = F.create_map(*[F.lit(x) for k, v in MOST_BYTES.items() for x in (k, v)])
    inline = kind.isin(*MOST_BYTES)
    large = inline & (size > F.element_at(limits, kind))
    known = F.create_map(*[F.lit(x) for k, v in MEDIA.items() for x in (k, v)])
    other = F.create_map(*[F.lit(x) for k, v in _OTHER.items() for x in (k, v)])
    media = F.coalesce(F.element_at(known, ext), F.element_at(other, kind))
    raw = F.replace(F.base64("content"), F.lit("\r\n"), F.lit(""))  # Spark breaks lines
    return files.select(
        "path", F.when(large, F.concat(kind, F.lit("_large"))).when(inline | (kind == "text"), kind).otherwise("binary").alias("type"), ext.alias("ext"), size.alias("size"),
        F.when(kind == "text", F.substring(decode_text(F.col("content")), 1, TEXT_CHARS)).alias("text"),
        F.when(inline & ~large, F.when(kind == "pdf", raw).otherwise(F.concat(F.lit("data:"), media, F.lit(";base64,"), raw))).alias("data"),
    )
