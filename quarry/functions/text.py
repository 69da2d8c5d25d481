"""Chunking and quality of text, as columns. Lengths are characters.

Quality, windows and previews are SQL expressions. Chunking carries a state from part to
part, which a fold over arrays copies again and again; it is an Arrow UDF over quarry.functions.cut,
linear in each text. Nothing is shuffled; null texts give null.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import cut
from quarry.functions.cut import MOST, OVERLAP, TARGET

#: Least length of a chunk and of its word characters.
LEAST, LEAST_WORDS = 30, 30
#: Characters of a PDF's windows and of their overlap; of a snippet and a preview line.
PDF_SIZE, PDF_OVERLAP, SNIPPET, PREVIEW = 1500, 150, 2000, 120
#: Extensions of code and of Markdown.
CODE = "py rs js ts go java c cpp h css sh sql".split()
MARKDOWN = ["md", "markdown"]

_INFORMATIVE = r"\p{IsAlphabetic}0-9一-鿿぀-ヿ가-힯"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, though f names it more than once."""
    return F.transform(F.array(value), f)[0]


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return trim(text) == ""


def _split(f: Callable[..., list[str]], *texts: Column) -> Column:
    """array<string>: f of each row's strings, null where one is null."""

    @F.arrow_udf("array<string>")
    def split(*columns: pa.Array) -> pa.Array:
        values = zip(*(c for c in columns))
        rows = ([x.as_py() for x in row] for row in values)
        return pa.array((None if None in row else f(*row) for row in rows), pa.list_(pa.string()))

    return split(*texts)


def blank_line_blocks(text: Column) -> Column:
    """Trimmed parts between runs of two or more line feeds; blank parts go, of a blank text one empty part stays."""
    parts = F.filter(F.transform(F.split(text, "\n{2,}", -1), trim), lambda p: p != "")
    return let(parts, lambda p: F.when(F.size(p) == 0, F.array(F.lit(""))).otherwise(p))


def sentences(text: Column) -> Column:
    """Sentences with what follows them up to the next; a blank tail goes; a text without any is one."""
    return _split(cut.sentences, text)


def raw_parts(text: Column, size: int) -> Column:
    """Runs of size characters."""
    return _split(lambda t: cut.raw_parts(t, size), text)


def word_parts(text: Column, size: int) -> Column:
    """Words packed with single spaces into parts of at most size characters (see cut.word_parts)."""
    return _split(lambda t: cut.word_parts(t, size), text)


def sentence_parts(text: Column, size: int) -> Column:
    """Sentences packed into trimmed parts of at most size characters; longer sentences by words."""
    return _split(lambda t: cut.sentence_parts(t, size), text)


def packed_blocks(text: Column, target: int = TARGET, most: int = MOST) -> Column:
    """Blocks between empty lines, joined up to target characters; those above most by sentences."""
    return _split(lambda t: cut.pack_blocks(cut.blank_line_blocks(t), target, most), text)


def chunk(text: Column, split: Callable[[str], list[str]] = cut.prose, overlap: bool = True) -> Column:
    """A strategy's chunks (cut.prose, cut.markdown, or any function of a text) without blank ones, with overlap if asked for."""
    return _split(lambda t: cut.chunk(t, split, overlap), text)


def chunk_by_extension(text: Column, ext: Column, overlap: bool = True, strategies: dict[str, Callable[[str], list[str]]] | None = None) -> Column:
    """Chunks by the strategy of the extension: Markdown by headings, all else as prose unless strategies say otherwise."""
    known = dict.fromkeys(MARKDOWN, cut.markdown) | (strategies or {})
    return _split(lambda t, e: cut.chunk(t, known.get(e, cut.prose), overlap), text, F.coalesce(ext, F.lit("")))


def word_chars(text: Column) -> Column:
    """Characters in runs of two or more letters, digits, kana, hangul or CJK characters."""
    return F.char_length(F.regexp_replace(text, rf"[^{_INFORMATIVE}]++(?:[{_INFORMATIVE}](?![{_INFORMATIVE}]))?|\A[{_INFORMATIVE}](?![{_INFORMATIVE}])", ""))


def is_quality(text: Column) -> Column:
    return let(trim(text), lambda bare: (F.char_length(bare) >= LEAST) & (word_chars(bare) >= LEAST_WORDS))


def keep_quality(chunks: Column) -> Column:
    return F.filter(chunks, is_quality)


def pdf_windows(text: Column, size: int = PDF_SIZE, overlap: int = PDF_OVERLAP) -> Column:
    """One chunk up to size bytes; else windows of size characters that overlap, up to the one that reaches the end."""
    n = F.char_length(text)
    last = F.greatest(F.ceil((n - size) / (size - overlap)), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * (size - overlap) + 1, F.lit(size)))
    return F.when(F.octet_length(text) <= size, F.array(text)).otherwise(windows)


def pdf_fallback(path: Column) -> Column:
    """A file's stem and the names of the two folders above it."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    stem = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws(" ", stem, F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 3))


def snippet(content: Column, size: int = SNIPPET) -> Column:
    return F.substring(content, 1, size)


def preview_line(content: Column) -> Column:
    return F.substring(content, 1, PREVIEW)
