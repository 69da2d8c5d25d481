"""Cutting one text into chunks. Lengths are characters; each text is read a fixed number of times, whatever its length."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Characters of a chunk: aimed at, at most; sentences of overlap.
TARGET, MOST, OVERLAP = 1200, 1800, 2
#: Unicode white space, and that without the line feed.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BLANKS = WHITE.replace("\n", "")
_WORD = re.compile(f"[^{WHITE}]+")
_BLANK_LINES = re.compile("\n{2,}")
# a sentence ends at a CJK mark, or at an ASCII mark before white space or the end, whose blanks it takes along
_END = re.compile(rf"[。？！]|[.?!](?=[{WHITE}]|\Z)[{_BLANKS}]*")
_HEADING = re.compile(rf"^(?=[{_BLANKS}]*#[# ])", re.MULTILINE)


def trim(text: str) -> str:
    return text.strip(WHITE)


def blank_line_blocks(text: str) -> list[str]:
    """Trimmed parts between runs of two or more line feeds; blank parts go, of a blank text one empty part stays."""
    return [p for p in map(trim, _BLANK_LINES.split(text)) if p] or [""]


def sentences(text: str) -> list[str]:
    """Sentences with what follows them up to the next; a blank tail goes; a text without any is one."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    if trim(text[at:]):
        out.append(text[at:])
    return out or [text]


def raw_parts(text: str, size: int) -> list[str]:
    """Runs of size characters."""
    return [text[i : i + size] for i in range(0, len(text), size)]


class _Packer:
    """Pieces that are joined until one doesn't fit."""

    def __init__(self, joiner: str = ""):
        self.joiner, self.pieces, self.size, self.out = joiner, [], 0, []

    def length_with(self, piece: str) -> int:
        return self.size + len(self.joiner) + len(piece)

    def add(self, piece: str) -> None:
        self.size = self.length_with(piece) if self.pieces else len(piece)
        self.pieces.append(piece)

    def close(self) -> None:
        if self.pieces:
            self.out.append(self.joiner.join(self.pieces))
        self.pieces, self.size = [], 0


def word_parts(text: str, size: int) -> list[str]:
    """Words packed with single spaces into parts of at most size characters.

    A word of size or more is cut into runs only where it begins a part; after another
    word it stands as it is.
    """
    pack = _Packer(" ")
    for word in _WORD.findall(text):
        if pack.pieces and pack.length_with(word) > size:
            pack.close()
            pack.add(word)
        elif not pack.pieces and len(word) >= size:
            pack.out += raw_parts(word, size)
        else:
            pack.add(word)
    pack.close()
    return pack.out


def sentence_parts(text: str, size: int) -> list[str]:
    """Sentences packed into trimmed parts of at most size characters; longer sentences by words."""
    pack = _Packer()
    for s in sentences(text):
        if pack.size and pack.length_with(s) <= size:
            pack.add(s)
            continue
        pack.close()
        if len(s) > size:
            pack.out += word_parts(s, size)
        else:
            pack.add(s)
    blank_end = not trim("".join(pack.pieces))
    if not blank_end:
        pack.close()
    return list(map(trim, pack.out))


def pack_blocks(blocks: list[str], target: int = TARGET, most: int = MOST) -> list[str]:
    """Neighbouring blocks joined by an empty line up to target characters; those above most by sentences."""
    pack = _Packer("\n\n")
    for block in blocks:
        if pack.size and pack.length_with(block) > target:
            pack.close()
        if block:
            pack.add(block)
    pack.close()
    return [c for whole in pack.out for c in (sentence_parts(whole, most) if len(whole) > most else [whole])]


def prose(text: str) -> list[str]:
    return pack_blocks(blank_line_blocks(text))


def sections(text: str) -> list[str]:
    """Trimmed sections that begin with a heading; of a blank text none."""
    return [p for p in map(trim, _HEADING.split(text.replace("\r\n", "\n"))) if p]


def markdown(text: str) -> list[str]:
    """Sections that begin with a heading; long ones as prose."""
    return [c for s in sections(text) for c in (prose(s) if len(s) > MOST else [s])]


def with_overlap(chunks: list[str], n: int = OVERLAP, most: int = MOST) -> list[str]:
    """Each chunk but the first after the last n sentences of the chunk before it, where both fit."""
    out = chunks[:1]
    for before, own in zip(chunks, chunks[1:]):
        tail = trim("".join(sentences(before)[-n:]))
        out.append(f"{tail}\n{own}" if tail and len(tail) + 1 + len(own) <= most else own)
    return out


def chunk(text: str, split: Callable[[str], list[str]] = prose, overlap: bool = True) -> list[str]:
    """A strategy's chunks without blank ones, with overlap if asked for."""
    parts = [c for c in split(text) if trim(c)]
    return with_overlap(parts) if overlap else parts
