"""Licence scan: Aho-Corasick for tags and notice phrases, shunting-yard for expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, alnum_words, column

#: Base phrases, in words, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases, in words, and their labels.
NOTICE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: What comes before a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:", "package-license-declared:")
#: Identifiers of expressions: label, and how freely the text may be used (0 to 1).
IDENTIFIERS = {
    "mit": ("mit", 1.0), "apache-2.0": ("apache-2", 1.0), "bsd-2-clause": ("bsd", 1.0), "bsd-3-clause": ("bsd", 1.0), "isc": ("isc", 1.0), "zlib": ("zlib", 1.0),
    "cc0-1.0": ("cc0", 1.0), "unlicense": ("public-domain", 1.0), "cc-by-4.0": ("cc-by", 0.9), "mpl-2.0": ("mpl-2", 0.6), "epl-2.0": ("epl-2", 0.6), "lgpl-2.1": ("lgpl", 0.5),
    "lgpl-3.0": ("lgpl", 0.5), "cc-by-sa-4.0": ("cc-by-sa", 0.4), "gpl-2.0": ("gpl-2", 0.3), "gpl-3.0": ("gpl-3", 0.3), "agpl-3.0": ("agpl-3", 0.2), "cc-by-nc-4.0": ("cc-by-nc", 0.1), "cc-by-nd-4.0": ("cc-by-nd", 0.1),
}
#: Freedom by label, for notices; exceptions loosen a licence by this much.
FREEDOM = {label: free for label, free in IDENTIFIERS.values()} | {"proprietary": 0.05}
EXCEPTION = 0.2
UNKNOWN = 0.5
_STRENGTH = {"or": 1, "and": 2, "with": 3}
_IN_IDENTIFIER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.-+:")


def tokens(expression: str) -> Iterator[str]:
    """Parentheses and words, as far as the line reads as an expression: operands and operators take turns."""
    at, operand, depth = 0, True, 0
    while at < len(expression):
        c = expression[at]
        if c in " \t":
            at += 1
        elif c == "(" and operand:
            depth += 1
            at += 1
            yield c
        elif c == ")" and not operand and depth:
            depth -= 1
            at += 1
            yield c
        elif c in _IN_IDENTIFIER:
            end = at
            while end < len(expression) and expression[end] in _IN_IDENTIFIER:
                end += 1
            word = expression[at:end]
            if (word in _STRENGTH) == operand:
                return
            operand = not operand
            at = end
            yield word
        else:
            return


def evaluate(expression: str) -> tuple[list[str], float] | None:
    """Labels and freedom of a lower-cased licence expression; None if it isn't one.

    Shunting-yard with the order with > and > or, left to right. "or" lets the user
    choose (the freer counts), "and" binds to both (the stricter counts), "with" adds an
    exception. Where a line goes on after the expression, what can be read counts; an
    operator at the end or an open parenthesis is forgiven.
    """
    values: list[tuple[list[str], float]] = []
    operators: list[str] = []

    def apply() -> None:
        op = operators.pop()
        if op == "(":
            return
        if len(values) < 2:  # an operator without what follows
            return
        (right, r), (left, l) = values.pop(), values.pop()
        if op == "with":
            values.append((left, min(1.0, l + EXCEPTION)))
        else:
            values.append((left + right, max(l, r) if op == "or" else min(l, r)))

    exception = False
    for t in tokens(expression):
        if t == "(":
            operators.append(t)
        elif t == ")":
            while operators and operators[-1] != "(":
                apply()
            if operators:
                operators.pop()
        elif t in _STRENGTH:
            while operators and operators[-1] != "(" and _STRENGTH[operators[-1]] >= _STRENGTH[t]:
                apply()
            operators.append(t)
            exception = t == "with"
        else:
            name = t.rstrip(".:").removesuffix("+").removesuffix("-only").removesuffix("-or-later")
            label, free = IDENTIFIERS.get(name, (f"other:{name}", UNKNOWN))
            values.append(([], 0.0) if exception else ([label], free))
            exception = False
    while operators:
        apply()
    return values[-1] if values and values[-1][0] else None


def _automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, value in words.items():
        machine.add_word(word, value)
    machine.make_automaton()
    return machine


class Scanner:
    """Finds base phrases, further notices and tagged expressions in whole texts."""

    def __init__(self):
        # a space on either side, so that matches begin and end with words
        self.phrases = _automaton({f" {p} ": (p.count(" ") + 1, label, p in BASE_PHRASES) for p, label in (NOTICE_PHRASES | BASE_PHRASES).items()})
        self.tags = _automaton({t: len(t) for t in TAGS})

    def scan(self, text: str | None) -> dict:
        words = alnum_words(text)
        flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        base, found, starts, free = [], set(), [], []
        at = spaces = 0  # matches come in order of their ends, so each space is counted once
        for end, (size, label, is_base) in self.phrases.iter(flat):
            if is_base:
                spaces += flat.count(" ", at, end + 1)
                at = end + 1
                starts.append(spaces - 1 - size)
                base.append(label)
            else:
                found.add(label)
            free.append(FREEDOM.get(label, UNKNOWN))
        expressions = []
        low = ascii_lower(text).decode("utf-8", "surrogatepass")
        for end, _ in self.tags.iter(low):
            stop = low.find("\n", end)
            line = low[end + 1 : stop if stop >= 0 else len(low)].strip(" \t\r*/#<>-!\"'")
            if value := evaluate(line):
                expressions.append(line)
                found.update(value[0])
                free.append(value[1])
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(set(base))), "labels": ",".join(sorted(found | set(base))), "score": min(free, default=0.0), "expressions": expressions,
        }


_OUT = [("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"), ("expressions", pa.list_(pa.string()), "array<string>")]


def _scan() -> Callable:
    schema = pa.schema([(name, kind) for name, kind, _ in _OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = pa.RecordBatch.from_pylist([scanner.scan(t.as_py()) for t in batch.column(1)], schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows.columns], names=["id", *schema.names])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters.
    n_base counts all places of base phrases, overlapping ones too; first_word and
    last_word are their smallest and largest first words (null without any). labels
    adds other notices and the identifiers of tagged expressions; score is the freedom
    of use that the strictest finding leaves (1 free, 0.05 proprietary); 0 says that
    nothing was found.
    Null and empty texts have no words. Rows are independent: repeated rows and ids
    give repeated results. Only id and text are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(_scan(), f"id {kind}, " + ", ".join(f"{name} {sql}" for name, _, sql in _OUT))
    return out.withColumnRenamed("id", id_col)
