"""Keyword search: BM25 over substrings of three or more characters, with a LIKE fallback.

Terms of a query are joined by AND unless operators stand between them; a term
matches as a case-folded substring. Corpus statistics come from one aggregation, and
the best rows from one ordered take.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import snippet

#: BM25's constants, the idf of terms in half the rows or more, the LIKE score, the bend of the score map.
K1, B, LEAST_IDF, LIKE_BM25, BEND = 1.2, 0.75, 1e-6, -1.0, 10.0
_STRIPPED = ':"*()-^'
_WORD = re.compile(r"[A-Za-z0-9_\x1a\u0080-\U0010ffff]+")


@dataclass(frozen=True)
class Node:
    """term, AND, OR or NOT."""

    kind: str
    term: str = ""
    left: Node | None = None
    right: Node | None = None

    def terms(self) -> list[str]:
        return [self.term] if self.kind == "term" else self.left.terms() + self.right.terms()

    def counted(self, hits: dict[str, Column], when: Column) -> list[tuple[str, Column]]:
        """Terms that score a row, and when: those of branches that match it, none behind NOT."""
        if self.kind == "term":
            return [(self.term, when)]
        if self.kind == "NOT":
            return self.left.counted(hits, when)
        sides = [self.left, self.right]
        return [x for side in sides for x in side.counted(hits, when if self.kind == "AND" else when & side.matches(hits))]

    def matches(self, hits: dict[str, Column]) -> Column:
        if self.kind == "term":
            return hits[self.term]
        a, b = self.left.matches(hits), self.right.matches(hits)
        return a & b if self.kind == "AND" else a | b if self.kind == "OR" else a & ~b


def clean(query: str) -> str:
    """Query marks become spaces; spaces collapse."""
    return " ".join("".join(" " if c in _STRIPPED else c for c in query).split())


def parse(query: str, strict: bool = False) -> Node | None:
    """The cleaned query as a tree; None if it finds nothing.

    AND, OR and NOT in capitals are operators: NOT binds before AND, AND before OR, and
    neighbours are joined by AND more tightly than any of them. Words below three characters are passed
    over. Other punctuation ends a strict query without results and is else a space; so
    does a dangling operator.
    """
    words: list[str] = []
    for w in query.split():
        if not _WORD.fullmatch(w):
            if strict:
                return None
            words += _WORD.findall(w)
        else:
            words.append(w)
    at = 0

    class Dangling(Exception):
        pass

    def run() -> Node | None:
        nonlocal at
        if at >= len(words) or words[at] in ("AND", "OR", "NOT"):
            raise Dangling
        tree = None
        while at < len(words) and words[at] not in ("AND", "OR", "NOT"):
            if len(words[at]) >= 3:
                leaf = Node("term", words[at].lower())
                tree = leaf if tree is None else Node("AND", left=tree, right=leaf)
            at += 1
        return tree

    def level(op: str, below) -> Node | None:
        nonlocal at
        tree = below()
        while at < len(words) and words[at] == op:
            at += 1
            other = below()
            if tree is None or other is None:
                tree = tree if op == "NOT" or other is None else other
            else:
                tree = Node(op, left=tree, right=other)
        return tree

    try:
        tree = level("OR", lambda: level("AND", lambda: level("NOT", run)))
    except Dangling:
        return None
    return tree if at == len(words) else None


def occurrences(text: Column, term: str) -> Column:
    """Overlapping places of a term in lower-cased text."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(term)})")) if term.isascii() and term.isalnum() else F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(text) - len(term) + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(len(term))) == term))


def bm25(docs: DataFrame, query: str, content: str = "content", strict: bool = False) -> DataFrame:
    """The rows of docs that match, with bm25 (more negative is better).

    Null contents match nothing but count as rows of no length.
    """
    empty = docs.limit(0).withColumn("bm25", F.lit(0.0))
    tree = parse(clean(query), strict)
    if tree is None:
        return empty
    unique = sorted(set(tree.terms()))
    low = F.lower(F.coalesce(F.col(content), F.lit("")))
    # the counts per term are made from a short array, so that the text is read in one projection
    counted = docs.withColumn("__f", F.array(*[F.when(F.contains(low, F.lit(t)), occurrences(low, t)).otherwise(0) for t in unique])).withColumn("__d", F.greatest(F.char_length(low) - 2, F.lit(0)))
    stats = counted.agg(F.count("*").alias("n"), F.avg("__d").alias("avg"), *[F.sum((F.col("__f")[i] > 0).cast("long")).alias(f"n{i}") for i in range(len(unique))]).first()
    if not stats.n:
        return empty
    return scored(counted, tree, unique, stats.n, stats.avg, [stats[f"n{i}"] for i in range(len(unique))])


def scored(counted: DataFrame, tree: Node, terms: list[str], rows: int, avg: float | None, have: list[int | None]) -> DataFrame:
    """The rows of counted that match, with bm25 in the place of __f (the terms' counts) and __d (the length).

    rows, avg: number and average length of all rows; have: the rows that hold each term.
    """
    f, place = F.col("__f"), {t: i for i, t in enumerate(terms)}
    hits = {t: f[i] > 0 for t, i in place.items()}
    total = F.lit(0.0)
    for t, when in tree.counted(hits, F.lit(True)):
        i = place[t]
        part = F.lit(_idf(rows, have[i] or 0)) * (f[i] * (K1 + 1)) / (f[i] + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("__d") / F.lit(avg or 1.0)))
        total = total + F.when(when, part).otherwise(0.0)
    return counted.where(tree.matches(hits)).withColumn("bm25", -total).drop("__f", "__d")


def _idf(rows: int, have: int) -> float:
    idf = math.log((rows - have + 0.5) / (have + 0.5))
    return idf if idf > 0 else LEAST_IDF


def like(docs: DataFrame, query: str, content: str = "content") -> DataFrame:
    """Rows that contain the query as given, % and _ as wildcards, ASCII case apart; all score alike."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = "".join(c.lower() if c.isascii() else c for c in query).replace("\\", "\\\\")
    return docs.where(fold(F.col(content)).like(f"%{pattern}%")).withColumn("bm25", F.lit(LIKE_BM25))


def to_score(value: Column) -> Column:
    """s / (s + 10) of s = max(-bm25, 0)."""
    s = F.greatest(-value, F.lit(0.0))
    return s / (s + BEND)


def keyword_search(chunks: DataFrame, query: str, limit: int = 20, key: str = "chunk_id", content: str = "content", strict: bool = False) -> DataFrame:
    """The best rows with score and snippet, ties by key; none for a blank query."""
    if not query.strip() or limit <= 0:
        return chunks.limit(0).withColumn("score", F.lit(0.0)).withColumn("snippet", F.col(content))
    found = bm25(chunks, query, content, strict) if len(clean(query)) >= 3 else like(chunks, query, content)
    best = found.orderBy("bm25", key).limit(limit)
    return best.withColumn("score", to_score(F.col("bm25"))).drop("bm25").withColumn("snippet", snippet(F.col(content)))
