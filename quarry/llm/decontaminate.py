"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A window is a run of item words; it occurs in a document only if all its shingles do,
so one necessary prefix token is enough to find it: its rarest shingle, by counts over
the whole corpus. Documents are searched for those prefix tokens alone; the token's
place in the window fixes where the window must begin (positional bound), it must end
within the document (length bound), and each candidate is compared word by word.

Executors build the benchmark into block files of bounded size in the shared folder. Two
scans of the documents meet all of them, however many: one counts the blocks' shingles,
one finds windows. A task holds one block at a time, and the driver only their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import files
from quarry.llm.common import WordHashes, alnum_words, chunks_of, column, held, materialise, release, row_of, rows_back, scratch_path, with_field

#: Words of a window, of a shingle, bytes of benchmark text in a block, characters of documents that meet all blocks together.
WINDOW, SHINGLE, BLOCK_BYTES, TOGETHER = 13, 5, 4 << 20, 1 << 20
#: Words of the benchmark of which a task knows the hashes; with more, all words of documents are hashed.
MOST_KNOWN = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Block:
    """Items of a block as arrays: words as hashes and as bytes, windows, and their prefix tokens."""

    hashes: np.ndarray  # of the words of all items, one after another, 0 behind each item
    text: bytes  # the same words with a space behind each
    ends: np.ndarray  # of each word in text
    starts: np.ndarray  # of each window in hashes
    sizes: np.ndarray
    items: np.ndarray  # of each window
    names: list[str | None]  # of the items
    lengths: tuple[int, ...]  # of shingles
    tokens: np.ndarray | None = None  # distinct prefix tokens, sorted
    first: np.ndarray | None = None  # windows of token i: order[first[i]:first[i + 1]]
    order: np.ndarray | None = None
    offsets: np.ndarray | None = None  # of the prefix token in each window

    def words(self, start: int, n: int) -> bytes:
        return self.text[self.ends[start - 1] + 1 if start else 0 : self.ends[start + n - 1]]


def shingle_keys(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the runs of so many words that hold no 0, which parts texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key, whole = np.full(n, size, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = hashes[k : k + n]
        whole &= part > 0
        key = (key ^ part) * _P
        key ^= key >> np.uint64(29)
    at = np.flatnonzero(whole)
    return at, key[at]


def parts_of(words: list[bytes], window: int, most: int) -> Iterator[list[bytes]]:
    """Parts of a long item, each window in just one of them."""
    for at in range(0, max(1, len(words) - window + 1), most):
        yield words[at : at + most + window - 1]


def make_block(rows: list[tuple[str | None, list[bytes]]], window: int = WINDOW, shingle: int = SHINGLE) -> Block:
    """A block of items (name, words), without prefix tokens."""
    hash_of = WordHashes().__getitem__
    words: list[bytes] = []
    hashes, starts, sizes, items, names = [], [], [], [], []
    for name, item in rows:
        size = min(window, len(item))
        n = len(item) - size + 1
        starts.append(np.arange(len(words), len(words) + n))
        sizes.append(np.full(n, size))
        items.append(np.full(n, len(names)))
        names.append(name)
        words += [*item, b""]
        hashes += [*map(hash_of, item), 0]
    arrays = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32) for x in (starts, sizes, items)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    lengths = tuple(sorted({min(shingle, s) for s in np.unique(arrays[1]).tolist()}))
    return Block(np.array(hashes, np.uint64), b"".join(w + b" " for w in words), ends.astype(np.int32), *arrays, names, lengths)


def all_tokens(block: Block) -> np.ndarray:
    """Keys of all shingles that windows could be found by, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingle_keys(block.hashes, k)[1] for k in block.lengths)]))


def choose_prefixes(block: Block, tokens: np.ndarray, counts: np.ndarray, shingle: int = SHINGLE) -> None:
    """Orders each window's shingles by corpus rarity and keeps the first; counts are those of all_tokens()."""
    best_key = np.zeros(len(block.starts), np.uint64)
    best_at = np.zeros(len(block.starts), np.int32)
    for k in block.lengths:
        at, found = shingle_keys(block.hashes, k)
        keys = np.zeros(len(block.hashes), np.uint64)
        keys[at] = found
        n = np.zeros(len(block.hashes), np.int64)
        n[at] = counts[np.searchsorted(tokens, found)]
        own = np.flatnonzero(np.minimum(block.sizes, shingle) == k)
        rarest = np.full(len(own), np.iinfo(np.int64).max)
        for j in range(int(block.sizes[own].max(initial=0)) - k + 1):
            inside = j <= block.sizes[own] - k
            here = n[np.where(inside, block.starts[own] + j, 0)]
            better = inside & (here < rarest)
            rarest[better], best_at[own[better]] = here[better], j
        best_key[own] = keys[block.starts[own] + best_at[own]]
    block.offsets = best_at
    block.order = np.argsort(best_key, kind="stable").astype(np.int32)
    block.tokens, first = np.unique(best_key[block.order], return_index=True)
    block.first = np.append(first, len(best_key)).astype(np.int32)


class Words:
    """Some documents as one array of word hashes, a 0 behind each, and their shingles in order of key."""

    def __init__(self, texts: list[str | None], hashes: dict[bytes, int]):
        self.words: list[bytes] = []
        numbers: list[int] = []
        ends = []
        for text in texts:
            own = alnum_words(text)
            numbers += map(hashes.__getitem__, own)
            numbers.append(0)
            self.words += own
            ends.append(len(self.words))
            self.words.append(b"")
        self.hashes = np.array(numbers, np.uint64)
        self.ends = np.array(ends, np.int64)
        self.starts = np.append(0, self.ends[:-1] + 1)[: len(ends)]
        self.sizes = self.ends - self.starts
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys, in order of the keys, so that blocks are searched in one sweep."""
        if size not in self._sorted:
            at, keys = shingle_keys(self.hashes, size)
            order = np.argsort(keys)
            self._sorted[size] = at[order], keys[order]
        return self._sorted[size]

    def found(self, size: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose shingle is one of the tokens (sorted), and which."""
        at, keys = self.shingles(size)
        if not len(tokens) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.searchsorted(tokens, keys)
        i[i == len(tokens)] = 0
        hit = tokens[i] == keys
        return at[hit], i[hit]


def search(block: Block, docs: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and items of all windows that occur."""
    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in block.lengths:
        at, i = docs.found(k, block.tokens)
        n = block.first[i + 1] - block.first[i]
        place = np.repeat(at, n)
        nth = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        w = block.order[np.repeat(block.first[i], n) + nth]
        s = place - block.offsets[w]
        fits = (s >= 0) & (s + block.sizes[w] <= len(docs.hashes)) & (np.minimum(block.sizes[w], max(block.lengths)) == k)
        starts.append(s[fits])
        windows.append(w[fits])
    s, w = np.concatenate(starts), np.concatenate(windows)
    for k in range(int(block.sizes.max(initial=0))):
        inside = k < block.sizes[w]
        same = ~inside
        same[inside] = docs.hashes[s[inside] + k] == block.hashes[block.starts[w[inside]] + k]
        s, w = s[same], w[same]
    exact = [b" ".join(docs.words[a : a + n]) == block.words(b, n) for a, b, n in zip(s.tolist(), block.starts[w].tolist(), block.sizes[w].tolist())]
    s, w = s[exact], w[exact]
    return s, block.sizes[w], block.items[w]


# --- blocks in the shared folder ---------------------------------------------


def _save(folder: str, block: Block) -> str:
    with files.create(folder, "block", ".pickle") as (uri, stream):
        stream.write(pickle.dumps(block, 5))
    return uri


def _read(uri: str) -> tuple[Block, np.ndarray]:
    block = pickle.loads(files.read_bytes(uri))
    return block, all_tokens(block) if block.tokens is None else block.tokens


def _load(uri: str) -> tuple[Block, np.ndarray]:
    """A block and its tokens; a worker keeps the last one."""
    return held(("block", uri), lambda: _read(uri))


def _vocabulary(uris: list[str]) -> dict[bytes, int]:
    """Hashes of the blocks' words, 0 for any other word; where they have too many words, of all words."""
    known = _Known()
    for uri in uris:
        block, _ = _read(uri)
        known.update(zip(block.text[:-1].split(b" "), block.hashes.tolist()))
        if len(known) > MOST_KNOWN:
            return WordHashes()
    return known


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def _build(folder: str, window: int, shingle: int, block_bytes: int) -> Callable:
    """Items (name, text) into block files: a row (uri) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = alnum_words(text.as_py())
                for part in parts_of(words, window, max(1, block_bytes // 8)) if words else ():
                    rows.append((name, part))
                    size += sum(map(len, part)) + len(part)
                    if size >= block_bytes:
                        yield pa.RecordBatch.from_pydict({"uri": [_save(folder, make_block(rows, window, shingle))]})
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({"uri": [_save(folder, make_block(rows, window, shingle))]})

    return run


def _count(uris: list[str]) -> Callable:
    """Texts: (block, token, n) for the shingles of each block."""

    def rows(b: int, tokens: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        i = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), b, np.int32)), pa.array(tokens[i].view(np.int64)), pa.array(counts[i])], names=["block", "token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes, alone = _vocabulary(uris), None
        for batch in batches:
            for texts in chunks_of(batch.column(0), TOGETHER):
                docs = Words(texts, hashes)
                for b, uri in enumerate(uris):
                    block, tokens = _load(uri)
                    counts = np.zeros(len(tokens), np.int64)
                    for k in block.lengths:
                        counts += np.bincount(docs.found(k, tokens)[1], minlength=len(tokens))
                    if len(uris) > 1:
                        yield rows(b, tokens, counts)
                    else:
                        alone = counts if alone is None else alone + counts
        if alone is not None:
            yield rows(0, _load(uris[0])[1], alone)

    return run


def _choose(uris: list[str], folder: str, shingle: int) -> Callable:
    """Counts (block, token, n), sorted by block, at least a row a block: (block, uri) of the block with its prefix tokens."""

    def finish(b: int, found: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, tokens = _load(uris[b])
        counts = np.zeros(len(tokens), np.int64)
        for part in found:
            known = part.filter(part.column("token").is_valid())
            counts[np.searchsorted(tokens, known.column("token").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))] = known.column("n").to_numpy(zero_copy_only=False)
        release()  # the block gets its tokens only now
        choose_prefixes(block, tokens, counts, shingle)
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_save(folder, block)])], names=["block", "uri"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if now is not None and numbers[a] != now:
                        yield finish(now, found)
                        found = []
                    now = int(numbers[a])
                    found.append(batch.slice(a, b - a))
        if now is not None:
            yield finish(now, found)

    return run


def build_blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, shingle: int, block_bytes: int) -> list[str]:
    """Files of the benchmark's blocks, with prefix tokens by counts over all documents."""
    spark = docs.sparkSession
    items = benchmark.select(column(item_col).cast("string").alias("name"), column(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = scratch_path(spark, "benchmark-blocks")
    built = items.repartition(max(1, -(-int(size) // block_bytes))).mapInArrow(_build(folder, window, shingle, block_bytes), "uri string")
    uris = [r.uri for r in materialise(built, "benchmark-built").collect()]  # a row a block
    if not uris:
        return []
    counted = docs.select(column(text_col).alias("text")).mapInArrow(_count(uris), "block int, token long, n long").groupBy("block", "token").agg(F.sum("n").alias("n"))
    every = spark.createDataFrame([(b, None, 0) for b in range(len(uris))], "block int, token long, n long")
    sorted_counts = counted.unionByName(every).repartition(len(uris), "block").sortWithinPartitions("block")
    chosen = sorted_counts.mapInArrow(_choose(uris, folder, shingle), "block int, uri string")
    return [r.uri for r in sorted(materialise(chosen, "benchmark-chosen").collect())]


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _find(uris: list[str], text_at: int) -> Callable:
    """Rows (row): (row, n_words, n_hit, spans, items), spans being runs of hit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes = _vocabulary(uris)
        for batch in batches:
            at = 0
            for texts in chunks_of(batch.column("row").field(text_at), TOGETHER):
                docs = Words(texts, hashes)
                edge = np.zeros(len(docs.hashes) + 1, np.int64)
                items: list[set[str]] = [set() for _ in texts]
                for uri in uris:
                    block, _ = _load(uri)
                    s, n, item = search(block, docs)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n, -1)
                    for d, i in {*zip(np.searchsorted(docs.ends, s).tolist(), item.tolist())}:
                        if block.names[i] is not None:
                            items[d].add(block.names[i])
                hit = np.cumsum(edge) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                spans: list[list[dict]] = [[] for _ in texts]
                for d, a, b in zip(np.searchsorted(docs.ends, turns[::2]).tolist(), turns[::2].tolist(), turns[1::2].tolist()):
                    spans[d].append({"a": a - int(docs.starts[d]), "b": b - int(docs.starts[d])})
                columns = [
                    batch.column("row").slice(at, len(texts)), pa.array(docs.sizes, pa.int64()), pa.array((sum(x["b"] - x["a"] for x in own) for own in spans), pa.int64()),
                    pa.array(spans, _SPANS), pa.array(map(sorted, items), pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "n_hit", "spans", "items"])
                at += len(texts)

    return run


def judge(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each whole row of docs, as struct "row", with n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    Null and empty texts have no words and no hits. Items without words are passed over;
    an item without an id marks words but is not counted among items. Repeated rows and
    items change nothing else. An empty benchmark finds nothing, empty docs give an
    empty result. Columns of docs can have any names and types: they stay within "row".
    """
    uris = build_blocks(docs, benchmark, text_col, item_col, item_text, window, shingle, block_bytes)
    rows = row_of(docs)
    spans = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    schema = with_field(rows.schema["row"].dataType, "row", ("n_words", T.LongType()), ("n_hit", T.LongType()), ("spans", spans), ("items", T.ArrayType(T.StringType())))
    found = rows.mapInArrow(_find(uris, docs.columns.index(text_col)), schema)
    return found.select(
        "row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.array_sort("items").alias("items"), "spans",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (see judge)."""
    text_col = options.pop("text_col", "text")
    judged = judge(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), benchmark, **options)
    return judged.select(F.col("row.id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    return rows_back(judge(docs, benchmark, **options).where("not contaminated"))
