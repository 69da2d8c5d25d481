"""Token ids as binary files: canonical length-limited Huffman codes from global counts.

Documents are encoded once, their ids counted over all rows (partial counts a task,
summed by id: at most one row an id of the vocabulary reaches the driver), and each
range of documents becomes a file. A file holds independent blocks of at most
BLOCK_TOKENS ids; each block starts on a byte and has a checkpoint, the bit offset of
its every STRIDE-th id, so a block is decoded from all checkpoints at once by table
look-ups over whole arrays.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import files
from quarry.llm.common import chunks_of, column, held, materialise, qualified, scratch_path

#: File format.
MAGIC, BLOCK_TOKENS, STRIDE, MAX_BITS = b"QTOK1\n", 1 << 16, 256, 20
#: Blocks that are decoded together.
AT_ONCE = 16
#: Ids in transit: two bytes where the vocabulary allows it, else four.
ID_TYPES = {False: ("<u2", "H"), True: ("<u4", "I")}
#: Entries of a worker's memo of encoded words; it starts anew beyond that. Longest word that it keeps: no entry takes more than some 500 bytes.
MEMO, MEMO_CHARS = 800_000, 64


# --- encoding of texts ------------------------------------------------------


class WordMemo(dict):
    """Encodes whole texts with a byte-level tokenizer, each distinct word once.

    Such a tokenizer always parts a text before a space, and around a line feed, that
    stands between two other characters, and merges nothing across. Texts whose white
    space is of that kind alone are cut there: a key is a word that follows a space, or
    a line feed and a word. Other texts go through the library whole. A plain word
    (letters, perhaps a full stop or comma) is one part for the library's model; any
    other word goes through the whole library.
    """

    #: Letters of all Unicode versions.
    PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ƺ]+")

    def __init__(self, path: str, limit: int = MEMO):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.tokenize = self.model.tokenize
        self.dtype, self.code = ID_TYPES[self.tokenizer.get_vocab_size() > 1 << 16]
        kind = self.tokenizer.pre_tokenizer
        self.cuts = isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space and self.tokenizer.normalizer is None
        # the library's letters for bytes, in the order of the bytes that it shows as themselves
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x1BB)}
        self.space = letters[0x20]
        if self.cuts:
            self.newline = self.whole(["\n"])[0]
            self.marks = {m: self.whole([m])[0] for m in ".,"}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, word: str, lead: str) -> bytes:
        shown = word if word.isascii() else word.translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(lead + shown)]).tobytes()

    def __missing__(self, key: str) -> bytes:
        if key.isalpha() and key.isascii():
            ids = array(self.code, [t.id for t in self.tokenize(self.space + key)]).tobytes()
        else:
            ids = self._other(key)
        if len(key) <= MEMO_CHARS:
            self[key] = ids
        return ids

    def _other(self, key: str) -> bytes:
        """A key that has more than ASCII letters."""
        first = key[0] == "\n"
        word = key[1:] if first else key
        if self.PLAIN.fullmatch(word):
            return self.newline + self._part(word, "") if first else self._part(word, self.space)
        if word[-1] in self.marks and self.PLAIN.fullmatch(word, 0, len(word) - 1):
            bare = self.get(key[:-1]) or (self.newline + self._part(word[:-1], "") if first else self._part(word[:-1], self.space))
            return bare + self.marks[word[-1]]
        return self.newline + self.whole([word])[0] if first else self.whole([" " + word])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of self.dtype."""
        if not self.cuts:
            return self.whole(texts)
        if len(self) > self.limit:
            self.clear()
        get, skip, out = self.__getitem__, len(self.newline), []
        for text in texts:
            flat = text.replace("\n", " ")
            if not flat or flat[0] == " " or flat[-1] == " " or "  " in flat or not flat.isprintable():
                out.append(self.whole([text])[0])
            else:
                out.append(b"".join(map(get, ("\n" + text.replace("\n", " \n")).split(" ")))[skip:])
        return out


def _memo(path: str) -> WordMemo:
    return held(("tokens", path), lambda: WordMemo(path))


def id_type_of(path: str) -> str:
    return _memo(path).dtype


def _encode_rows(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        end = array(memo.code, [end_id]).tobytes()
        for batch in batches:
            at = 0
            for texts in chunks_of(batch.column(1)):
                ids = [x + end for x in memo.encode([t or "" for t in texts])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary())], names=["id", "ids"])
                at += len(texts)

    return run


# --- codes ------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Best code lengths of at most max_bits for symbols with a count; 0 for the others (package-merge)."""
    lengths = np.zeros(len(counts), np.uint8)
    symbols = np.flatnonzero(counts)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << max_bits:
        raise ValueError(f"{len(symbols)} symbols need codes of more than {max_bits} bits")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[symbols].astype(np.int64)
    level, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        kinds.append(order < len(leaves))
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(kinds):
        n_leaves = int(is_leaf[:take].sum())
        lengths[symbols[:n_leaves]] += 1
        take = 2 * (take - n_leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    for s in order.tolist():
        n = int(lengths[s])
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


def _bits_at(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """width <= 32 bits from each bit offset of a big-endian stream of 32-bit words."""
    i, shift = at >> 5, (at & 31).astype(np.uint64)
    both = (words[i] << np.uint64(32)) | words[i + 1]
    return (both >> (np.uint64(64 - width) - shift)) & np.uint64((1 << width) - 1)


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The block's bits and the bit offset of each STRIDE-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    words = np.zeros((int(ends[-1]) + 31) // 32 + 1, np.float64)
    wide = codes[ids].astype(np.uint64) << (np.uint64(64) - (starts & 31).astype(np.uint64) - n.astype(np.uint64))
    i = starts >> 5
    # fields of a word don't overlap, so their sum is exact in a double
    words += np.bincount(i, (wide >> np.uint64(32)).astype(np.float64), len(words))
    words[1:] += np.bincount(i, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words) - 1)[: len(words) - 1]
    return words.astype(np.uint64).astype(">u4").tobytes(), starts[::STRIDE].astype("<u4")


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = (1 << (self.width - lengths[order].astype(np.int64)))
        self.symbol = np.repeat(order, spans).astype(np.uint32)
        self.length = np.repeat(lengths[order], spans)
        rest = (1 << self.width) - len(self.symbol)  # of an incomplete code, as of one symbol
        self.symbol = np.pad(self.symbol, (0, rest))
        self.length = np.pad(self.length, (0, rest))

    def blocks(self, parts: list[tuple[bytes, int, np.ndarray]]) -> np.ndarray:
        """The ids of neighbouring blocks (bits, number of ids, checkpoints), from all their checkpoints at once."""
        bits = b"".join(p[0] for p in parts)
        words = np.frombuffer(bits + bytes(8), ">u4").astype(np.uint64)
        at, left, base = [], [], 0
        for data, n, marks in parts:
            at.append(marks.astype(np.int64) + base)
            left.append(np.minimum(n - np.arange(len(marks)) * STRIDE, STRIDE))
            base += 8 * len(data)
        at, left = np.concatenate(at), np.concatenate(left)
        out = np.zeros((STRIDE, len(at)), "<u4")
        lanes = np.arange(len(at))
        for k in range(int(left.max(initial=0))):
            if k and (left <= k).any():  # some blocks end within a stride
                keep = left > k
                lanes, at, left = lanes[keep], at[keep], left[keep]
            code = _bits_at(words, at, self.width)
            out[k, lanes] = self.symbol[code]
            at = at + self.length[code]
        whole = out.T.reshape(-1)
        ends = np.cumsum([-(-n // STRIDE) * STRIDE for _, n, _ in parts])
        return np.concatenate([whole[e - -(-n // STRIDE) * STRIDE :][:n] for e, (_, n, _) in zip(ends, parts)])


# --- files ------------------------------------------------------------------


def write_file(stream, lengths: np.ndarray, codes: np.ndarray, docs: Iterator[tuple[object, np.ndarray]]) -> tuple[int, int]:
    """Writes documents (id, ids); returns their number and the number of ids. The ids of a block at most are in memory.

    Layout: magic; code lengths (size, zlib); blocks; footer (JSON, zlib); its size.
    A block holds whole runs of ids, document borders aside: the footer has each
    document's id and length, and each block's offset, ids and checkpoints' place.
    """
    packed = zlib.compress(lengths.tobytes())
    stream.write(MAGIC + struct.pack("<I", len(packed)) + packed)
    at, blocks, names, sizes = len(MAGIC) + 4 + len(packed), [], [], []
    total = 0

    def flush(ids: np.ndarray) -> None:
        nonlocal at
        bits, marks = pack(ids, lengths, codes)
        blocks.append([at, len(bits), len(marks), len(ids)])
        stream.write(bits + marks.tobytes())
        at += len(bits) + marks.nbytes

    held: list[np.ndarray] = []
    n_held = 0
    for name, ids in docs:
        names.append(name)
        sizes.append(len(ids))
        total += len(ids)
        held.append(ids)
        n_held += len(ids)
        if n_held >= BLOCK_TOKENS:
            ids = np.concatenate(held)
            full = len(ids) // BLOCK_TOKENS * BLOCK_TOKENS
            for i in range(0, full, BLOCK_TOKENS):
                flush(ids[i : i + BLOCK_TOKENS])
            held, n_held = [ids[full:]], len(ids) - full
    if n_held:
        flush(np.concatenate(held))
    footer = zlib.compress(json.dumps({"ids": names, "sizes": sizes, "blocks": blocks}).encode())
    stream.write(footer + struct.pack("<I", len(footer)))
    return len(names), total


def read_file(data: bytes) -> Iterator[tuple[object, np.ndarray]]:
    """Documents of a file in their order; blocks are decoded one by one."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    n = struct.unpack_from("<I", data, len(MAGIC))[0]
    at = len(MAGIC) + 4
    decoder = Decoder(np.frombuffer(zlib.decompress(data[at : at + n]), np.uint8))
    size = struct.unpack("<I", data[-4:])[0]
    footer = json.loads(zlib.decompress(data[-4 - size : -4]))

    def decoded() -> Iterator[np.ndarray]:
        for i in range(0, len(footer["blocks"]), AT_ONCE):
            yield decoder.blocks([(data[at : at + n_bytes], n_ids, np.frombuffer(data[at + n_bytes : at + n_bytes + 4 * n_marks], "<u4")) for at, n_bytes, n_marks, n_ids in footer["blocks"][i : i + AT_ONCE]])

    blocks, rest = decoded(), np.zeros(0, "<u4")
    for name, n_ids in zip(footer["ids"], footer["sizes"]):
        parts, have = [rest], len(rest)
        while have < n_ids:
            parts.append(next(blocks))
            have += len(parts[-1])
        ids = np.concatenate(parts) if len(parts) > 1 else rest
        yield name, ids[:n_ids]
        rest = ids[n_ids:]


# --- the operator -----------------------------------------------------------


def _count(dtype: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            _, ends, data = column.buffers()
            if data is None:
                continue
            ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
            found = np.bincount(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype), minlength=len(counts))
            found[: len(counts)] += counts
            counts = found
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids], pa.int64())], names=["token", "n"])

    return run


def encode_corpus(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """(id, ids): the ids of each whole text and the end id, as bytes; null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(_encode_rows(tokenizer_path, end_id), f"id {kind}, ids binary")


def write_token_files(encoded: DataFrame, folder: str, dtype: str = "<u4", files_of_bytes: int = 64 << 20) -> DataFrame:
    """Writes (id, ids as bytes of dtype) as token files in ascending id order, nulls first; returns the manifest.

    Manifest: file_no, uri, n_docs, n_tokens, base (ids of all files before). Ranges of
    ids are dealt to tasks; the rows of one id come one after another in any order, and
    may be dealt to several tasks. A task begins another file behind the document that
    fills one.
    """
    spark = encoded.sparkSession
    folder = qualified(spark, folder)
    counts = encoded.select("ids").mapInArrow(_count(dtype), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    top = max((r.token for r in counts), default=0)
    table = np.zeros(top + 1, np.int64)
    for r in counts:
        table[r.token] = r.n
    lengths = code_lengths(table)
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    n_tasks = max(int(table.sum() * 4 // files_of_bytes) + 1, spark.sparkContext.defaultParallelism)
    most = max(1, files_of_bytes // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId()
        rows = ((i.as_py(), np.frombuffer(x.as_py(), dtype)) for b in batches for i, x in zip(b.column(0), b.column(1)))
        nth, row = 0, next(rows, None)

        def one_file() -> Iterator[tuple[object, np.ndarray]]:
            nonlocal row
            size = 0
            while row is not None and size < most:
                size += len(row[1])
                yield row
                row = next(rows, None)

        while row is not None:
            with files.create(folder, f"part-{no:05d}-{nth:05d}", ".qtok") as (uri, stream):
                n_docs, n_tokens = write_file(stream, *shared.value, one_file())
            yield pa.RecordBatch.from_pylist([{"task": no, "nth": nth, "uri": uri, "n_docs": n_docs, "n_tokens": n_tokens}])
            nth += 1

    placed = encoded.withColumn("place", F.monotonically_increasing_id())  # so that an id of many rows is dealt to several tasks
    written = placed.repartitionByRange(n_tasks, "id", "place").sortWithinPartitions("id", "place").select("id", "ids").mapInArrow(run, "task long, nth long, uri string, n_docs long, n_tokens long")
    rows, base = [], 0
    for i, r in enumerate(sorted(materialise(written, "token-manifest").collect(), key=lambda r: (r.task, r.nth))):  # a row a file
        rows.append((i, r.uri, r.n_docs, r.n_tokens, base))
        base += r.n_tokens
    return spark.createDataFrame(rows, "file_no long, uri string, n_docs long, n_tokens long, base long")


def read_token_files(manifest: DataFrame, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Rows of the files: id, start (ids of all rows before), n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, rows = r["base"], []
                for name, ids in read_file(files.read_bytes(r["uri"])):
                    rows.append({"id": name, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())} | ({"ids": ids.tolist()} if with_ids else {}))
                    at += len(ids)
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ids = pa.string() if id_type == "string" else pa.int64()
    schema = pa.schema([("id", ids), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])])
    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_corpus(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes docs, writes token files, reads them back: id, start, n_tokens, ids_crc32.

    Null text gives the end id alone. Null ids come first in the order; repeated ids
    stand together, each with its own start. An empty table writes no file and gives
    an empty result. Other columns are not read. The encoded rows are kept in the shared
    folder, since they are counted, ranged and written.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    encoded = materialise(encode_corpus(docs, tokenizer_path, id_col, text_col, end_id), "token-ids")
    kind = docs.schema[id_col].dataType.simpleString()
    return read_token_files(write_token_files(encoded, folder, id_type_of(tokenizer_path)), kind).withColumnRenamed("id", id_col)
