"""Sub-word pieces: N-best segmentation of whole texts, and decoding.

The lattice of a text has an edge for each piece that stands at a place, and one for an
unknown character. Best scores from the left (forward Viterbi) are exact heuristics
for an A* search from the right end, so segmentations leave it in order of their scores.

No piece but runs of spaces has a space behind its first character, so no edge spans
the place before a run of spaces: there the lattice falls into words, and a
segmentation of a text is one of each word. Words are met again and again; each
distinct word is solved once for its best path and for the gap to its second best
(arrays of many words at a time, along the prefixes of pieces that stand in them). Only the n - 1 words of a text with the smallest gaps
can differ from their best in its n best segmentations: for those the A* search is run,
and a second one combines them.

Every hypothesis of the search stands for segmentations that no other one has, and one of
them reaches its bound. So those that n others beat are dropped at once: the agenda
never holds more than n, the deepest of equal ones goes first, and no more than n * length
hypotheses are ever opened, however many segmentations tie.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks_of, column, held

SPACE = "▁"
#: Words of fewer characters are solved as arrays, so many at a time.
ARRAY_CHARS, ARRAY_WORDS = 20, 4096
#: Bytes of a worker's memo, about; longest word that it keeps; characters of the texts that are solved together.
MEMO_BYTES, MEMO_CHARS, TOGETHER = 48 << 20, 64, 1 << 18
#: What a word of the memo takes beside its ids and characters, and so a segmentation of a word's list; share of the memo that may stay when it is full.
ENTRY, LIST_ENTRY, STAYS = 200, 300, 0.7
#: Bits of a prefix key that are its slot.
SLOT_BITS = 18
#: What an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0
_P = np.uint64(0x9E3779B97F4A7C15)


class Memo:
    """Words and the best path of each: ids, score, gap to the second best. Rows of arrays, read many at a time."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ids, self.ends, self.scores, self.gaps, self.again = array("I"), array("q", [0]), array("d"), array("d"), bytearray()

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[str]:
        return iter(self.rows)

    def __getitem__(self, word: str) -> tuple[bytes, float, float]:
        row = self.rows[word]
        return self.ids[self.ends[row] : self.ends[row + 1]].tobytes(), self.scores[row], self.gaps[row]

    def pop(self, word: str, *default) -> tuple[bytes, float, float]:
        if word not in self.rows and default:
            return default[0]
        found = self[word]
        del self.rows[word]
        return found

    def add(self, words: list[str], ids: np.ndarray, counts: np.ndarray, scores: np.ndarray, gaps: np.ndarray) -> None:
        """New words; ids are those of all of them, counts how many each has."""
        n = len(self.scores)
        self.rows.update(zip(words, range(n, n + len(words))))
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(counts, dtype=np.int64)).tobytes())
        self.scores.frombytes(scores.tobytes())
        self.gaps.frombytes(gaps.tobytes())
        self.again += bytes(len(words))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What add() takes, of those rows."""
        if not len(rows):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        ends = np.frombuffer(self.ends, np.int64)
        start = ends[rows]
        counts = ends[rows + 1] - start
        behind = np.cumsum(counts)
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(start - behind + counts, counts) + np.arange(behind[-1])]
        return ids.astype("<u4", copy=False), counts, np.frombuffer(self.scores)[rows], np.frombuffer(self.gaps)[rows]

    def mark(self, rows: np.ndarray) -> None:
        """These are met again."""
        np.frombuffer(self.again, np.uint8)[rows] = 1

    def drop_last(self, words: list[str]) -> None:
        """Forgets the words that were added last."""
        for word in words:
            del self.rows[word]
        n = len(self.scores) - len(words)
        del self.ids[self.ends[n] :], self.ends[n + 1 :], self.scores[n:], self.gaps[n:], self.again[n:]

    def keep(self, words: list[str]) -> None:
        """Forgets all others."""
        kept = self.take(np.array([self.rows[w] for w in words], np.int64))
        self.__init__()
        self.add(words, *kept)


class Lattice:
    """Pieces of a SentencePiece model file, with byte pieces for what they don't cover."""

    def __init__(self, path: str, memo: int = MEMO_BYTES):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.sizes = [len(sp.id_to_piece(i)) for i in range(n)]
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                self.scores[piece] = (sp.get_score(i), i)
        self.unknown_id = sp.unk_id()
        self.unknown = min(s for s, _ in self.scores.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.scores))
        self.by_words = all(set(p) == {SPACE} for p in self.scores if SPACE in p[1:])
        self.limit, self.weight = memo, 0
        self.memo = Memo()
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        # prefixes of pieces by the slot of their key: those of slot i are entries first[i] to first[i + 1]; the last value and id are an unknown character's
        short = [p for p in self.scores if len(p) <= ARRAY_CHARS]
        longer = {p[:k] for p in short for k in range(1, len(p))}
        prefixes = sorted(longer.union(short), key=len)
        sizes = np.array(list(map(len, prefixes)))
        flat, at, keys = np.frombuffer("".join(prefixes).encode("utf-32-le", "surrogatepass"), "<u4"), 0, []
        self.most = int(sizes[-1])
        for size in range(1, self.most + 1):
            n = int((sizes == size).sum())
            keys.append(self._keys(flat[at : at + n * size].reshape(n, size)))
            at += n * size
        order = np.argsort(found := np.concatenate(keys))
        self.keys = found[order]
        known = [self.scores.get(p, (-np.inf, 0)) for p in prefixes]
        self.values = np.append(np.array([v for v, _ in known])[order], self.unknown)
        self.ids = np.append(np.array([i for _, i in known], np.int32)[order], np.int32(self.unknown_id))
        self.goes_on = np.array([p in longer for p in prefixes])[order]
        self.first = np.searchsorted(self.keys >> np.uint64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def _find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are prefixes', and those prefixes' entries. Most slots hold one or none, so most keys need one look."""
        slot = (asked >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        entry, end = self.first[slot], self.first[slot + 1]
        open_ = np.flatnonzero(entry < end)
        entry, end = entry[open_], end[open_]
        places, entries = [], []
        while len(open_):
            same = self.keys[entry] == asked[open_]
            places.append(open_[same])
            entries.append(entry[same])
            entry = entry + 1
            more = ~same & (entry < end)
            open_, entry, end = open_[more], entry[more], end[more]
        return (np.concatenate(places), np.concatenate(entries)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    @staticmethod
    def _keys(chars: np.ndarray) -> np.ndarray:
        key = np.zeros(len(chars), np.uint64)
        for k in range(chars.shape[1]):
            key = Lattice._next(key, chars[:, k])
        return key

    @staticmethod
    def _next(key: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = (key ^ (char.astype(np.uint64) + np.uint64(1))) * _P
        return key ^ (key >> np.uint64(31))

    # --- one word or text, edge by edge

    def edges(self, text: str, end: int) -> Iterator[tuple[int, float, int]]:
        """Edges that end at a place: start, score, id; an unknown character only where no piece is one character."""
        alone = False
        for start in range(max(0, end - self.longest), end):
            if (found := self.scores.get(text[start:end])) is not None:
                alone |= start == end - 1
                yield start, *found
        if not alone:
            yield end - 1, self.unknown, self.unknown_id

    def forward(self, text: str) -> array:
        """Best score of each place from the left."""
        best = array("d", [0.0])
        for end in range(1, len(text) + 1):
            best.append(max([best[start] + score for start, score, _ in self.edges(text, end)]))
        return best

    def search(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations, (score, ids), by A* from the right end.

        A hypothesis is a path from a place to the end; its score and the best score of
        the place from the left bound all its completions, and are reached.
        """
        best = self.forward(text)
        agenda: list = [(-best[-1], len(text), 0, 0.0, None)]
        pushed, out = 0, []
        while agenda:
            _, at, _, done, path = agenda.pop(0)
            if at == 0:
                out.append((done, self._spelled_out(text, path)))
                continue
            for start, score, i in self.edges(text, at):
                pushed += 1
                insort(agenda, (-(best[start] + done + score), start, pushed, done + score, (i, start, path)))
                del agenda[n - len(out) :]
        return out

    def _spelled_out(self, text: str, path: tuple | None) -> bytes:
        ids: list[int] = []
        while path:
            i, start, path = path
            ids += self.ids_of(i, text[start])
        return np.array(ids, "<u4").tobytes()

    def ids_of(self, i: int, piece: str) -> list[int]:
        """An unknown character becomes its bytes' pieces where the model has them."""
        if i != self.unknown_id or not self.byte_ids:
            return [i]
        return [self.byte_ids[b] for b in piece.replace(SPACE, " ").encode("utf-8", "surrogatepass")]

    def list_of(self, word: str, n: int) -> list[tuple[float, bytes]]:
        if (word, n) in self.lists:
            return self.lists[word, n]
        found = self.search(word, n)
        if len(word) <= MEMO_CHARS:
            self.lists[word, n] = found
            self.weight += sum(LIST_ENTRY + len(ids) for _, ids in found)
        return found

    # --- many words at a time

    def learn(self, words: Iterable[str]) -> list[str]:
        """Puts ids, score and gap to the second best of each word into the memo, last those that are too long to stay there; returns these."""
        words = sorted(words, key=len)
        n = bisect_left(words, ARRAY_CHARS, key=len)
        for at in range(0, n, ARRAY_WORDS):
            self._learn_arrays(words[at : min(at + ARRAY_WORDS, n)])
        for word in words[n:]:
            found = self.search(self.spelled(word), 2)
            ids = np.frombuffer(found[0][1], "<u4")
            self.memo.add([word], ids, np.array([len(ids)]), np.array([found[0][0]]), np.array([found[0][0] - found[1][0] if len(found) > 1 else np.inf]))
        stay = bisect_left(words, MEMO_CHARS + 1, key=len)
        self.weight += sum(map(self._weight, words[:stay]))
        return words[stay:]

    @staticmethod
    def _weight(word: str) -> int:
        return ENTRY + 5 * len(word)

    def _forget(self) -> None:
        """Makes room: words that were met in one run of texts alone go, and all where few of them are so."""
        memo = self.memo
        kept = [w for w, row in memo.rows.items() if memo.again[row]]
        self.weight = sum(map(self._weight, kept))
        if self.weight > STAYS * self.limit:
            kept, self.weight = [], 0
        memo.keep(kept)
        self.lists.clear()

    def _learn_arrays(self, keys: list[str]) -> None:
        n = len(keys)
        sizes = np.array(list(map(len, keys))) + 1
        joined = SPACE + SPACE.join(keys)
        if len(joined) != sizes.sum() or joined.count(SPACE) != n or not self.by_words:  # some bring their own spaces
            words = list(map(self.spelled, keys))
            sizes = np.array(list(map(len, words)))
            joined = "".join(words)
        width = int(sizes.max())
        places = np.arange(width)[:, None]
        # place first, so that a place of all words is one run; characters count from 1 (see _next)
        flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        starts = np.cumsum(sizes) - sizes
        cell = (np.arange(len(flat)) - np.repeat(starts, sizes)) * n + np.repeat(np.arange(n), sizes)
        chars = np.zeros(width * n, np.uint64)
        chars[cell] = flat
        left_over = (sizes - places).reshape(-1)
        # prefixes of k + 1 characters that start at each place, while there are any
        found, at, key = [], cell, np.zeros(len(cell), np.uint64)
        for k in range(min(self.most, width)):
            key = self._next(key, chars[at + k * n])
            hit, entry = self._find(key)
            at = at[hit]
            found.append((at, entry))
            on = np.flatnonzero(self.goes_on[entry] & (left_over[at] > k + 1))
            at, key = at[on], key[hit[on]]
            if not len(at):
                break
        most = len(found)
        score = np.full((most, width, n), -np.inf)
        entries = np.empty((most, width, n), np.int32)
        for k, (at, entry) in enumerate(found):
            score[k].reshape(-1)[at] = self.values[entry]
            entries[k].reshape(-1)[at] = entry
        lone = (score[0] == -np.inf) & (places < sizes)
        score[0][lone], entries[0][lone] = self.unknown, len(self.ids) - 1
        left = np.full((width + 1, n), -np.inf)
        left[0] = 0.0
        came = np.zeros((width + 1, n), np.int8)
        for end in range(1, width + 1):
            for k in range(min(end, most)):
                new = left[end - 1 - k] + score[k, end - 1 - k]
                better = new > left[end]
                np.copyto(left[end], new, where=better)
                np.copyto(came[end], np.int8(k + 1), where=better)
        every = np.arange(n)
        right = np.full((width + 1, n), -np.inf)
        right[sizes, every] = 0.0
        for start in range(width - 1, -1, -1):
            for k in range(min(width - start, most)):
                np.maximum(right[start], score[k, start] + right[start + 1 + k], out=right[start])
        total = left[sizes, every]
        # the best path, from its end; its edges are then out of the question for the second best
        at, path = sizes.copy(), []
        through = score
        while (live := at > 0).any():
            k = came[at, every]
            start = at - k
            path.append(np.where(live, entries[k - 1, start, every], -1))
            w = every[live]
            through[k[live] - 1, start[live], w] = -np.inf
            at = np.where(live, start, 0)
        second = np.full(n, -np.inf)
        for k in range(most):
            np.maximum(second, (left[: width - k] + through[k, : width - k] + right[k + 1 :]).max(0), out=second)
        table = np.stack(path[::-1], 1)
        used = table >= 0
        counts = used.sum(1)
        ids = self.ids[table[used]]
        odd = np.flatnonzero((table == len(self.ids) - 1).any(1))
        if len(odd) and self.byte_ids:
            own = np.repeat(np.isin(every, odd), counts)
            ends = np.cumsum(counts)
            spelled = [self._with_bytes(joined[starts[w] : starts[w] + sizes[w]], ids[ends[w] - counts[w] : ends[w]].tolist()) for w in odd.tolist()]
            counts[odd] = list(map(len, spelled))
            plain, ids = ids[~own], np.empty(counts.sum(), np.int32)
            own = np.repeat(np.isin(every, odd), counts)
            ids[~own], ids[own] = plain, list(chain.from_iterable(spelled))
        self.memo.add(keys, ids, counts, total, total - second)

    def _with_bytes(self, word: str, path: list[int]) -> list[int]:
        ids: list[int] = []
        at = 0
        for i in path:
            size = 1 if i == self.unknown_id else self.sizes[i]
            ids += self.ids_of(i, word[at : at + size])
            at += size
        return ids

    # --- texts

    def words(self, text: str) -> list[str]:
        """The words of a text; one more space begins the text.

        A word behind one space stands without it, any other with all its spaces.
        """
        if not text:
            return []
        flat = text.replace(" ", SPACE)
        if not self.by_words:
            return [SPACE + SPACE + flat]  # one word; the first mark says that it is whole
        if SPACE * 2 not in flat and flat[0] != SPACE:
            return flat.split(SPACE)
        out, spaces = [], 0
        for w in flat.split(SPACE):
            spaces += 1
            if w:
                out.append(w if spaces == 1 else SPACE * spaces + w)
                spaces = 0
        return [*out, SPACE * spaces if spaces > 1 else ""] if spaces else out

    def spelled(self, word: str) -> str:
        """A word of words() with its spaces."""
        if not self.by_words:
            return word[1:]
        return word if word.startswith(SPACE) else SPACE + word

    def segment(self, texts: list[str], n: int) -> Iterator[list[tuple[float, bytes]]]:
        """The n best segmentations of each text, (score, ids); one without ids for an empty text."""
        parts = [self.words(t) for t in texts]
        if self.weight > self.limit:
            self._forget()
        memo, known = self.memo, len(self.memo.scores)
        long = self.learn(set().union(*parts).difference(memo.rows))
        sizes = list(map(len, parts))
        rows = np.fromiter(map(memo.rows.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        flat, counts, scores, gaps = memo.take(rows)
        memo.mark(rows[rows < known])
        memo.drop_last(long)
        ids, ends = flat.tobytes(), np.append(0, 4 * np.cumsum(counts))
        a = 0
        for words, size in zip(parts, sizes):
            b = a + size
            out = [(float(scores[a:b].sum()), ids[ends[a] : ends[b]])]
            if n > 1 and words:
                out += self._others(words, *out[0], ends[a : b + 1] - ends[a], gaps[a:b], n)
            yield out
            a = b

    def _others(self, words: list[str], base: float, ids: bytes, ends: np.ndarray, gaps: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        """Second to n-th best: A* over the words with the smallest gaps, whose best losses are exact bounds. Word i's ids end at ends[i + 1]."""
        smallest = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) >= n else np.arange(len(gaps))
        open_words = sorted(smallest[gaps[smallest] < np.inf].tolist())
        spans = [(int(ends[i]), int(ends[i + 1])) for i in open_words]
        choices = []
        for i, (start, end) in zip(open_words, spans):
            ways, own = self.list_of(self.spelled(words[i]), n), ids[start:end]
            if ways[0][1] != own:  # of equal scores, the best path stays first
                ways = [(ways[0][0], own), *(w for w in ways if w[1] != own)][:n]
            choices.append(ways)
        agenda = [(0.0, (0,) * len(choices))]
        seen, out = {agenda[0][1]}, []
        while agenda and len(out) < n:
            loss, picks = heapq.heappop(agenda)
            if any(picks):
                new, done = [], 0
                for (start, end), k, c in zip(spans, picks, choices):
                    if k:
                        new += ids[done:start], c[k][1]
                        done = end
                out.append((base - loss, b"".join([*new, ids[done:]])))
                if len(out) == n - 1:
                    break
            for j, c in enumerate(choices):
                if picks[j] + 1 < len(c):
                    more = picks[:j] + (picks[j] + 1,) + picks[j + 1 :]
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(agenda, (loss + c[picks[j]][0] - c[picks[j] + 1][0], more))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that begins each text; broken bytes become U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")


def lattice(path: str) -> Lattice:
    return held(("pieces", path), lambda: Lattice(path))


def _segment(path: str, n: int, digests: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(path)
        for batch in batches:
            at = 0
            for texts in chunks_of(batch.column(1), TOGETHER):
                texts = [t or "" for t in texts]
                found = list(pieces.segment(texts, n))
                ids = [f[0][1] for f in found]
                arrays = [np.frombuffer(i, "<u4") for i in ids]
                back = [pieces.decode(a.tolist()) for a in arrays]
                columns = [
                    batch.column(0).slice(at, len(texts)), pa.array(map(len, arrays), pa.int64()), pa.array((f[0][0] for f in found), pa.float64()),
                    pa.array((t.replace(SPACE, " ") == b for t, b in zip(texts, back)), pa.bool_()),
                ]
                at += len(texts)
                if digests:
                    columns += [
                        pa.array((zlib.crc32(i) for i in ids), pa.int64()), pa.array((hashlib.sha256(b.encode("utf-8", "replace")).hexdigest() for b in back), pa.string()),
                        pa.array(([s for s, _ in f] for f in found), pa.list_(pa.float64())), pa.array(([zlib.crc32(i) for _, i in f] for f in found), pa.list_(pa.int64())),
                    ]
                else:
                    columns += [pa.array((a.tolist() for a in arrays), pa.list_(pa.int32())), pa.array(back, pa.string()), pa.array(([{"score": s, "ids": np.frombuffer(i, "<u4").tolist()} for s, i in f[1:]] for f in found), pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))])))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_pieces", "score", "round_trip", *(["ids_crc32", "decoded_sha256", "nbest_scores", "nbest_crc32"] if digests else ["ids", "decoded", "others"])])

    return run


def encode_pieces(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_pieces, score, round_trip, and ids, decoded, others.

    ids are those of the best segmentation of the whole text, decoded is their text;
    round_trip says whether that is the text again (U+2581 counts as a space). others
    are the second to n-th best, (score, ids), fewer where the lattice has fewer paths.
    With digests: ids_crc32, decoded_sha256, nbest_scores, nbest_crc32 (of ids as
    little-endian unsigned 32-bit integers) stand for the arrays. Null and empty texts
    have no pieces, score 0, one empty segmentation. Ties keep the order in which the
    search meets them. Rows are independent: repeated rows give repeated results, an
    empty table an empty one; only id and text are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    more = "ids_crc32 long, decoded_sha256 string, nbest_scores array<double>, nbest_crc32 array<long>" if digests else "ids array<int>, decoded string, others array<struct<score:double,ids:array<int>>>"
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return rows.mapInArrow(_segment(model_path, n, digests), f"id {kind}, n_pieces long, score double, round_trip boolean, {more}").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text of rows with ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(column(id_col).alias("id"), column(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
