import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.common import scratch_path
from quarry.llm.queries import tokenizer_path
from quarry.llm.token_files import MEMO_CHARS, STRIDE, WordMemo, canonical_codes, code_lengths, encode_corpus, id_type_of, read_file, read_token_files, token_corpus, write_file, write_token_files

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def memo():
    return WordMemo(PATH)


def library(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aZé ß'ſ\n\t.,1½  \x1c 日😀-_<|>", max_size=40) | st.text(max_size=20))
def test_words_are_encoded_as_the_whole_text_is(memo, tokenizer, text):
    assert [np.frombuffer(x, memo.dtype).tolist() for x in memo.encode([text])] == library(tokenizer, [text])


def test_whole_table_is_encoded_as_by_the_library(memo, tokenizer, small_docs):
    texts = [r.text or "" for r in small_docs.collect()] + ["<|endoftext|> a <|endoftext|>\nb", "it's we'll\nI'd", "a b\nc", "\n", " "]
    assert [np.frombuffer(x, memo.dtype).tolist() for x in memo.encode(texts)] == library(tokenizer, texts)


def brute(tokenizer, rows):
    out, at = [], 0
    for doc_id, ids in zip([r[0] for r in rows], library(tokenizer, [r[1] for r in rows])):
        ids = [*ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_odd_rows(tokenizer, odd_docs, no_docs):
    rows = sorted([(r.doc_id, r.text) for r in odd_docs.collect()], key=lambda r: (r[0] is not None, r[0]))
    got = sorted([tuple(r) for r in token_corpus(odd_docs, PATH).collect()], key=lambda r: r[1])
    expected = brute(tokenizer, rows)
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((r[0] or -1, r[2], r[3]) for r in expected)
    assert [r[0] for r in got] == [r[0] for r in expected] and [r[1] for r in got][2:] == [r[1] for r in expected][2:]
    assert token_corpus(no_docs, PATH).count() == 0


def test_whole_table(spark, tokenizer, small_docs, tmp_path):
    rows = sorted((r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect())
    expected = brute(tokenizer, rows)
    assert sorted(map(tuple, token_corpus(small_docs, PATH).collect())) == expected
    encoded = encode_corpus(small_docs, PATH).cache()
    manifest = write_token_files(encoded, f"file://{tmp_path}", id_type_of(PATH), files_of_bytes=200_000)
    assert manifest.count() > 3
    with_ids = {r.id: r.ids for r in read_token_files(manifest, with_ids=True).collect()}
    assert [with_ids[i] for i, _ in rows] == [[*x, 2] for x in library(tokenizer, [t for _, t in rows])]


def test_an_id_that_holds_most_rows_is_dealt_to_several_files(spark, tokenizer):
    """Null ids alone: their rows part, files stay small, and places follow one another."""
    docs = spark.range(4000).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat('text ', id % 50) AS text")
    encoded = encode_corpus(docs, PATH)
    manifest = write_token_files(encoded, scratch_path(spark, "hot"), id_type_of(PATH), files_of_bytes=4000).collect()
    assert len(manifest) >= 10 and max(m.n_docs for m in manifest) <= 1000
    rows = sorted(read_token_files(spark.createDataFrame(manifest)).collect(), key=lambda r: r.start)
    assert len(rows) == 4000 and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_long_words_never_stay(memo, tokenizer):
    texts = [f"a {chr(97 + i) * 10_000} b{i}" for i in range(20)]
    assert [np.frombuffer(x, memo.dtype).tolist() for x in memo.encode(texts)] == library(tokenizer, texts)
    assert max(map(len, memo)) <= MEMO_CHARS + 1
    small = WordMemo(PATH, limit=500)
    for k in range(20):
        small.encode([" ".join(f"w{k}x{i}" for i in range(200))])
        assert len(small) <= 700


def kraft(lengths):
    return sum(2.0 ** -int(n) for n in lengths if n)


def huffman_cost(counts):
    import heapq

    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=40))
def test_lengths_without_a_tight_limit_are_huffmans(counts):
    lengths = code_lengths(np.array(counts), 40)
    assert all((n > 0) == (c > 0) for n, c in zip(lengths, counts))
    if sum(c > 0 for c in counts) > 1:
        assert kraft(lengths) == 1.0 and sum(int(n) * c for n, c in zip(lengths, counts)) == huffman_cost(counts)


def best_limited(counts, limit):
    """Least cost by trying all sorted lengths."""
    counts = sorted((c for c in counts if c), reverse=True)
    best = [float("inf")]

    def go(i, least, room, cost):
        if i == len(counts):
            best[0] = min(best[0], cost)
            return
        for n in range(least, limit + 1):
            if 2.0**-n <= room + 1e-12 and cost + n * counts[i] < best[0]:
                go(i + 1, n, room - 2.0**-n, cost + n * counts[i])

    go(0, 1, 1.0, 0)
    return best[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10**5), min_size=2, max_size=7), st.integers(3, 5))
def test_limited_lengths_are_the_best(counts, limit):
    lengths = code_lengths(np.array(counts), limit)
    assert max(lengths) <= limit and kraft(lengths) <= 1
    assert sum(int(n) * c for n, c in zip(lengths, counts)) == best_limited(counts, limit)


def test_too_many_symbols():
    with pytest.raises(ValueError, match="5 symbols"):
        code_lengths(np.ones(5, np.int64), 2)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=0, max_size=3 * STRIDE), max_size=8), st.integers(0, 2))
def test_files_round_trip(docs, more):
    docs = docs + [[7] * 70_000] * more
    counts = np.bincount(np.concatenate([np.zeros(0, int), *[np.array(d, int) for d in docs]]).astype(int), minlength=1)
    lengths = code_lengths(counts)
    out = io.BytesIO()
    assert write_file(out, lengths, canonical_codes(lengths), ((i, np.array(d, "<u4")) for i, d in enumerate(docs))) == (len(docs), sum(map(len, docs)))
    assert [(i, ids.tolist()) for i, ids in read_file(out.getvalue())] == list(enumerate(docs))


def test_not_a_token_file():
    with pytest.raises(ValueError, match="not a token file"):
        list(read_file(b"something else"))
