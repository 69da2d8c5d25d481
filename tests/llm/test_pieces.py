import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.pieces import ARRAY_CHARS, MEMO_CHARS, Lattice, decode_pieces, encode_pieces
from quarry.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return Lattice(PATH)


def every_path(lattice, text):
    """Scores of all segmentations."""
    ways = [[0.0]] + [None] * len(text)
    for end in range(1, len(text) + 1):
        ways[end] = [a + score for start, score, _ in lattice.edges(text, end) for a in ways[start]]
    return ways[-1]


def best_scores(lattice, text, n):
    flat = "▁" + text.replace(" ", "▁") if text else ""
    return heapq.nlargest(n, every_path(lattice, flat)) if text else [0.0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab cdin é日\n▁.", max_size=9), st.integers(1, 6))
def test_n_best_are_the_n_best_of_all_paths(lattice, text, n):
    [found] = lattice.segment([text], n)
    expected = best_scores(lattice, text, n)
    assert [s for s, _ in found] == pytest.approx(expected)
    assert len({i for _, i in found}) == len(found)
    for _, ids in found:
        assert lattice.decode(np.frombuffer(ids, "<u4").tolist()) == text.replace("▁", " ")


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="abcdefghin", min_size=1, max_size=ARRAY_CHARS + 6))
def test_arrays_agree_with_the_search(lattice, word):
    lattice.memo.pop(word, None)
    lattice.learn([word])
    ids, score, gap = lattice.memo[word]
    found = lattice.search("▁" + word, 2)
    assert score == pytest.approx(found[0][0]) and gap == pytest.approx(found[0][0] - found[1][0])
    assert sum(lattice.scores[p][0] for p in pieces_of(lattice, ids)) == pytest.approx(score)


def kept_paths(lattice, text, n):
    """Scores of the n best segmentations, by keeping the n best of every place."""
    ways = [[0.0]]
    for end in range(1, len(text) + 1):
        ways.append(heapq.nlargest(n, [a + score for start, score, _ in lattice.edges(text, end) for a in ways[start]]))
    return ways[-1]


@pytest.mark.parametrize("size", [200, 600, 1001, 5000, 20_000])
@pytest.mark.parametrize("unit", ["-", "#", "a", "ab", "=-", "日本", "aab"])
def test_long_words_of_equal_scores(lattice, unit, size):
    """Many orderings of the same pieces tie; the search opens no more than n hypotheses a place."""
    import time

    word = (unit * size)[:size]
    before = time.time()
    found = lattice.search("▁" + word, 2)
    assert time.time() - before < 1
    if size <= 1001:
        lattice._learn_arrays([word])
        ids, score, gap = lattice.memo.pop(word)
        assert score == found[0][0] and gap == (found[0][0] - found[1][0] if len(found) > 1 else np.inf)
    [some] = lattice.segment([word], 4)
    assert [s for s, _ in some] == kept_paths(lattice, "▁" + word, 4) and len({i for _, i in some}) == len(some)
    assert all(lattice.decode(np.frombuffer(i, "<u4").tolist()) == word for _, i in some)


@pytest.mark.parametrize("text", ["\n" + "#" * 300 + "\n", ("-" * 79 + "\nword\n") * 20, "x " + "-" * 600 + " y " + "-" * 1000, ("=" * 40 + " ") * 30])
def test_rules_in_texts(lattice, text):
    [found] = lattice.segment([text], 4)
    assert [s for s, _ in found] == pytest.approx(kept_paths(lattice, "▁" + text.replace(" ", "▁"), 4))


def test_long_words_never_stay():
    own = Lattice(PATH, memo=200_000)
    for k in range(30):
        list(own.segment([f"{k} " + "".join(chr(97 + (i * i + k) % 26) for i in range(3000)) + f" w{k} " + " ".join(f"q{k}x{i}" for i in range(150))], 3))
        assert own.weight <= 400_000
    assert max(map(len, own.memo)) <= MEMO_CHARS and max(len(w) for w, _ in own.lists) <= MEMO_CHARS


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ▁\n", max_size=12))
def test_words_make_up_the_text(lattice, text):
    assert "".join(map(lattice.spelled, lattice.words(text))) == ("▁" + text.replace(" ", "▁") if text else "")


def pieces_of(lattice, ids):
    by_id = {i: p for p, (_, i) in lattice.scores.items()}
    return [by_id[i] for i in np.frombuffer(ids, "<u4").tolist()]


def test_the_library_agrees_as_a_unigram_model(lattice, small_docs):
    """The same pieces and scores under the library's own n-best search; its sums are 32-bit."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [r.text for r in small_docs.where("length(text) < 300").select("text").limit(60).collect() if r.text]
    for text, found in zip(texts, lattice.segment(texts, 1)):
        theirs = library.encode(text)
        if not any(library.is_byte(i) for i in theirs):
            assert found[0][0] >= sum(library.get_score(i) for i in theirs) - 1e-6


def test_odd_rows(spark, odd_docs, no_docs):
    rows = encode_pieces(odd_docs, PATH, n=3)
    assert rows.columns == ["doc_id", "n_pieces", "score", "round_trip", "ids", "decoded", "others"]
    got = rows.collect()
    assert len(got) == odd_docs.count() and all(r.round_trip for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].ids == [] and by_id[1].ids == [] and by_id[0].others == []
    assert len(by_id[6].others) == 2 and by_id[6].others[0].score >= by_id[6].others[1].score
    back = {r.doc_id: r.text for r in decode_pieces(rows, PATH).collect()}
    assert back[8] == "é ß 日本語 \u00a0x" and back[10] == "word " * 20000 and back[0] == ""
    assert encode_pieces(no_docs, PATH, digests=True).count() == 0


def test_whole_table_round_trip(small_docs):
    rows = encode_pieces(small_docs, PATH, digests=True).collect()
    assert len(rows) == small_docs.count() and all(r.round_trip for r in rows)
    assert all(a >= b for r in rows for a, b in zip(r.nbest_scores, r.nbest_scores[1:]))


def test_words_met_again_are_learned_once():
    own = Lattice(PATH, memo=200_000)
    learned, learn, common = [], own.learn, "some words that begin all texts and".split()
    own.learn = lambda words: (learned.extend(words), learn(words))[1]
    texts = [" ".join(common + [f"q{k}x{i}" for i in range(150)]) for k in range(30)]
    found = [list(own.segment([t], 3)) for t in texts]
    assert len(learned) > len(own.memo) and [learned.count(w) for w in common] == [1] * len(common)
    assert found[::15] == [list(Lattice(PATH).segment([t], 3)) for t in texts[::15]]
