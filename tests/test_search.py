"""Keyword, vector, sparse search and fusion."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import fusion, keyword, postings, sparse, vector

DOCS = [
    "Seven tall ships left the harbour before sunrise.", "Copper kettle, copper spoon", "The harbour lights went out one by one.", "Ein Größenvergleich der Häfen", "oooo ooo", "kettle kettle ships",
    "", "unharboured grief", "old maps of coasts and islands", "rain again", "three rows of figs", "one basket of plums",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)] + [(99, None)], "chunk_id int, content string").cache()


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, tokenize='trigram')")
    con.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", [*((i + 1, d) for i, d in enumerate(DOCS)), (100, "")])
    return con


@pytest.mark.parametrize("q", ["kettle", "ships kettle", "Harbour out", "größen", "ooo", "ships OR rain", "kettle NOT ships", "of kettle", "copper copper", "ships AND harbour OR rain", "maps OR figs NOT rows", "rain OR copper spoon"])
def test_bm25_is_that_of_fts5(docs, fts, q):
    expected = {r[0] - 1: r[1] for r in fts.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (keyword.clean(q),))}
    found = {r.chunk_id: r.bm25 for r in keyword.bm25(docs, q).collect()}
    assert found.keys() == expected.keys()
    for k in found:
        assert found[k] == pytest.approx(expected[k], rel=1e-9, abs=1e-12)


ODD = ["\U0001f600\U0001f601 smile \U0001f600\U0001f601", "aaaa aaaaa", "ab", "Größengrößen größ", "kettle\nkettle", "shi ps ship", "x" * 3000 + "yz" * 2000]


@pytest.mark.parametrize("q", ["kettle", "ships kettle", "größen", "ooo", "aaa", "aaaa OR ooo", "kettle NOT ships", "xyzyz", "harbour", "\U0001f600\U0001f601 smi", "of ships", "NOT kettle", "nowhere"])
def test_index_finds_what_the_scan_finds(spark, docs, q, monkeypatch):
    rows = docs.unionByName(spark.createDataFrame([(200 + i, t) for i, t in enumerate(ODD)], "chunk_id int, content string"))
    monkeypatch.setattr(postings, "SLICE", 50)
    index = postings.build(rows)
    got, want = ({r.chunk_id: r.bm25 for r in f.collect()} for f in (postings.bm25(index, q), keyword.bm25(rows, q)))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)


def test_index_holds_every_place(spark):
    texts = [*DOCS, *ODD, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")
    want = {}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        want[i, postings.WHOLE] = (max(len(low) - 2, 0), ())
        for at in range(len(low) - 2):
            n, places = want.get((i, postings.gram(low[at : at + 3])), (len(low) - 2, ()))
            want[i, postings.gram(low[at : at + 3])] = (n, (*places, at))
    assert {(r.chunk_id, r.term): (r.length, tuple(r.places)) for r in postings.build(rows).collect()} == want
    assert postings.build(rows.limit(0)).count() == 0 and postings.bm25(postings.build(rows.limit(0)), "kettle").count() == 0


def test_queries_that_find_nothing(docs):
    for q in ("an of", "ships OR", "NOT kettle"):
        assert keyword.bm25(docs, q).count() == 0
    assert keyword.parse("kettle!", strict=True) is None
    assert keyword.bm25(docs, "copper; spoon").count() == 1
    assert keyword.bm25(docs, "copper; spoon", strict=True).count() == 0
    assert keyword.keyword_search(docs, "\t ").count() == 0
    assert keyword.keyword_search(docs.limit(0), "kettle").count() == 0


def test_like_fallback_and_scores(docs):
    rows = keyword.keyword_search(docs, "AI").collect()
    assert [r.chunk_id for r in rows] == [9] and all(r.score == pytest.approx(1 / 11) for r in rows)
    assert keyword.keyword_search(docs, "Ä").count() == 0 and keyword.keyword_search(docs, "HÄ").count() == 0  # ASCII case alone is folded
    assert keyword.keyword_search(docs, "hä").count() == 1
    assert keyword.keyword_search(docs, "f_").count() >= 2
    values = [3.0, -2.5, -10.0, -90.0]
    s = docs.limit(1).select(*[keyword.to_score(F.lit(x)).alias(str(i)) for i, x in enumerate(values)]).first()
    assert list(s) == pytest.approx([max(-x, 0) / (max(-x, 0) + 10) for x in values])


VECTORS = [(0, [1.0, 0.0], "a"), (1, [0.6, 0.8], "b"), (2, [0.0, 1.0], "a"), (3, [-1.0, 0.0], "b"), (4, [1.0, 0.0, 0.0], "a")]


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame(VECTORS, "chunk_id int, embedding array<float>, label string").cache()


def test_top_k_scales_and_dimension(vecs):
    for scale, expected in (("shifted", [1.0, 0.8, 0.5]), ("cosine", [1.0, 0.6, 0.0]), ("clamped", [1.0, 0.6, 0.0])):
        rows = vector.top_k(vecs, [1.0, 0.0], 3, scale=scale).collect()
        assert [r.chunk_id for r in rows] == [0, 1, 2] and [r.score for r in rows] == pytest.approx(expected, abs=1e-6)
    assert [r.chunk_id for r in vector.top_k(vecs, [1.0, 0.0, 0.0], 5).collect()] == [4]
    assert vector.top_k(vecs, [], 5).count() == 0


def test_top_k_plan_is_an_ordered_take(vecs):
    plan = vector.top_k(vecs, [1.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Join" not in plan


def test_floor_and_fallback(vecs):
    two = vecs.where("size(embedding) = 2")
    assert sorted(r.chunk_id for r in vector.vector_search(two, [1.0, 0.0], 10, scale="cosine").collect()) == [0, 1]
    assert sorted(r.chunk_id for r in vector.vector_search(two, [0.0, -1.0], 2, scale="clamped").collect()) == [0, 1]
    assert vector.vector_search(two, [1.0, 0.0], 1, scale="cosine").count() == 1


def test_batches_and_groups(vecs):
    two = vecs.where("size(embedding) = 2")
    asked = two.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = vector.batch_top_k(two, asked, 1, block=3).collect()
    assert sorted((r.query_id, r.chunk_id) for r in rows) == [(i, i) for i in range(4)]
    grouped = vector.top_k_by_group(two, [1.0, 0.0], 1, "label").collect()
    assert sorted((r.label, r.chunk_id) for r in grouped) == [("a", 0), ("b", 1)]


def test_inverted_file_recall(spark):
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector.InvertedFile.build(emb, 64, key="vec_id")
    exact = {(r.query_id, r.vec_id) for r in vector.batch_top_k(emb, asked, 10, "vec_id").collect()}
    near = {(r.query_id, r.vec_id) for r in index.search_batch(asked, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    [first] = asked.limit(1).collect()
    assert {(first.query_id, r.vec_id) for r in index.search(list(first.query), 10).collect()} == {p for p in near if p[0] == first.query_id}


def test_vector_columns(spark):
    row = spark.range(1).select(V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), V.l2_normalize(F.array(F.lit(0.0))).alias("z"), V.from_distance(F.lit(1.0)).alias("d")).first()
    assert row.u == pytest.approx([0.6, 0.8]) and row.z == [0.0] and row.d == pytest.approx(0.5)
    assert V.decode_f32(V.encode_f32([1.5, -2.0])) == [1.5, -2.0]
    assert vector.use_ann(2000) and not vector.use_ann(1999) and vector.use_ann(1, "force") and not vector.use_ann(10**6, "off")


def test_sparse(spark):
    rows = spark.createDataFrame([(0, {1: 1.0, 2: 2.0}), (1, {2: 1.0}), (2, {3: 1.0}), (3, {2: -1.0})], "chunk_id int, weights map<int,float>")
    for found in (sparse.sparse_search(rows, {1: 1.0, 2: 0.5}, 5), sparse.search_postings(sparse.postings(rows), {1: 1.0, 2: 0.5}, 5)):
        assert [(r.chunk_id, round(r.raw, 6), round(r.score, 4)) for r in found.collect()] == [(0, 2.0, 0.6667), (1, 0.5, 0.3333)]
    assert sparse.sparse_search(rows, {}, 5).count() == 0
    tokens = spark.createDataFrame([(0, 7, 0.5), (0, 7, 0.9), (0, 8, -1.0)], "chunk_id int, token_id int, weight double")
    assert sparse.max_pool(tokens).first().weights == {7: 0.9}


def lists(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, score double")


def fused(v, k, limit, vw=1.0, kw=1.0):
    """Weighted reciprocal ranks of scores, by their largest possible sum."""
    total = {}
    for rows, weight in ((v, vw), (k, kw)):
        for i, (key, score) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
            total[key] = total.get(key, 0.0) + weight * score / (60 + i)
    most = (vw + kw) / 61
    best = sorted(((min(max(s / most, 0.0), 1.0) if most else 0.0, key) for key, s in total.items()), key=lambda x: (-x[0], x[1]))
    return [(key, s) for s, key in best[:limit]]


@pytest.mark.parametrize("seed", range(6))
def test_fusion_of_random_lists(spark, seed):
    rng = random.Random(seed)
    v, k = ([(f"c{i:02}", rng.randrange(1, 100) / 100) for i in rng.sample(range(30), rng.randrange(0, 20))] for _ in range(2))
    vw, kw = rng.choice([(1.0, 1.0), (2.0, 0.5), (0.0, 1.0), (0.3, 0.7)])
    limit = rng.randrange(1, 15)
    rows = fusion.rrf(lists(spark, v), lists(spark, k), limit, vw, kw).collect()
    expected = fused(v, k, limit, vw, kw)
    assert [r.chunk_id for r in rows] == [key for key, _ in expected]
    assert [r.score for r in rows] == pytest.approx([s for _, s in expected])
    assert all(0.0 <= r.score <= 1.0 for r in rows)


def test_weights_of_nothing_score_nothing(spark):
    assert [r.score for r in fusion.rrf(lists(spark, [("p", 0.7), ("q", 0.2)]), lists(spark, [("q", 0.9)]), 5, 0.0, 0.0).collect()] == [0.0, 0.0]


def test_image_hits(spark):
    text = lists(spark, [("a", 0.5), ("b", 0.2)])
    images = lists(spark, [("a", 0.9), ("x", 0.4), ("y", 0.2), ("z", 0.1)])
    assert [r.chunk_id for r in fusion.merge_images(text, images, 10).collect()] == ["a", "x", "b"]
    assert [r.chunk_id for r in fusion.merge_images(text, images, 10, "vector").collect()] == ["a", "x", "b", "y"]
    assert fusion.image_fetch(10, "vector") == 20 and fusion.image_fetch(10) == 32


def test_idf_floor():
    assert keyword._idf(10, 5) == keyword.LEAST_IDF and keyword._idf(10, 1) == math.log(9.5 / 1.5)
