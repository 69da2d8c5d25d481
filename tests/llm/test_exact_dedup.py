import hashlib
from collections import defaultdict

import pytest

from quarry.llm.common import ascii_lower
from quarry.llm.exact_dedup import exact_dedup, without_copies


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[ascii_lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        out += [(i, top, len(ids), i == top, hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("options", [{}, {"flush_rows": 2}, {"salts": 1}, {"salts": 50, "flush_bytes": 1}, {"digest": lambda c: str(len(c) % 3)}, {"digest": lambda c: "same", "flush_rows": 3}])
def test_odd_rows_and_weak_digests(odd_docs, options):
    found = exact_dedup(odd_docs, **options).collect()
    expected = brute(pairs(odd_docs))
    got = sorted([tuple(r) for r in found], key=str)
    if "digest" in options:  # contents decide, not digests
        got, expected = ([r[:4] for r in x] for x in (got, expected))
        got, expected = sorted(got, key=str), sorted(expected, key=str)
    assert got == expected


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).count() == 0 and exact_dedup(no_docs).columns[0] == "doc_id"


def test_whole_table(small_docs):
    assert sorted(map(tuple, exact_dedup(small_docs).collect()), key=str) == brute(pairs(small_docs))


def test_texts_move_once(small_docs):
    df = exact_dedup(small_docs)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_one_row_of_each_text_stays(odd_docs):
    kept = without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [ascii_lower(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({ascii_lower(t) for _, t in pairs(odd_docs)})


def test_a_hot_text(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot' ELSE concat('t', id) END AS text").repartition(7)
    rows = exact_dedup(docs, flush_rows=50).collect()
    assert len(rows) == 3000 and sum(r.kept for r in rows) == 2001
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id % 3 == 0} == {(2997, 1000)}
