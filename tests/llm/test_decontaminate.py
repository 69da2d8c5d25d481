import hashlib
import re

import pytest

from quarry.llm.decontaminate import decontaminate, without_contaminated

TABLE = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(TABLE))


def brute(docs, items, window=13):
    windows = [(item, tuple(w[i : i + min(window, len(w))])) for item, text in items for w in [words_of(text)] if w for i in range(len(w) - min(window, len(w)) + 1)]
    by_window = {}
    for item, w in windows:
        by_window.setdefault(w, set()).add(item)
    sizes = {len(w) for w in by_window}
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if items_ := by_window.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= items_
        named = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def run(docs, bench, **options):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(docs, bench, **options).collect()], key=str)


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (2, "short item here"), (3, "Solo"), (4, None), (5, ""), (6, "one two three four five six seven eight nine ten eleven twelve thirteen"), (None, "nameless item of some words"), (2, "another text of item two"), (7, "a a a a a a a a a a a a a a a")]
DOCS = [
    (1, "x ONE two, three four five six seven eight nine ten eleven twelve thirteen y"), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, "short item here short ITEM here"), (4, "solo solo"), (5, "nothing"), (6, None), (7, ""),
    (8, "a " * 40), (9, "nameless item of some words and another text of item two"), (9, "nothing"), (None, "solo"), (10, "word " * 3000 + "solo"), (11, "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen one two"),
]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 30}, {"block_bytes": 120}, {"shingle": 1}, {"shingle": 13}])
def test_planted_passages(spark, options):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert run(docs, bench, **options) == brute(DOCS, ITEMS)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(ITEMS + [(50, "hello"), (51, "word word word")], "item_id long, text string")
    rows = pairs(odd_docs, "doc_id", "text")
    assert run(odd_docs, bench) == brute(rows, pairs(bench, "item_id", "text"))
    assert run(no_docs, bench) == []
    assert run(odd_docs, bench.limit(0)) == brute(rows, [])
    kept = without_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == sum(not r[-1] for r in brute(rows, pairs(bench, "item_id", "text")))


def test_whole_table(spark, small_docs):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    expected = brute(pairs(small_docs, "doc_id", "text"), pairs(bench, "item_id", "text"))
    assert sum(r[-1] for r in expected) > 0
    assert run(small_docs, bench) == expected
    assert run(small_docs, bench, block_bytes=4000) == expected


def test_nothing_is_shuffled_but_counts(spark, small_docs):
    plan = decontaminate(small_docs, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
