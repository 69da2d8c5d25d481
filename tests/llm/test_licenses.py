import re

import pytest

from quarry.llm.licenses import BASE_PHRASES, Scanner, evaluate, scan_licenses

TABLE = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall((text or "").translate(TABLE))
    places = [(i, label) for phrase, label in BASE_PHRASES.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def rows_of(df):
    return [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(df).collect()]


def test_base_places(spark, odd_docs, no_docs, small_docs):
    texts = ["under the MIT license", "under the mit license under the mit license", "CC-BY-NC cc by nc by nc", "Apache License, Version 2.0", "mit under the", "xunder the mit license", "the under the mit licensee", "Unter THE é under the mit license"]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (own, odd_docs, small_docs):
        expected = [(r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect()]
        assert sorted(rows_of(df), key=str) == sorted(expected, key=str)
    assert scan_licenses(no_docs).count() == 0


@pytest.mark.parametrize(
    ("expression", "labels", "free"),
    [
        ("mit", ["mit"], 1.0), ("gpl-3.0-only", ["gpl-3"], 0.3), ("mit or gpl-2.0", ["mit", "gpl-2"], 1.0), ("mit and gpl-2.0", ["mit", "gpl-2"], 0.3),
        ("mit or gpl-2.0 and agpl-3.0", ["mit", "gpl-2", "agpl-3"], 1.0), ("(mit or gpl-2.0) and agpl-3.0", ["mit", "gpl-2", "agpl-3"], 0.2),
        ("gpl-2.0+ with classpath-exception-2.0", ["gpl-2"], 0.5), ("gpl-2.0 with x-exception and mit", ["gpl-2", "mit"], 0.5), ("nonesuch-1.0", ["other:nonesuch-1.0"], 0.5), ("mit */ more text", ["mit"], 1.0),
        ("mit or", ["mit"], 1.0), ("(mit", ["mit"], 1.0), ("mit mit", ["mit"], 1.0), ("mit.", ["mit"], 1.0), ("apache-2.0: see the file", ["apache-2"], 1.0),
    ],
)
def test_expressions(expression, labels, free):
    found, score = evaluate(expression)
    assert found == labels and score == pytest.approx(free)


@pytest.mark.parametrize("expression", ["", "or mit", ")", "and", "()"])
def test_no_expressions(expression):
    assert evaluate(expression) is None


def test_tags_and_score(spark):
    rows = [(0, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only\ncode"), (1, "Permission is hereby granted, free of charge, to any person"), (2, "nothing"), (3, "spdx-license-identifier:"), (4, "All rights reserved. under the MIT license")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == "apache-2,gpl-3,mit" and got[0].score == 0.3 and got[0].expressions == ["(mit or apache-2.0) and gpl-3.0-only"]
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].n_base == 0
    assert (got[2].labels, got[2].score) == ("", 0.0) == (got[3].labels, got[3].score)
    assert got[4].labels == "mit,proprietary" and got[4].score == 0.05


def test_many_phrases_in_one_text():
    """A text is read once, however many phrases it has."""
    import time

    n = 50_000
    before = time.time()
    found = Scanner().scan("x under the MIT license, cc by nc by nc " * n)
    assert time.time() - before < 5
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"]) == (10 * n, 2 * n, 1, 10 * n - 5)
