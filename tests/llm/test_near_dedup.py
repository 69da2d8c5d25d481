import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import near_dedup as nd
from quarry.llm.near_dedup import Rule, link_groups, near_dedup, without_near_copies

TABLE = {i: i + 32 for i in range(65, 91)}
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CONTRACT = Rule(shingle=3, percent=85, words="space")


def shingles(text, rule):
    words = (SPACED if rule.words == "space" else ALNUM).findall((text or "").translate(TABLE))
    return {tuple(words[i : i + rule.shingle]) for i in range(max(1, len(words) - rule.shingle + 1))} if words else set()


def brute(rows, rule):
    """{id: (shingles, component)} by an inverted index over all pairs."""
    sets = {i: shingles(t, rule) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in index[s])
        for j, n in both.items():
            if 100 * n >= rule.percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df, rule):
    expected = brute([tuple(r) for r in df.select("doc_id", "text").collect()], rule)
    rows = near_dedup(df, rule).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    return rows


@pytest.mark.parametrize("rule", [CONTRACT, Rule()])
def test_whole_table(small_docs, rule):
    rows = check(small_docs, rule)
    assert any(not r.kept for r in rows)


@pytest.mark.parametrize("rule", [CONTRACT, Rule()])
def test_odd_rows(odd_docs, no_docs, rule):
    rows = check(odd_docs, rule)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
    assert near_dedup(no_docs, rule).count() == 0
    kept = without_near_copies(odd_docs, rule)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in rows)


def near_copies(n, seed=1):
    """A large group of near copies of one text, others beside it, and copies of copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(n, n + n // 2):
        rows.append((i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))))
    return rows


@pytest.mark.parametrize(("docs", "last"), [(1500, 6), (40, 6), (10, 2)])
def test_large_nodes_branch_and_are_cut_into_blocks(spark, monkeypatch, docs, last):
    monkeypatch.setattr(nd, "NODE_DOCS", docs)
    monkeypatch.setattr(nd, "LAST", last)
    rows = near_copies(240)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), Rule(shingle=3, percent=80, words="space"))


def test_chains_reach_their_smallest_id(spark):
    """Each text is near its neighbour only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 - k, " ".join(words[5 * k : 5 * k + 100])) for k in range(50)]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"), Rule(shingle=3, percent=80, words="space"))
    assert {r.component_id for r in found} == {951}


@pytest.mark.parametrize("order", ["down", "up", "mixed"])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, order):
    """A thousand groups of two in a row: whole components hook, and hooks are followed by jumps."""
    n = 1000
    ids = {"down": range(n, -1, -1), "up": range(n + 1), "mixed": random.Random(4).sample(range(n + 1), n + 1)}[order]
    rows = [(k, b"h", b"%d" % k, ids[k]) for k in range(n)] + [(k, b"h", b"%d" % (k + 1), ids[k + 1]) for k in range(n)]
    written, write = [], nd.materialise
    monkeypatch.setattr(nd, "materialise", lambda df, label: written.append(label) or write(df, label))
    found = nd.components(spark.createDataFrame(rows, "node long, head binary, digest binary, id int")).collect()
    assert len(found) == n + 1 and {r.component for r in found} == {0}
    assert written.count("labels") - 1 <= 12


def test_a_template_is_compared_once_and_its_pairs_not_at_all(spark, monkeypatch):
    """Memberships of a node that stays large grow with its documents; only what the template doesn't link is compared further."""
    made = []
    blocks, pairs = nd.blocks_with_pivots, nd.unlinked_pairs

    def counted(f, name):
        def run(*args):
            out = f(*args)
            made.append((name, out.count()))
            return out

        return run

    monkeypatch.setattr(nd, "NODE_DOCS", 40)
    monkeypatch.setattr(nd, "blocks_with_pivots", counted(blocks, "blocks"))
    monkeypatch.setattr(nd, "unlinked_pairs", counted(pairs, "pairs"))
    rows = near_copies(2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rule = Rule(shingle=3, percent=80, words="space")
    check(docs, rule)
    sizes = dict(made)
    assert sizes["blocks"] <= 2000 * (1 + nd.PIVOTS / 20) + 200 and sizes["pairs"] <= rule.deep_trees * 2000


def test_an_id_that_holds_a_third_of_the_rows(spark):
    """Its texts all differ; their groups are small, and all get the least id."""
    rows = [(7, f"text number {i} of the same id with words w{i} x{i}") for i in range(1500)] + [(100 + i, f"other {i} a{i} b{i} c{i}") for i in range(3000)] + [(3, rows_text) for rows_text in ["text number 5 of the same id with words w5 x5"]]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id in (3, 7)} == {3}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id >= 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=8), min_size=2, max_size=12), st.integers(30, 100))
def test_groups_are_those_of_all_pairs(sets, percent):
    found = link_groups([np.array(sorted(s), np.uint64) for s in sets], percent)
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    expected = defaultdict(list)
    for i, x in enumerate(label):
        expected[x].append(i)
    assert sorted(found) == sorted(g for g in expected.values() if len(g) > 1)


def test_trees_for_a_recall():
    assert CONTRACT.trees == 6 and Rule().trees == 8 and Rule(percent=100).trees == 1


def threshold_pairs(n, seed=3):
    """n pairs at exactly 80 % in one template: texts of different pairs share 78 of 102 words."""
    rng = random.Random(seed)
    base = [f"base{i}" for i in range(78)]
    rows = []
    for k in range(n):
        both = [f"p{k}x{i}" for i in range(2)]
        for j in (0, 1):
            words = base + both + [f"o{k}x{j}x{i}" for i in range(10)]
            rng.shuffle(words)
            rows.append((2 * k + j, " ".join(words)))
    return rows


def test_recall_holds_where_nodes_branch(spark, monkeypatch):
    """Isolated pairs at the threshold inside a template whose nodes are large at every level."""
    monkeypatch.setattr(nd, "NODE_DOCS", 20)
    rule = Rule(shingle=1, percent=80, words="space")
    rows = near_dedup(spark.createDataFrame(threshold_pairs(300), "doc_id long, text string").repartition(5), rule).collect()
    assert len(rows) == 600 and [r.doc_id for r in rows if r.component_id != r.doc_id // 2 * 2] == []


def test_trees_down_to_the_last_level():
    for rule in (CONTRACT, Rule()):
        s = rule.percent / 100
        assert all(1 - (1 - s**level) ** rule.deep_trees >= rule.recall for level in range(nd.FIRST, nd.LAST + 1))
    assert Rule(percent=100).deep_trees == 1


@pytest.mark.parametrize("turned", [False, True])
def test_an_id_of_several_texts_joins_their_components(spark, turned):
    """Whichever of the rows comes first, and where another id stands for one of the texts."""
    rows = []
    for k in range(0, 60, 20):
        a, b = ([f"{x}{k}w{i}" for i in range(100)] for x in "ab")
        rows += [(k + 5, " ".join(a)), (k + 5, " ".join(b)), (k + 9, " ".join(a[:-1] + ["x"])), (k + 12, " ".join(b[:-1] + ["x"]))]
    rows += [(41, rows[8][1])]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    got = near_dedup(docs).collect()
    assert len(got) == 13 and all(r.component_id == {0: 5, 20: 25, 40: 41}[r.doc_id // 20 * 20] for r in got)
