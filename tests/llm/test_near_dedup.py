import random
from collections import Counter

import pytest

from inkwell.llm import near_dedup

ALPHABET = [f"w{i}" for i in range(400)]


def brute(rows, width, percent):
    """component by the smallest id, over all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                low[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(seed, n, edits):
    """Chains and stars of edited copies, and unrelated texts."""
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [rng.choice(ALPHABET) for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(len(copy))] = rng.choice(ALPHABET)
            rows.append(" ".join(copy))
            if g % 2:
                base = copy
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("width,percent", [(2, 80), (5, 80)])
def test_against_all_pairs(spark, width, percent):
    rows = family(width, 25, 6)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    want = brute(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_given_table(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_dedup.near_duplicates(docs, 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(200, rng.randrange(300, 900)) for _ in range(80)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)} | {200: 200} | {b: 200 for a, b in edges if a == 200}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(clashing, empty):
    got = near_dedup.near_duplicates(clashing, 5).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert all(by[i].component_id == i and by[i].kept for i in range(1, 9))
    assert by[None].component_id is None and by[None].kept
    assert Counter(r.doc_id for r in got)[4] == 2
    assert near_dedup.near_duplicates(empty).count() == 0
