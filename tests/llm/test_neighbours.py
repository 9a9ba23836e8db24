import numpy as np
import pytest

from inkwell.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    v = np.array([e for _, e in rows], np.float32).astype(float)
    out = {}
    for i, e in queries:
        s = v @ np.array(e, np.float32).astype(float)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    near = {}
    for r in got:
        near.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(near.get(q, set()) & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("sf, shard_rows", [("sf0.01", hnsw.SHARD_ROWS), ("sf0.1", hnsw.SHARD_ROWS), ("sf0.1", 256)])
def test_recall_on_the_given_table(spark, sf, shard_rows):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in v.select("vec_id", "embedding").collect()]
    queries = [x for x in rows if x[0] % 20 == 0]
    got = hnsw.nearest(v, v.filter("vec_id % 20 = 0"), 20, shard_rows=shard_rows).collect()
    want = brute(rows, queries, 20)
    assert recall(got, want) >= 0.9
    exact = {q: dict(w) for q, w in want.items()}
    for r in got:
        assert r.query_id != r.vec_id
        if r.vec_id in exact[r.query_id]:
            assert abs(r.score - exact[r.query_id][r.vec_id]) < 1e-12
    for q in list(want)[:50]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_lengths_differ_and_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 16)) * rng.uniform(0.2, 3, size=(1200, 1))
    v[300:700] = v[300]  # a third are one vector
    rows = [(i, [float(c) for c in np.float32(e)]) for i, e in enumerate(v)]
    d = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    got = hnsw.nearest(d, d.filter("vec_id % 20 = 0"), 20, shard_rows=300).collect()
    want = brute(rows, [x for x in rows if x[0] % 20 == 0], 20)
    assert recall(got, want) >= 0.95
    mine = sorted((r for r in got if r.query_id == 400), key=lambda r: r["rank"])
    assert len(mine) == 20


def test_ties_at_the_cut_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    ids = rng.permutation(90).tolist()
    rows = [(i, [1.0, float(np.cos(x)), float(np.sin(x))]) for i, x in zip(ids, np.linspace(0, 6, 90))] + [(1000, [1.0, 0.0, 0.0])]
    d = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    got = sorted(hnsw.nearest(d, d.filter("vec_id = 1000"), 20).collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in got] == list(range(20))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [1.0, None], 0), (7, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (8, [], 0), (9, [1.0, 2.0, 3.0], 0), (10, [2.0, 0.0], None)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in hnsw.nearest(d, d, 20).collect()}
    assert got == {(1, 1): (10, 2.0), (1, 2): (2, 0.0), (2, 1): (1, 0.0), (2, 2): (10, 0.0), (10, 1): (1, 2.0), (10, 2): (2, 0.0)}
    empty = spark.createDataFrame([], SCHEMA)
    assert hnsw.nearest(empty, empty).count() == 0 and hnsw.nearest(d, empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 50])
def test_small_graphs_hold_all(n):
    x = hnsw._extended(np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32))
    level, tables = hnsw.build(x)
    found = hnsw.search(x, level, tables, x, n)
    assert all(sorted(f[f >= 0].tolist()) == list(range(n)) for f in found)


def test_doubles_beyond_single_precision_and_repeated_ids(spark):
    kind = "vec_id long, embedding array<double>, h long, dim int, shard int, ids int, salt int, score int"
    # distinct only beyond single precision: the nearest is the last
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(40)] + [(50, [1e200, -1e200])]
    clash = lambda r: [(i, e, 1, 1, 1, 1, 1, 1) for i, e in r]
    d = spark.createDataFrame(clash(rows), kind)
    got = sorted((r["rank"], r.vec_id, r.score) for r in hnsw.nearest(d, d.filter("vec_id = 0"), 3).collect())
    want = sorted(((-(e[0] + e[1]), i) for i, e in rows[1:40]))[:3]
    assert [(v, s) for _, v, s in got] == [(i, -s) for s, i in want]
    # an id with two vectors: once as a candidate, the nearest of both as a query
    rows = [(1, [1.0, 0.0]), (1, [0.0, 5.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0])]
    d = spark.createDataFrame(clash(rows), kind)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.nearest(d, d.filter("vec_id in (1, 2)"), 3).collect()]
    assert sorted(got) == [(1, 1, 3, 5.0), (1, 2, 2, 3.0), (2, 1, 3, 6.0), (2, 2, 1, 3.0)]
