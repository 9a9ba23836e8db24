import re
import zlib

import pytest
from pyspark.sql import functions as F

from inkwell.llm import hash_tree, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(1, 2, 3), most=3):
    """Water-filling in plain steps; sizes: (source, size) in order."""
    total, cap = sum(n for _, n in sizes), {s: most * n for s, n in sizes}
    w = {s: weights[i % 3] for i, (s, _) in enumerate(sizes)}
    done = {}
    while True:
        open_ = [s for s in w if s not in done]
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            return done | share
        done |= {s: cap[s] for s in over}


@pytest.mark.parametrize("rows", [
    [(i, f"s{i % 7}", 5 + i % 11) for i in range(300)],
    [(i, None if i % 3 else "z", 1 + i) for i in range(50)],
    [(i, "abcdefgh"[min(7, i % 40)], 10) for i in range(400)],
])
def test_targets_are_met(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or "")))
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size + r.rest_words
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)


def test_position_inverts_the_integral(spark):
    d = spark.createDataFrame([(i, "a", 1) for i in range(1000)], "doc_id long, source string, size long")
    got = [r.position for r in mixing.mix(d, weights=[1], schedules=[mixing.RISING]).collect()]
    assert got == sorted(got)
    for n, t in enumerate(got):  # the integral of 0.5 + t up to t is the share taken before
        assert abs((0.5 * t + t * t / 2) - n / 1000) < 1e-9


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    plan = {r.doc_id: r for r in mixing.mix(docs.select("doc_id", "source", mixing.n_words().alias("size"))).collect()}
    words, text = {}, {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert words == {i: r.taken for i, r in plan.items() if r.taken}


def test_native_plan(docs):
    d = docs.select("doc_id", "source", mixing.n_words().alias("size"))
    plan = mixing.mix(d)._jdf.queryExecution().toString() + hash_tree.shard_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_odd_mix(clashing, empty):
    size = clashing.withColumn("size", mixing.n_words()).select("doc_id", "source", "size")
    got = mixing.mix(size).collect()
    assert len(got) == 10 and all(r.taken == 0 and r.position is None for r in got if r.size == 0)
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns and out.filter("text is null").count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.mix(empty.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0


def test_shards(docs):
    rows = hash_tree.shard_documents(docs).collect()
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    slots = {}
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "key")
        assert r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(text) and set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_movement_is_confined(spark):
    d = spark.range(20000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    share = {r[0]: r[1] for r in hash_tree.shard_documents(d).groupBy("shard").count().collect()}
    assert all(abs(share[s] - 2500) < 250 for s in range(8))
    # one shard of region1 gets heavier: rows move into its path only
    heavy = {**hash_tree.EIGHT, "region1": {**hash_tree.EIGHT["region1"], "rack3": {6: 1.0, 7: 2.0}}}
    moved = d.select(hash_tree.shard_of(F.col("doc_id"), hash_tree.EIGHT).alias("a"), hash_tree.shard_of(F.col("doc_id"), heavy).alias("b")).filter("a <> b").distinct().collect()
    assert moved and all(not (r.b in (0, 1, 2, 3)) for r in moved)  # region0 takes nothing
    assert all(r.b in (6, 7) for r in moved if r.a in (4, 5))  # in region1 only the heavier rack takes
    assert all(r.b == 7 for r in moved if r.a == 6)


def test_odd_shards(clashing, empty):
    got = hash_tree.shard_documents(clashing).collect()
    assert len(got) == 10 and {(r.size, r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(1, 0)}
    assert len({r.slot for r in got if r.doc_id == 4}) == 2
    assert hash_tree.shard_documents(empty).count() == 0
