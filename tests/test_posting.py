"""Posting (W1-W6) against plain one-at-a-time replays."""

import datetime as dt
import random
from bisect import bisect_right
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.operators import posting as P
from inkwell.operators import sequential as W
from inkwell.schemas import SCHEMAS

H_SCHEMA = "RequestID long, StoreCode int, CustomerCode int, EmployeeNationalCode string, InvoiceDate date"
L_SCHEMA = "RequestID long, ISBN string, Quantity int, LinePos int"


def _tables(spark, stock, existing_max=0):
    inv = [(s, b, q, 0, None) for (s, b), q in stock.items()]
    books = sorted({b for (_, b) in stock} | {"zz"})
    sale = [(existing_max, dt.date(2009, 1, 1), 1, 10, "E")] if existing_max else []
    return {
        "Inventory": spark.createDataFrame(inv, SCHEMAS["Inventory"]),
        "Book": spark.createDataFrame([(b, b, "s", Decimal("2.50"), 1, None) for b in books], SCHEMAS["Book"]),
        "Sale": spark.createDataFrame(sale, SCHEMAS["Sale"]),
    }


def _replay(stock, requests):
    """requests: list of (rid, store, [(isbn, qty), ...]) in arrival order."""
    stock = dict(stock)
    accepted = []
    for rid, store, lines in sorted(requests):
        need = {}
        for b, q in lines:
            need[b] = need.get(b, 0) + q
        if lines and all(q > 0 for _, q in lines) and all(stock.get((store, b), -1) >= q for b, q in need.items()):
            for b, q in need.items():
                stock[(store, b)] -= q
            accepted.append(rid)
    return accepted, stock


def _post(spark, stock, requests, chunk=P.DEFAULT_CHUNK, existing_max=0):
    t = _tables(spark, stock, existing_max)
    heads = [(rid, store, 1, "E", dt.date(2010, 1, 1)) for rid, store, _ in requests]
    lines = [(rid, b, q, i) for rid, _, ls in requests for i, (b, q) in enumerate(ls)]
    res = P.post_sales(t, spark.createDataFrame(heads, H_SCHEMA), spark.createDataFrame(lines, L_SCHEMA),
                       chunk=chunk)
    return t, res


def test_fixture_frame(spark):
    # store 10: a=5, b=5; store 20: a=1
    stock = {(10, "a"): 5, (10, "b"): 5, (20, "a"): 1}
    reqs = [(1, 10, [("a", 3)]), (2, 10, [("b", 1), ("a", 3)]), (3, 10, [("a", 1)]), (4, 20, [("a", 9)])]
    _, res = _post(spark, stock, reqs, existing_max=41)
    acc = {r.RequestID: r.InvoiceNumber for r in res.accepted.collect()}
    assert acc == {1: 42, 3: 43}
    rej = {r.RequestID: r.Reason for r in res.rejected.collect()}
    assert rej == {2: P.INSUFFICIENT_STOCK, 4: P.INSUFFICIENT_STOCK}
    inv = {(r.StoreCode, r.ISBN): r.AvailableQuantity for r in res.inventory.collect()}
    assert inv == {(10, "a"): 1, (10, "b"): 5, (20, "a"): 1}
    items = sorted((r.InvoiceNumber, r.LineNumber, r.ISBN, r.Quantity) for r in res.items.collect())
    assert items == [(42, 1, "a", 3), (43, 1, "a", 1)]


@pytest.mark.parametrize("chunk", [P.DEFAULT_CHUNK, 3, 0])
def test_hot_store_matches_sequential(spark, chunk):
    """Replay alone, bounds then replay, and bounds down to the last invoice."""
    stock = {(1, b): 3 for b in "abcdef"}
    reqs = [(i, 1, [("abcdef"[i % 6], 1 + i % 2), ("abcdef"[(i * 5) % 6], 1)]) for i in range(1, 30)]
    want, want_stock = _replay(stock, reqs)
    _, res = _post(spark, stock, reqs, chunk=chunk)
    assert sorted(r.RequestID for r in res.accepted.collect()) == want
    assert {(r.StoreCode, r.ISBN): r.AvailableQuantity for r in res.inventory.collect()} == want_stock


def _one_store(n, books, rng):
    """n invoices of one store that hang together through their books."""
    return [(i, 1, [(b, rng.randint(1, 9)) for b in rng.sample(books, rng.randint(1, 4))]) for i in range(1, n + 1)]


@pytest.mark.parametrize("n", [300, 3000])
def test_rounds_stay_few_in_a_large_group(spark, monkeypatch, n):
    """One store holds all requests, and their books connect them all: a few
    rounds of bounds leave three of the replay at most, also when the group is
    ten times as large (a replay alone would take 10 or 100)."""
    rng, books = random.Random(5), [f"b{i:02d}" for i in range(6)]
    stock, reqs = {(1, b): n // 6 * 5 for b in books}, _one_store(n, books, rng)
    rounds = []
    bounds = P._with_bounds
    monkeypatch.setattr(P, "BLOCK_LINES", 64)
    monkeypatch.setattr(P, "_with_bounds", lambda w: rounds.append(1) or bounds(w))
    t = _tables(spark, stock)
    lines = spark.createDataFrame([(1, rid, b, q) for rid, _, ls in reqs for b, q in ls],
                                  "StoreCode int, RequestID long, ISBN string, Quantity long")
    avail = t["Inventory"].select("StoreCode", "ISBN", F.col("AvailableQuantity").alias("Available"))
    decided, rest, largest = P.decide_by_bounds(lines, avail, 30)
    want = set(_replay(stock, reqs)[0])
    got = {r.RequestID: r.Accepted for r in decided.collect()}
    assert all(ok == (rid in want) for rid, ok in got.items())
    assert largest <= 3 * 30 and len(got) + rest.select("RequestID").distinct().count() == n
    assert len(rounds) <= 16
    whole = got | {r.RequestID: r.Accepted for r in P._cogroup_replay(rest, avail).collect()}
    assert {k for k, ok in whole.items() if ok} == want and len(whole) == n


def test_merge_and_missing_stock_row(spark):
    stock = {(1, "a"): 4}
    reqs = [(1, 1, [("a", 2), ("a", 2)]), (2, 1, [("a", 1)]), (3, 1, [("q", 1)]), (4, 1, []),
            (5, 1, [("a", 3), ("a", -1)])]
    _, res = _post(spark, stock, reqs)
    assert sorted(r.RequestID for r in res.accepted.collect()) == [1]
    rej = {r.RequestID: r.Reason for r in res.rejected.collect()}
    assert rej == {2: P.INSUFFICIENT_STOCK, 3: P.NO_STOCK_ROW, 4: P.NO_LINES, 5: P.INVALID_QUANTITY}
    items = [(r.LineNumber, r.Quantity) for r in res.items.collect()]
    assert items == [(1, 4)]


def test_no_line_is_dropped(spark):
    """A stock row without a book, a line without a header, missing request
    numbers and sums beyond an int: refused, and the stock stays."""
    t = _tables(spark, {(1, "a"): 5, (1, "b"): 5})
    t["Book"] = t["Book"].filter("ISBN <> 'b'")
    day, big = dt.date(2010, 1, 1), 2_000_000_000
    heads = [(1, 1, 1, "E", day), (2, 1, 1, "E", day), (3, 1, 1, "E", day), (None, 1, 1, "E", day)]
    lines = [(1, "a", 2, 0), (2, "a", 1, 0), (2, "b", 2, 1), (3, "a", big, 0), (3, "a", big, 1),
             (9, "a", 1, 0), (None, "a", 1, 0)]
    res = P.post_sales(t, spark.createDataFrame(heads, H_SCHEMA), spark.createDataFrame(lines, L_SCHEMA))
    assert [r.RequestID for r in res.accepted.collect()] == [1]
    assert {r.RequestID: r.Reason for r in res.rejected.collect()} == {
        2: P.NOT_SELLABLE, 3: P.INSUFFICIENT_STOCK, 9: P.MISSING_HEADER, None: P.MISSING_HEADER}
    assert [(r.ISBN, r.Quantity) for r in res.items.collect()] == [("a", 2)]
    assert {r.ISBN: r.AvailableQuantity for r in res.inventory.collect()} == {"a": 3, "b": 5}


requests_strategy = st.lists(
    st.tuples(st.integers(1, 3),
              st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(1, 6)), min_size=1, max_size=3)),
    min_size=1, max_size=12)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(requests_strategy, st.sampled_from([P.DEFAULT_CHUNK, 2, 0]))
def test_random_batches_match_sequential(spark, reqs, chunk):
    stock = {(s, b): 4 + (s * 3 + ord(b)) % 5 for s in (1, 2, 3) for b in ("a", "b", "c")}
    requests = [(i + 1, s, ls) for i, (s, ls) in enumerate(reqs)]
    _, res = _post(spark, stock, requests, chunk=chunk)
    want, want_stock = _replay(stock, requests)
    acc = sorted((r.RequestID, r.InvoiceNumber) for r in res.accepted.collect())
    assert [a for a, _ in acc] == want
    assert [n for _, n in acc] == list(range(1, len(want) + 1))     # no gaps
    inv = {(r.StoreCode, r.ISBN): r.AvailableQuantity for r in res.inventory.collect()}
    assert inv == want_stock
    assert min(inv.values()) >= 0
    rejected = {r.RequestID for r in res.rejected.collect()}
    assert rejected == {rid for rid, _, _ in requests} - set(want)


def _adj_tables(spark, stock):
    return {"Inventory": spark.createDataFrame([(s, b, q, 0, None) for (s, b), q in stock.items()],
                                               SCHEMAS["Inventory"])}


def test_adjust_stock_fixture(spark):
    t = _adj_tables(spark, {(1, "a"): 1})
    adj = spark.createDataFrame([(1, 1, "a", 2, 1), (2, 1, "a", 3, -1), (3, 1, "a", 1, -1), (4, 1, "z", 1, 1),
                                 (5, 1, "a", 0, 1)],
                                "AdjustID long, StoreCode int, ISBN string, Amount int, Direction int")
    out = P.adjust_stock(t, adj)
    dec = {r.AdjustID: (r.Accepted, r.Reason) for r in out["decisions"].collect()}
    assert dec == {1: (True, None), 2: (True, None), 3: (False, P.INSUFFICIENT_STOCK),
                   4: (False, P.NO_STOCK_ROW), 5: (False, P.INVALID_AMOUNT)}
    assert [r.AvailableQuantity for r in out["inventory"].collect()] == [0]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(1, 5), st.sampled_from([1, -1])),
                min_size=1, max_size=15), st.integers(0, 1))
def test_adjust_random_matches_sequential(spark, events, chunked):
    stock = {(1, "a"): 3, (1, "b"): 0}
    t = _adj_tables(spark, stock)
    rows = [(i + 1, 1, b, amt, d) for i, (b, amt, d) in enumerate(events)]
    adj = spark.createDataFrame(rows, "AdjustID long, StoreCode int, ISBN string, Amount int, Direction int")
    out = P.adjust_stock(t, adj, chunk=2 if chunked else W.DEFAULT_CHUNK)
    s = dict(stock)
    want = {}
    for aid, _, b, amt, d in rows:
        ok = s[(1, b)] + amt * d >= 0
        if ok:
            s[(1, b)] += amt * d
        want[aid] = ok
    got = {r.AdjustID: r.Accepted for r in out["decisions"].collect()}
    assert got == want
    assert {(r.StoreCode, r.ISBN): r.AvailableQuantity for r in out["inventory"].collect()} == s


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-9, 7), max_size=25), st.integers(0, 80))
def test_walk_map_is_the_walk(deltas, state):
    starts, states = W.walk_map(deltas)
    i = bisect_right(starts, state) - 1
    after = state
    for d in deltas:
        after += d if after + d >= 0 else 0
    assert states[i] + state - starts[i] == after
    assert starts[0] == 0 and starts == sorted(set(starts))


def _walk(state, deltas):
    out = []
    for d in deltas:
        out.append(state + d >= 0)
        state += d if out[-1] else 0
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=60), st.integers(0, 12), st.integers(1, 7))
def test_one_key_over_many_chunks(spark, deltas, state, chunk):
    """One key in chunks that do not wait for each other, nulls in its columns,
    beside a key short enough for one task."""
    rows = [(None, "k", i, d, state, i) for i, d in enumerate(deltas)] + [(1, "k", 0, -state - 1, state, -1)]
    ev = spark.createDataFrame(rows, "a int, b string, o int, d int, s int, e long")
    got = {r.e: r.Accepted for r in W.bounded_walk(ev, ["a", "b"], "o", "d", "s", "e", chunk=chunk).collect()}
    assert [got.pop(i) for i in range(len(deltas))] == _walk(state, deltas)
    assert got == {-1: False}


def test_hot_key_is_cut_over_tasks(spark, monkeypatch):
    """All adjustments on one stock row: the walk and the maps see no more than
    a chunk at a time, and the maps stay short."""
    rng = random.Random(3)
    deltas = [rng.choice([-1, -1, 1]) * rng.randint(1, 50) for _ in range(4000)]
    ev = spark.createDataFrame([("k", i, d, 20, i) for i, d in enumerate(deltas)], "k string, o int, d int, s int, e long")
    calls = []
    by_bucket = W._by_bucket
    monkeypatch.setattr(W, "_by_bucket", lambda df, *a: calls.append(df) or by_bucket(df, *a))
    got = sorted((r.e, r.Accepted) for r in W.bounded_walk(ev, ["k"], "o", "d", "s", "e", chunk=100).collect())
    assert [ok for _, ok in got] == _walk(20, deltas)
    to_map, to_walk = calls
    assert to_walk.groupBy("_key", "_chunk").count().agg(F.max("count"), F.count("*")).first() == (100, 40)
    reach = to_map.select("_chunk", "_reach").distinct().orderBy("_chunk").collect()
    state = 20
    for r in reach:
        assert state <= r._reach <= 50 * 40     # an upper bound, and not the sum of all increases
        for d in deltas[r._chunk * 100:(r._chunk + 1) * 100]:
            state += d if state + d >= 0 else 0


def test_build_invoice_lines(spark):
    t = _tables(spark, {(1, "a"): 5, (1, "b"): 0})
    adds = spark.createDataFrame(
        [(1, 1, 1, "a", 3), (1, 2, 1, "a", 4), (1, 3, 1, "a", 2), (1, 4, 1, "b", 1), (1, 5, 1, "q", 1),
         (2, 1, 1, "a", 6)],
        "RequestID long, Seq long, StoreCode int, ISBN string, Quantity int")
    out = P.build_invoice_lines(t, adds)
    lines = [(r.RequestID, r.ISBN, r.Quantity, r.LinePos) for r in out["lines"].collect()]
    assert lines == [(1, "a", 5, 1)]
    refused = sorted((r.RequestID, r.Seq, r.Reason) for r in out["refused"].collect())
    assert refused == [(1, 2, P.INSUFFICIENT_STOCK), (1, 4, P.NOT_SELLABLE), (1, 5, P.NOT_SELLABLE),
                       (2, 1, P.INSUFFICIENT_STOCK)]


def test_fixture_posting_replay(spark, fixture_mid):
    """Every order and line of sf0.01 as sale requests, against the plain replay."""
    tables, heads, lines = fixture_mid.posting_tables(), fixture_mid.post_headers(), fixture_mid.post_lines()
    res = P.post_sales(tables, heads, lines)
    wanted = {}
    for r in lines.collect():
        wanted.setdefault(r.RequestID, []).append((r.ISBN, r.Quantity))
    requests = [(r.RequestID, r.StoreCode, wanted[r.RequestID]) for r in heads.collect()]
    stock = {(r.StoreCode, r.ISBN): r.AvailableQuantity for r in tables["Inventory"].collect()}
    accepted, _ = _replay(stock, requests)
    assert sorted(r.RequestID for r in res.accepted.collect()) == accepted
    assert res.accepted.count() + res.rejected.count() == len(requests)
