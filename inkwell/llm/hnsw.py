"""Approximate nearest neighbours: one navigable small-world graph per shard.

1. Equal vectors are merged into one, which keeps its smallest ids (as many as
   a result can hold, and one), so copies neither crowd a graph nor a result.
2. Distinct vectors are dealt by hash to shards of about ``shard_rows``. Each
   shard builds a hierarchical navigable small-world graph and is stored as one
   row of flat arrays: vectors, levels, and per level a fixed-width table of
   neighbour numbers (-1: none). Vectors are extended by one coordinate that
   makes them equally long, so the largest inner product is the nearest point.
3. Queries go in blocks to every shard; a task searches one block in one
   shard, all its queries in step. The shards' best are merged by score.

Building inserts points in batches: a batch searches the graph built so far and
itself, links by the diversity rule of the method, and adds reverse links,
pruned by the same rule. A shard's size bounds every task, whatever the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import batch, map_rows, stored

SHARD_ROWS, QUERY_BLOCK = 8192, 1024
LINKS, BEAM_BUILD, BEAM_SEARCH = 16, 96, 192
FANOUT = 16  # each level holds about one point in FANOUT of the level below
SEED = 20260109


def _levels(n: int) -> np.ndarray:
    u = np.random.default_rng(SEED).random(n)
    return np.floor(-np.log1p(-u) / np.log(FANOUT)).astype(np.int32)


def beam(x: np.ndarray, table: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest points found per query, in step for all queries.

    ``entry``: queries x starting points. Each step expands the nearest point
    of every query's beam that is not expanded yet, until none is left.
    Returns numbers (-1: none) and squared distances, nearest first.
    """
    m = len(q)
    ids = np.full((m, width), -1, np.int64)
    dist = np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    seen = np.zeros((m, len(x)), bool)
    rows = np.arange(m)

    def offer(live, new):
        """Merge new points (live queries x k; -1 none) into their beams."""
        fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
        new = np.where(fresh, new, -1)
        r, c = np.nonzero(fresh)
        seen[live[r], new[r, c]] = True
        d = np.full(new.shape, np.inf, np.float32)
        v = x[new[r, c]] - q[live[r]]
        d[r, c] = np.einsum("ij,ij->i", v, v)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_i = np.concatenate([ids[live], new], axis=1)
        all_x = np.concatenate([done[live], ~fresh], axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[live], ids[live], done[live] = (np.take_along_axis(a, keep, 1) for a in (all_d, all_i, all_x))

    for c in range(entry.shape[1]):
        offer(rows, entry[:, c : c + 1])
    live = rows
    while len(live):
        todo = ~done[live]
        has = todo.any(axis=1)
        live = live[has]
        if not len(live):
            break
        at = np.argmax(todo[has], axis=1)  # beams are sorted: the first is the nearest
        done[live, at] = True
        offer(live, table[ids[live, at]])
    return ids, dist


def diverse(x: np.ndarray, own: int, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Neighbours by the diversity rule, nearest first; the rest of the places go to the nearest left."""
    kept, late = [], []
    for c, d in zip(near, dist):
        if c < 0 or c == own:
            continue
        if kept:
            v = x[kept] - x[c]
            if (np.einsum("ij,ij->i", v, v) < d).any():
                late.append(c)
                continue
        kept.append(c)
        if len(kept) == most:
            break
    return np.array((kept + late)[:most], np.int64)


def build(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Levels of the points and a neighbour table per level (points x 2 LINKS or LINKS, -1 padded)."""
    n = len(x)
    level = _levels(n)
    tables = []
    for k in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level >= k)
        tables.append(_layer(x, own, 2 * LINKS if k == 0 else LINKS))
    return level, tables


def _layer(x: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Links among the points ``own``, inserted in batches that double up to a tenth of what is linked."""
    table = np.full((len(x), most), -1, np.int64)
    at = 0
    while at < len(own):
        new = own[at : at + max(64, min(1024, at // 4))]
        width = min(BEAM_BUILD, max(1, at) + len(new))
        parts_i, parts_d = [], []
        if at:
            spread = own[np.linspace(0, at - 1, min(at, 4)).astype(np.int64)]
            i, d = beam(x, table, x[new], np.tile(spread, (len(new), 1)), min(BEAM_BUILD, at))
            parts_i.append(i)
            parts_d.append(d)
        gap = (x[new] ** 2).sum(1)[:, None] + (x[new] ** 2).sum(1)[None, :] - 2 * x[new] @ x[new].T
        np.fill_diagonal(gap, np.inf)
        nearest = np.argsort(gap, axis=1, kind="stable")[:, : min(len(new) - 1, most)]
        parts_i.append(new[nearest])
        parts_d.append(np.take_along_axis(gap, nearest, 1).astype(np.float32))
        i, d = np.concatenate(parts_i, 1), np.concatenate(parts_d, 1)
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        i, d = np.take_along_axis(i, order, 1), np.take_along_axis(d, order, 1)
        back: dict[int, list[int]] = {}
        for r, p in enumerate(new):
            links = diverse(x, int(p), i[r], d[r], most)
            table[p, : len(links)] = links
            for c in links:
                back.setdefault(int(c), []).append(int(p))
        for c, more in back.items():
            held = [*dict.fromkeys([*table[c][table[c] >= 0].tolist(), *more])]
            if len(held) > most:
                v = x[held] - x[c]
                dd = np.einsum("ij,ij->i", v, v)
                o = np.argsort(dd, kind="stable")
                held = diverse(x, c, np.array(held)[o], dd[o], most).tolist()
            table[c] = -1
            table[c, : len(held)] = held
        at += len(new)
    return table


def search(x: np.ndarray, level: np.ndarray, tables: list[np.ndarray], q: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the points found per query, nearest first (-1: none)."""
    top = len(tables) - 1
    entry = np.tile(np.flatnonzero(level >= top)[:1], (len(q), 1))
    for k in range(top, 0, -1):
        entry = beam(x, tables[k], q, entry, 4)[0]
    return beam(x, tables[0], q, entry, min(width, len(x)))[0]


_GRAPH = {"shard": pa.int32(), "ids": pa.list_(pa.list_(pa.int64())), "dim": pa.int32(), "vectors": pa.binary(), "levels": pa.binary(), "neighbours": pa.list_(pa.binary())}
_GRAPH_SCHEMA = "shard int, ids array<array<bigint>>, dim int, vectors binary, levels binary, neighbours array<binary>"


def _extended(v: np.ndarray) -> np.ndarray:
    """The vectors on the scale of their largest component, with one more
    coordinate, so that all have the length of the longest. Single precision is
    enough to walk the graph; scores are computed on the vectors themselves."""
    v = v / max(np.abs(v).max(initial=0), 1e-300)
    square = (v**2).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(0, square.max(initial=0) - square))[:, None]], 1).astype(np.float32)


def _build_shard(key, table: pa.Table) -> pa.Table:
    table = table.sort_by("h")
    v = np.array(table["embedding"].to_pylist(), np.float64)
    level, tables = build(_extended(v))
    return pa.table({n: pa.array([x], kind) for (n, kind), x in zip(_GRAPH.items(), (key[0].as_py(), table["ids"].to_pylist(), v.shape[1], v.tobytes(), level.tobytes(), [t.astype(np.int32).tobytes() for t in tables]))})


def _search_block(k: int):
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}

    def run(batches):
        for rb in batches:
            for row in rb.to_pylist():
                dim, n = row["dim"], len(row["ids"])
                v = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
                least = np.array([ids[0] for ids in row["ids"]], np.int64)
                level = np.frombuffer(row["levels"], np.int32)
                tables = [np.frombuffer(t, np.int32).reshape(n, -1) for t in row["neighbours"]]
                mine = [q for q in row["queries"] if len(q["embedding"]) == dim]
                out = {c: [] for c in kinds}
                if mine:
                    q = np.array([m["embedding"] for m in mine], np.float64)
                    unit = q / np.abs(q).max(axis=1)[:, None]
                    unit /= np.linalg.norm(unit, axis=1)[:, None]
                    x = _extended(v)
                    longest = np.linalg.norm(x[0].astype(np.float64))  # of all vectors, by their extension
                    found = search(x, level, tables, np.pad((unit * longest).astype(np.float32), ((0, 0), (0, 1))), BEAM_SEARCH)
                    for m, near in zip(mine, found):
                        near = near[near >= 0]
                        score = v[near] @ np.array(m["embedding"], np.float64)
                        for i in np.lexsort((least[near], -score))[: k + 1]:
                            for vec_id in row["ids"][near[i]]:
                                if vec_id != m["vec_id"]:
                                    out["query_id"].append(m["vec_id"])
                                    out["vec_id"].append(vec_id)
                                    out["score"].append(score[i])
                yield batch(kinds, out)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per query of ``queries`` (vec_id, embedding) its ``k`` nearest rows of
    ``vectors`` but itself, by inner product: query_id, rank, vec_id, score.

    Vectors that are null, zero or hold null or non-finite components, and rows
    without an id, take no part on either side. Only vectors of the query's
    dimension are candidates. Rows that repeat id and vector count once; an id
    with several vectors is as near as the nearest of them, as a query and as a
    candidate, and is returned once. Vectors are compared in double precision.
    Ties go to the smaller vec_id. A query without candidates gives no rows.
    """
    dim = F.size("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (dim > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    pick = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    v, q = (d.select(*pick).filter(F.coalesce(sound, F.lit(False))) for d in (vectors, queries))

    # distinct vectors, with the k + 1 smallest ids of each: first per salt, then together
    v = v.withColumn("h", F.xxhash64("embedding"))
    few = F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1)
    salts = max(1, v.count() // 100_000)
    part = v.groupBy("h", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(few.alias("ids"))
    merged = part.groupBy("h", "embedding").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    merged = stored(merged, "vectors")
    dims = merged.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    shards = F.ceil(F.col("n") / shard_rows)
    dealt = merged.withColumn("dim", F.size("embedding")).join(dims, "dim").withColumn("shard", F.hash("dim", F.pmod("h", shards)))
    # graphs take far longer to build than their rows suggest: a task each, not merged
    tasks = max(1, 4 * -(-merged.count() // shard_rows))
    graphs = dealt.repartition(tasks, "shard", "dim").groupBy("shard", "dim").applyInArrow(lambda key, t: _build_shard(key, t), _GRAPH_SCHEMA)
    graphs = stored(graphs, "graphs")

    names = graphs.select("shard", "dim")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    q = q.dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding"))
    block = q.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    sent = block.join(names, "dim").select("shard", "dim", "block", "queries")  # every block to every shard of its dimension
    sent = sent.join(graphs, ["shard", "dim"]).repartition("shard", "block")
    found = map_rows(sent.select("ids", "dim", "vectors", "levels", "neighbours", "queries"), _search_block(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
