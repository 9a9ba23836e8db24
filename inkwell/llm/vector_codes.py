"""Vector compression by product codes, with equal-average search.

A vector is cut into equal parts; each part is coded as its nearest entry of a
codebook of its own. Codebooks are trained in rounds: every part of every
vector goes to its nearest entry, then an entry becomes the floor of its parts'
mean. All arithmetic is on integers, so results do not depend on how the rows
are partitioned.

The nearest entry is found by equal-average search. With entries sorted by the
sum of their components, an entry whose sum differs by g from the part's sum is
at a squared distance of at least g * g / m (m components). The search expands
outward from the part's own sum and ends where that bound strictly exceeds the
best distance so far, so ties still go to the lower index.

Spark reads the table once for the seeds and once for each round; the rounds exchange
only sums per entry (entries x components per task) and the codebooks, whose
size is set by parameters and never by the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import batch, fingerprints, join_spread, map_rows, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

#: Parts of similar sums that are searched together, and entries added at a time.
_BLOCK, _STEP = 512, 32


def _kind(largest: int, m: int):
    """Doubles where they hold every product and sum of a search exactly, else
    Python integers."""
    return np.float64 if (2 * largest * m) ** 2 < 1 << 53 else object


def _most(a: np.ndarray) -> int:
    return int(np.abs(a).max(initial=0))


def to_integers(components: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles; Python integers where 64 bits do not hold them."""
    # the factor is a power of two, so the product is exact unless it overflows
    if len(components) and np.abs(components).max() * SCALE >= 2.0**53:
        whole = [int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in components.ravel().tolist()]
        out = np.empty(len(whole), object)
        out[:] = whole
        return out.reshape(components.shape)
    return np.floor(components * SCALE).astype(np.int64)


class Codebook:
    """The entries of one part (k x m integers), ready to be searched."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)), np.int64)
        self.entries, self.sums = entries, sums[self.order]
        self.m = entries.shape[1]
        self.largest = _most(entries)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance to it, per row.

        Rows go in blocks of similar sums. A block's search starts with the
        entries between its sums and expands to both sides, until the bound
        strictly exceeds the best distance for every row of the block."""
        kind = _kind(max(self.largest, _most(parts)), self.m)
        entries, sums, parts = self.entries.astype(kind), self.sums.astype(kind), parts.astype(kind)
        own = parts.sum(axis=1)
        rows = np.argsort(own, kind="stable")
        index, best = np.zeros(len(parts), np.int64), np.zeros(len(parts), kind)
        for at in range(0, len(rows), _BLOCK):
            here = rows[at : at + _BLOCK]
            index[here], best[here] = self._search(entries, sums, parts[here], own[here])
        return index, best

    def _search(self, entries, sums, parts, own):
        k, index, best = len(sums), None, None
        norm = (parts * parts).sum(axis=1)
        lo, hi = np.searchsorted(sums, own[0]), np.searchsorted(sums, own[-1], "right")
        if lo == hi:  # no entry between: begin with one beside
            lo, hi = (lo, hi + 1) if hi < k else (lo - 1, hi)
        new = [(lo, hi)]
        while new:
            for a, b in new:
                at = np.sort(self.order[a:b])  # columns by index: the first smallest is the lowest
                some = entries[at]
                dist = norm[:, None] - 2 * (parts @ some.T) + (some * some).sum(axis=1)[None]
                pick = dist.argmin(axis=1)
                found, dist = at[pick], dist[np.arange(len(pick)), pick]
                if best is None:
                    index, best = found, dist
                else:
                    better = (dist < best).astype(bool) | ((dist == best).astype(bool) & (found < index))
                    index, best = np.where(better, found, index), np.where(better, dist, best)
            new, limit = [], best * self.m
            if lo > 0 and ((own - sums[lo - 1]) ** 2 <= limit).any():
                new.append((max(0, lo - _STEP), lo))
                lo = new[-1][0]
            if hi < k and ((sums[hi] - own) ** 2 <= limit).any():
                new.append((hi, min(k, hi + _STEP)))
                hi = new[-1][1]
        return index, best


def _matrix(rb: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a batch as integers, and their row numbers."""
    col = rb.column("embedding")
    size = np.asarray(col.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    if not len(rows):
        return np.zeros((0, dim), np.int64), rows
    flat = col.take(pa.array(rows)).flatten()
    return to_integers(np.asarray(flat, np.float64).reshape(len(rows), dim)), rows


def _books(entries: list[np.ndarray]) -> list[Codebook]:
    return [Codebook(e) for e in entries]


def _part(whole: np.ndarray, p: int, m: int) -> np.ndarray:
    return whole[:, p * m : (p + 1) * m]


_SUM_KINDS = {"part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.string())}
_SUM_SCHEMA = "part int, entry int, n long, sums array<string>"


def _sum_rows(count: dict, total: dict) -> pa.RecordBatch:
    # decimal text: sums are exact whatever their size
    keys = sorted(count)
    return batch(_SUM_KINDS, {
        "part": [p for p, _ in keys], "entry": [e for _, e in keys], "n": [count[k] for k in keys],
        "sums": [[str(x) for x in total[k]] for k in keys],
    })


def _assign_and_sum(entries: list[np.ndarray], dim: int):
    """One row per part and entry that a task's vectors use."""

    def run(batches):
        books, m = _books(entries), dim // len(entries)
        count, total = {}, {}
        for rb in batches:
            whole, _ = _matrix(rb, dim)
            for p, book in enumerate(books):
                mine = _part(whole, p, m)
                index, _ = book.nearest(mine)
                order = np.argsort(index, kind="stable")
                used, start, n = np.unique(index[order], return_index=True, return_counts=True)
                if not len(used):
                    continue
                kind = np.int64 if _most(mine) * len(mine) < 1 << 62 else object
                sums = np.add.reduceat(mine[order].astype(kind), start, axis=0)
                for e, k, s in zip(used.tolist(), n.tolist(), sums.tolist()):
                    key = (p, e)
                    count[key] = count.get(key, 0) + k
                    total[key] = [a + b for a, b in zip(total[key], s)] if key in total else s
        yield _sum_rows(count, total)

    return run


def _merge_sums(batches):
    """The rows of each part and entry, which lie in one task, as one row."""
    count, total = {}, {}
    for rb in batches:
        for row in rb.to_pylist():
            key, s = (row["part"], row["entry"]), [int(x) for x in row["sums"]]
            count[key] = count.get(key, 0) + row["n"]
            total[key] = [a + b for a, b in zip(total[key], s)] if key in total else s
    yield _sum_rows(count, total)


def _retrain(vectors: DataFrame, entries: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round; unused entries stay."""
    partial = map_rows(vectors, _assign_and_sum(entries, dim), _SUM_SCHEMA)
    merged = map_rows(partial.repartition("part", "entry"), _merge_sums, _SUM_SCHEMA)
    new = [e.astype(object) for e in entries]
    for row in merged.collect():  # at most one row for each entry
        new[row["part"]][row["entry"]] = [int(x) // row["n"] for x in row["sums"]]
    return [_narrow(e) for e in new]


def _narrow(entries: np.ndarray) -> np.ndarray:
    return entries.astype(np.int64) if _most(entries) < 1 << 53 else entries


def _encode(entries: list[np.ndarray], dim: int):
    """Code and error of every row; null where the vector cannot be cut."""

    def run(batches):
        books, m = _books(entries), dim // len(entries) if dim else 0
        kinds = {"code": pa.string(), "error": pa.int64()}
        for rb in batches:
            whole, rows = _matrix(rb, dim)
            codes, errors = [None] * rb.num_rows, [None] * rb.num_rows
            if books and len(rows):
                found = [book.nearest(_part(whole, p, m)) for p, book in enumerate(books)]
                for j, r in enumerate(rows.tolist()):
                    codes[r] = "".join(f"{int(i[j]):02x}" for i, _ in found)
                    error = sum(int(d[j]) for _, d in found)
                    errors[r] = error if error < 1 << 63 else None
            out = batch(kinds, {"code": codes, "error": errors})
            rest = rb.select([n for n in rb.schema.names if n != "embedding"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *out.columns], [*rest.schema.names, *kinds])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), label (its text) of the rows whose vector is
    there and has only finite components."""
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    label = (F.col("label") if "label" in vectors.columns else F.lit(None)).cast("string").alias("label")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label)
    return v.filter(F.col("embedding").isNotNull() & finite)


def seeds(vectors: DataFrame, parts: int, entries: int) -> tuple[list[np.ndarray], int]:
    """Codebooks of the rows with the smallest ids, ascending, and the
    dimension of the vectors. At most ``entries`` rows come to the driver."""
    kept = vectors.filter("vec_id is not null").select("vec_id", "embedding")
    whole = kept.filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first = whole.orderBy("vec_id", "embedding").limit(1).collect()
    if not first:
        return [], 0
    dim = len(first[0]["embedding"])
    rows = whole.filter(F.size("embedding") == dim).orderBy("vec_id", "embedding").limit(entries).collect()
    table = to_integers(np.array([r["embedding"] for r in rows], np.float64))
    m = dim // parts
    return [_part(table, p, m) for p in range(parts)], dim


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks of ``parts`` parts and the dimension they are for; ([], 0)
    where no vector can be cut."""
    books, dim = seeds(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        books = _retrain(vectors.select("embedding"), books, dim)
    return books, dim


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for e in books for x in e.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per row with a usable vector: vec_id, code, error, label_error,
    codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are
    dropped; an empty table gives no rows. The dimension is that of the
    smallest id whose vector can be cut into ``parts``; vectors of another
    length have no code and no error (null). Rows without an id are coded and
    trained on, but are no seeds; with fewer than ``entries`` seeds the
    codebooks are smaller. Repeated rows count each time, and rows that repeat
    an id are seeds in the order of their vectors. An error beyond 64 bits is
    null, as is a sum of errors. Null labels, like a missing label column, are
    one label. Other columns are not read. ``entries`` is at most 256 (two hex
    digits).
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    v = usable(vectors)
    books, dim = train(v, parts, entries, rounds)
    coded = map_rows(v.select("vec_id", "embedding", *fingerprints("label")), _encode(books, dim), "vec_id long, _fp1 long, _fp2 long, code string, error long")
    coded = stored(coded, "codes")
    label = ["_fp1", "_fp2"]
    total = coded.groupBy(*label).agg(F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)").alias("label_error"))
    out = join_spread(coded, total, label, F.xxhash64("vec_id", "code"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
