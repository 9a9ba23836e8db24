"""Packing documents into fixed-length sequences, shortest pack first.

1. Every document becomes its token ids and an end id, cut into whole
   sequences and one remainder. Only lengths and checksums leave the tokeniser.
2. The histogram of lengths (at most ``sequence`` rows, whatever the input)
   goes to the driver. Lengths are placed longest first; a length goes into
   the pack with the most room, and opens new packs if that has too little.
   Packs are never listed: patterns with counts are, and a placement splits a
   pattern's count.
3. Pieces get their rank within their length (counted in hash-range buckets),
   and the patterns map each (length, rank) to a sequence and an offset.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import batch, map_rows, running_sum, stored
from inkwell.llm.tokens import Encoder, default_paths

SEQUENCE, END_ID = 2048, 1

_PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}


def _pieces(sequence: int, end_id: int, paths: tuple[str, str]):
    def run(batches):
        encoder = Encoder.load(*paths)
        for rb in batches:
            out = {n: [] for n in _PIECE}
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                ids = np.append(encoder.ids(text or ""), end_id).astype("<u4")
                for at in range(0, len(ids), sequence):
                    piece = ids[at : at + sequence]
                    for n, v in zip(_PIECE, (doc_id, at, len(piece), zlib.crc32(piece), len(ids))):
                        out[n].append(v)
            yield batch(_PIECE, out)

    return run


def patterns(histogram: dict[int, int], sequence: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths in order) of every kind of pack, shortest pack first."""
    packs = []  # (minus room, tie, count, lengths)
    tie = 0
    for length in sorted(histogram, reverse=True):
        left, again = histogram[length], []
        while left:
            room = -packs[0][0] if packs else 0
            if room < length:
                # no pack has room: as many new packs as the pieces left over
                tie += 1
                heapq.heappush(packs, (length - sequence, tie, left, (length,)))
                break
            room, _, count, held = heapq.heappop(packs)
            use = min(left, count)
            if use < count:
                again.append((room, count - use, held))
            tie += 1
            heapq.heappush(packs, (room + length, tie, use, (*held, length)))
            left -= use
        for room, count, held in again:
            tie += 1
            heapq.heappush(packs, (room, tie, count, held))
    return [(count, held) for _, _, count, held in sorted(packs)]


def assignment(plan: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset) by first rank."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, held in plan:
        at = 0
        for length in held:
            table.setdefault(length, []).append((used.get(length, 0), sequence, at))
            used[length] = used.get(length, 0) + count
            at += length
        sequence += count
    return {length: np.array(rows, np.int64) for length, rows in table.items()}


def _place(table: dict[int, np.ndarray]):
    def run(batches):
        for rb in batches:
            length, rank = (rb.column(rb.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for one in np.unique(length):
                here = length == one
                rows = table[one]
                k = np.searchsorted(rows[:, 0], rank[here], "right") - 1
                sequence[here] = rows[k, 1] + rank[here] - rows[k, 0]
                offset[here] = rows[k, 2]
            kept = rb.select([n for n in rb.schema.names if n != "rank"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its one piece is the end id. Texts of any length are
    cut every ``sequence`` ids. Rows that repeat are packed as often as they
    occur; which of equal pieces gets which place is open. An empty input gives
    no rows. Only doc_id and text are read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(map_rows(d, _pieces(sequence, end_id, paths or default_paths()), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `sequence` rows
    table = assignment(patterns(histogram, sequence))
    keyed = pieces.withColumn("_key", F.xxhash64("doc_id", "start", "ids_crc32")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sum(keyed, ["length"], "_key", ["doc_id", "start"], "_one", "rank", sum(histogram.values())).drop("_key", "_one")
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return ranked.mapInArrow(_place(table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
