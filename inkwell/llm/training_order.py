"""Training-order materialisation: token ids in fixed-stride shard files.

1. Texts become token ids (unsigned 16 bit), an end-of-text id after each, and
   each scan partition's stream is cut into sequences of fixed length; its last
   one is padded with the end id. Texts are encoded once: the sequences are
   written, compressed in chunks, to a table in the checkpoint folder.
2. That table's counts give every sequence its own index and the number of all
   sequences, the size of the permutation.
3. The index goes through a keyed Feistel permutation of the next power of
   four; results out of range walk the cycle until they fall in range. That is
   the sequence's slot in the training order.
4. Sequences are range-partitioned by slot, sorted, and written as records of
   a fixed stride, ``records`` to a file. Slot s is record s % records of file
   s // records, so a reader resumes at any slot by arithmetic alone
   (``read_slots``, and ``slots`` as a DataFrame).

Files are written under temporary names and renamed when whole, so a task that
runs again after a lost executor replaces its file with the same bytes. The
description of the order is written last; readers refuse a folder without it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import batch, map_rows, mix64, stored
from inkwell.llm.tokens import Encoder, default_paths
from inkwell.session import ensure_checkpoint_dir

#: Ids of a sequence, sequences of a file, key and rounds of the permutation.
SEQUENCE, RECORDS, KEY, ROUNDS = 2048, 16384, 20260108, 6
#: Sequences of a chunk of the stored table.
CHUNK = 512


def permute(index: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The keyed permutation of 0 .. size - 1 (int64)."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << shift) | right

    out = once(np.asarray(index).astype(np.uint64))
    while (over := out >= np.uint64(size)).any():  # cycle-walking
        out[over] = once(out[over])
    return out.astype(np.int64)


def _streams(batches, sequence: int, paths: tuple[str, str]):
    """Sequences of one partition: (first doc_id that starts in it, documents
    that start in it, ids that are not padding, ids)."""
    encoder = Encoder.load(*paths)
    rest, first = np.empty(0, "<u2"), []
    for rb in batches:
        for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            first.append((len(rest), doc_id))
            rest = np.concatenate([rest, np.append(encoder.ids(text or ""), encoder.end).astype("<u2")])
            whole = len(rest) // sequence * sequence
            for at in range(0, whole, sequence):
                starts = [d for a, d in first if at <= a < at + sequence]
                yield starts[0] if starts else None, len(starts), sequence, rest[at : at + sequence]
            if whole:
                first = [(a - whole, d) for a, d in first if a >= whole]
                rest = rest[whole:]
    if len(rest):
        yield first[0][1] if first else None, len(first), len(rest), np.append(rest, np.full(sequence - len(rest), encoder.end, "<u2"))


_CHUNK = {"part": pa.int64(), "at": pa.int64(), "n": pa.int64(), "first_doc": pa.list_(pa.int64()), "n_docs": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64()), "ids": pa.binary()}
_CHUNKS = "part long, at long, n long, first_doc array<long>, n_docs array<long>, n_tokens array<long>, ids binary"


def _chunks(sequence, paths):
    def run(batches):
        part, at, held = TaskContext.get().partitionId(), 0, []
        pack = zstandard.ZstdCompressor(level=6)

        def out():
            *about, ids = zip(*held)
            rows = [[x] for x in (part, at, len(held), *map(list, about), pack.compress(b"".join(ids)))]
            return batch(_CHUNK, dict(zip(_CHUNK, rows)))

        for *about, ids in _streams(batches, sequence, paths):
            held.append((*about, ids.tobytes()))
            if len(held) == CHUNK:
                yield out()
                at, held = at + len(held), []
        if held:
            yield out()

    return run


_SEQ = {"slot": pa.int64(), "first_doc": pa.int64(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}


def _slots(stride: int, total: int, key: int):
    """The sequences of a chunk with their slots, each compressed for the shuffle."""

    def run(batches):
        pack, unpack = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
        for rb in batches:
            for index, n, *about, ids in zip(*(c.to_pylist() for c in rb.columns)):
                ids = memoryview(unpack.decompress(ids))
                ids = [pack.compress(ids[i : i + stride]) for i in range(0, n * stride, stride)]
                slot = permute(np.arange(index, index + n), total, key)
                yield batch(_SEQ, dict(zip(_SEQ, (slot, *about, ids))))

    return run


_INDEX = {"slot": pa.int64(), "shard": pa.int64(), "record": pa.int64(), "first_doc": pa.int64(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
ABOUT = "order.json"


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(folder: str, per_file: int):
    def run(batches):
        where, base = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        shard, sink, name = None, None, ""

        def close():
            if sink is not None:
                sink.close()
                where.move(name, f"{base}/{shard_name(shard)}")

        for rb in batches:
            slot, crc = rb.column(0).to_numpy(), []
            of = slot // per_file
            for i, ids in enumerate(rb.column(4)):
                if of[i] != shard:
                    close()
                    shard, name = int(of[i]), f"{base}/.{uuid.uuid4().hex}.part"
                    sink = where.open_output_stream(name)
                ids = unpack.decompress(ids.as_buffer())
                sink.write(ids)
                crc.append(zlib.crc32(ids))
            yield batch(_INDEX, dict(zip(_INDEX, (rb.column(0), of, slot % per_file, *rb.columns[1:4], crc))))
        close()

    return run


def materialise(docs: DataFrame, folder: str | None = None, sequence: int = SEQUENCE, records: int = RECORDS, key: int = KEY, paths: tuple[str, str] | None = None) -> DataFrame:
    """Write the shards to ``folder`` (a shared one; by default a new one in the
    checkpoint folder) and return their index, one row per sequence: slot,
    shard, record, first_doc (first document that starts in it), n_docs
    (documents that start in it), n_tokens (without padding), ids_crc32.

    Slots run from 0 without gaps; every shard but the last has ``records``
    sequences. A null or empty text is only its end-of-text id. Rows that repeat
    are written as often. An empty input writes no shard. Only doc_id and text
    are read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunk = stored(map_rows(d, _chunks(sequence, paths or default_paths()), _CHUNKS), "sequences")
    parts = chunk.groupBy("part").agg(F.sum("n").alias("n"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # one row per scan task: the only table that is summed in one task, and the one broadcast
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.broadcast(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    chunk = chunk.join(parts, "part").select((F.col("first") + F.col("at")).alias("index"), "n", "first_doc", "n_docs", "n_tokens", "ids")
    if folder is None:
        folder = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/training-order-{uuid.uuid4().hex}"
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    s = map_rows(chunk, _slots(2 * sequence, total, key), "slot long, first_doc long, n_docs long, n_tokens long, ids binary")
    shard = F.floor(F.col("slot") / records).cast("int")
    s = s.repartitionById(max(1, -(-total // records)), shard).sortWithinPartitions("slot")  # ranges of slots
    index = stored(map_rows(s, _write(folder, records), "slot long, shard long, record long, first_doc long, n_docs long, n_tokens long, ids_crc32 long"), "order")
    with where.open_output_stream(f"{base}/{ABOUT}") as f:
        f.write(json.dumps({"sequences": total, "sequence": sequence, "records": records, "key": key}).encode())
    return index


def described(folder: str) -> dict[str, int]:
    """sequences, sequence, records and key of a whole order."""
    where, base = fs.FileSystem.from_uri(folder)
    with where.open_input_stream(f"{base}/{ABOUT}") as f:
        return json.loads(f.read())


def _range(start: int, stop: int | None, total: int) -> tuple[int, int]:
    if start < 0 or stop is not None and stop < start:
        raise ValueError("slots run forward from 0")
    stop = total if stop is None else min(stop, total)
    return min(start, stop), stop


def read_slots(folder: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) in training order from slot ``start`` up to ``stop`` (not
    included; by default the end). Only the files that hold these slots are
    opened, the first at its record, each read from there on; what a reader
    keeps to resume is the next slot. Slots beyond the end give nothing."""
    where, base = fs.FileSystem.from_uri(folder)
    about = described(folder)
    stride, per_file = 2 * about["sequence"], about["records"]
    start, stop = _range(start, stop, about["sequences"])
    while start < stop:
        last = min(stop, (start // per_file + 1) * per_file)
        with where.open_input_file(f"{base}/{shard_name(start // per_file)}") as f:
            f.seek(start % per_file * stride)
            for slot in range(start, last):
                ids = f.read(stride)
                if len(ids) != stride:
                    raise OSError(f"slot {slot} is cut off")
                yield slot, np.frombuffer(ids, "<u2")
        start = last


def slots(spark: SparkSession, folder: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """The same slots as a DataFrame (slot, ids), one task per file."""
    about = described(folder)
    per_file = about["records"]
    start, stop = _range(start, stop, about["sequences"])
    files = range(start // per_file, -(-stop // per_file) if stop > start else start // per_file)
    kinds = {"slot": pa.int64(), "ids": pa.list_(pa.int32())}

    def run(batches):
        for rb in batches:
            for file in rb.column(0).to_pylist():
                held = []
                for row in read_slots(folder, max(start, file * per_file), min(stop, (file + 1) * per_file)):
                    held.append(row)
                    if len(held) == CHUNK:
                        yield batch(kinds, dict(zip(kinds, zip(*held))))
                        held = []
                if held:
                    yield batch(kinds, dict(zip(kinds, zip(*held))))

    return map_rows(spark.range(files.start, files.stop, 1, max(1, len(files))), run, "slot long, ids array<int>")
