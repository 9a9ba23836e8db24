"""Near-duplicate documents: MinHash, banding, verification, components.

1. Each text becomes its set of word shingles; equal sets are merged at once
   (one representative, the smallest id), so exact copies cost nothing more.
2. ``bands * rows`` universal hash functions (multiply-shift with random 64-bit
   odd multipliers) give minima. A band's minima make one bucket key; one byte
   of each minimum is kept as a signature.
3. In each bucket every member is tested against one hub only, which is linear
   in the bucket: the member whose buckets are fullest, as a rule the text the
   others were copied from. Each member takes the hub it shares most buckets
   with. Tests go by signature first and then by the full sets.
4. Components by alternating large-star and small-star.
5. Buckets that now hold more than one component are compared again: members
   outside the bucket's largest component against all members, in blocks,
   skipping pairs of one component. So no pair of a bucket is left untested
   unless it is already connected. Blocks of signatures tell which members
   have a likely partner; blocks of those carry the full sets and give back
   links only. The components are computed once more.

No cap on buckets, candidates or partners. With 40 bands of 6 rows a pair of
similarity 0.8 shares a bucket with probability 1 - 5e-6 (more above 0.8).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import among, ascii_words, batch, map_rows, mix64, stored, windows, word_hashes

BANDS, ROWS, SEED = 40, 6, 20260101
#: A signature may fall short of the threshold by this much: over 4 standard
#: deviations of the estimate from 240 minima, so real links pass.
MARGIN = 0.11
#: Members of a bucket compared with as many others at a time.
SIGNATURE_BLOCK, SET_BLOCK = 2048, 128


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a shorter text is one shingle, no words are none."""
    words = ascii_words(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(word_hashes(words), min(width, len(words))))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, np.uint64) * np.uint64(2)


def _minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of (a x + b) mod 2^64, high 32 bits, over 32-bit x, per function."""
    x = x & np.uint64(0xFFFFFFFF)
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 64):
        v = np.multiply.outer(a, x[i : i + 64])
        v += b[:, None]
        np.minimum(low, v.min(axis=1), out=low)
    return low >> np.uint64(32)


_SIGNED = {
    "doc_id": pa.int64(), "n_shingles": pa.int64(), "set1": pa.int64(), "set2": pa.int64(),
    "bands": pa.list_(pa.int64()), "sig": pa.binary(),
}


def _sign(width: int, bands: int, rows: int):
    def run(batches):
        a, b = _functions(bands * rows)
        tag = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for rb in batches:
            out = {n: [] for n in _SIGNED}
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                s = shingle_set(text, width)
                keys, sig = None, None
                if len(s):
                    low = _minima(s, a, b)
                    k = tag.copy()
                    for col in low.reshape(bands, rows).T:
                        k = mix64(k + col)
                    keys, sig = k.view(np.int64), (low >> np.uint64(5)).astype(np.uint8).tobytes()
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                for n, v in zip(_SIGNED, (doc_id, len(s), (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, keys, sig)):
                    out[n].append(v)
            yield batch(_SIGNED, out)

    return run


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity from one-byte signatures (chance agreement 1/256 removed)."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _signature_test(least: float):
    def run(batches):
        for rb in batches:
            if rb.num_rows:
                x, y = (np.frombuffer(b"".join(rb.column(c).to_pylist()), np.uint8).reshape(rb.num_rows, -1) for c in (2, 3))
                ok = _agreement(x, y) >= least
                yield rb.select([0, 1]).filter(pa.array(ok))

    return run


def _unpack(column, i: int, with_sets: bool):
    """Arrays of the members in row ``i``: rep, component, sig, and with sets
    also bands, shingles, their number and first place."""
    one = column.slice(i, 1).flatten()
    rep, component = (one.field(n).to_numpy() for n in ("rep", "component"))
    sig = np.frombuffer(b"".join(one.field("sig").to_pylist()), np.uint8).reshape(len(one), -1)
    if not with_sets:
        return rep, component, sig
    bands = one.field("bands").flatten().to_numpy().reshape(len(one), -1)
    size = one.field("shingles").value_lengths().to_numpy()
    return rep, component, sig, bands, one.field("shingles").flatten().to_numpy(), size, np.cumsum(size) - size


def _near_members(least: float):
    """``bucket, rep`` of the members with a partner of another component whose
    signature agrees; at most one row for each member and block."""

    def run(batches):
        for rb in batches:
            for i in range(rb.num_rows):
                (ra, ca, sa), (rb_, cb, sb) = (_unpack(rb.column(c), i, False) for c in (1, 2))
                near = set()
                for j in range(len(ra)):
                    hit = rb_[(cb != ca[j]) & (_agreement(sb, sa[j]) >= least)]
                    if len(hit):
                        near.add(ra[j])
                        near.update(hit)
                yield batch({"bucket": pa.int64(), "rep": pa.int64()}, {"bucket": [rb.column(0)[i].as_py()] * len(near), "rep": list(near)})

    return run


def _block_test(least: float, percent: int):
    """Links between two blocks of one bucket's members. Signatures come first;
    then pairs whose first common bucket is this one are compared in full."""

    def run(batches):
        for rb in batches:
            for i in range(rb.num_rows):
                bucket = rb.column(0)[i].as_py()
                (ra, ca, sa, ka, xa, na, fa), (rb_, cb, sb, kb, xb, nb, fb) = (_unpack(rb.column(c), i, True) for c in (1, 2))
                a, b = [], []
                for j in range(len(ra)):
                    hit = np.flatnonzero((cb != ca[j]) & (_agreement(sb, sa[j]) >= least))
                    if not len(hit):
                        continue
                    hit = hit[ka[j][np.argmax(kb[hit] == ka[j], axis=1)] == bucket]
                    if not len(hit):
                        continue
                    own = np.sort(xa[fa[j] : fa[j] + na[j]])
                    theirs = np.concatenate([xb[fb[o] : fb[o] + nb[o]] for o in hit])
                    shared = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                    shared = np.add.reduceat(shared.astype(np.int64), np.cumsum(nb[hit]) - nb[hit])
                    for o in hit[100 * shared >= percent * (na[j] + nb[hit] - shared)]:
                        a.append(min(ra[j], rb_[o]))
                        b.append(max(ra[j], rb_[o]))
                yield batch({"a": pa.int64(), "b": pa.int64()}, {"a": a, "b": b})

    return run


def _block_pairs(member: DataFrame, columns: list[str], size: int) -> DataFrame:
    """``bucket, a, b``: blocks of a bucket's members outside its largest
    component (a) beside blocks of all its members (b). ``member`` has bucket,
    rep, component, largest, size (of the bucket) and ``columns``."""
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / size))
    inside = F.collect_list(F.struct("rep", "component", *columns))
    whole = member.groupBy("bucket", block.alias("block")).agg(inside.alias("b")).drop("block")
    rest = member.filter("component <> largest").groupBy("bucket", block.alias("block")).agg(inside.alias("a")).drop("block")
    return rest.join(whole, "bucket").select("bucket", "a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of undirected edges ``a, b``.

    Alternating large-star and small-star; each round is grouped minima and a
    join, written to the checkpoint folder. Ends when a round changes nothing.
    No nodes without edges are returned.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, mark = stored(e, "edges"), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or now[0] == 0:
            break
        mark = tuple(now)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stored(e.distinct(), "edges")
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)


def _sets(width: int):
    def run(batches):
        for rb in batches:
            ids, sets, keys = [], [], []
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                s = shingle_set(text, width)
                ids.append(doc_id)
                sets.append(s.view(np.int64))
                keys.append((xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - 2**63)
            yield batch({"rep": pa.int64(), "set1": pa.int64(), "shingles": pa.list_(pa.int64())}, {"rep": ids, "set1": keys, "shingles": sets})

    return run


def _full_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``rep, sig, bands, shingles`` of the wanted representatives, from their texts."""
    texts = among(docs, "doc_id", wanted)
    sets = map_rows(texts.select("doc_id", "text"), _sets(width), "rep long, set1 long, shingles array<long>")
    # rows may repeat an id; the set of the representative is the one meant
    return sets.dropDuplicates(["rep", "set1"]).join(reps.select("rep", "set1", "sig", "bands"), ["rep", "set1"]).select("rep", "sig", "bands", "shingles")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * shared shingles >= ``percent`` * all shingles.
    Empty or null texts have no shingles and stand alone. Rows without an id
    take no part: component_id is null and they are kept. Rows that repeat an
    id and text share their component. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    least = percent / 100 - MARGIN
    signed = stored(map_rows(docs, _sign(width, bands, rows), "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, sig binary"), "signed")
    sets = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = stored(sets.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "reps")

    entries = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = stored(entries.join(shared, "bucket"), "buckets")
    fame = entries.groupBy("rep").agg(F.sum("n").alias("fame"))
    hubs = entries.join(fame, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("fame", -F.col("rep"))).alias("hub"))
    entries = entries.select("bucket", "rep")
    near = entries.join(hubs, "bucket").filter("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("n"))
    near = near.groupBy("rep").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    # all that later rounds need of the documents that share a bucket at all
    sets = stored(_full_sets(docs, reps, stored(entries.select("rep").distinct(), "busy"), width), "sets")
    sig = sets.select("rep", "sig")
    near = near.join(sig, "rep").join(sig.select(F.col("rep").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    pairs = map_rows(near.select(F.col("hub").alias("a"), F.col("rep").alias("b"), "sig", "hub_sig"), _signature_test(least), "a long, b long")
    a, b = (sets.select(F.col("rep").alias(n), F.col("shingles").alias(f"s{n}")) for n in ("a", "b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(a, "a").join(b, "b").withColumn("_both", shared)
    links = stored(links.filter(100 * F.col("_both") >= percent * (F.size("sa") + F.size("sb") - F.col("_both"))).select("a", "b"), "links")
    found = stored(components(links), "components")

    # what is left: buckets with several components
    member = entries.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    per = member.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("bucket").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("largest")).filter("parts > 1")
    member = stored(member.join(mixed, "bucket").drop("parts"), "mixed")
    near = map_rows(_block_pairs(member.join(sig, "rep"), ["sig"], SIGNATURE_BLOCK), _near_members(least), "bucket long, rep long")
    near = member.drop("size").join(near.distinct(), ["bucket", "rep"])
    near = stored(near, "near")
    near = near.join(near.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "bucket")
    near = near.join(sets, "rep")
    more = map_rows(_block_pairs(near, ["sig", "bands", "shingles"], SET_BLOCK), _block_test(least, percent), "a long, b long").distinct()
    found = components(links.union(more))

    by_set = reps.select("set1", "set2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set1", "set2", F.coalesce("component", "rep").alias("component_id"))
    out = signed.drop("bands", "sig").join(by_set, ["set1", "set2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
