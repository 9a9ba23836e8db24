"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

DataFrame functions only. At each level a row draws ``-ln(u) / weight`` for
every child, with u a hash of the row's key and the child's name, and descends
into the smallest draw. A child's draw depends on its own name and weight
alone. So a change of one weight moves rows only into (or out of) that child,
and every other subtree keeps its rows. A new shard that enters as a region of
its own therefore takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import running_sum, stored

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Eight equal shards: two regions of two racks of two shards.
EIGHT: Tree = {
    "region0": {"rack0": {0: 1.0, 1: 1.0}, "rack1": {2: 1.0, 3: 1.0}},
    "region1": {"rack2": {4: 1.0, 5: 1.0}, "rack3": {6: 1.0, 7: 1.0}},
}


def with_region(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region and rack of its own."""
    return {**tree, f"region-of-{shard}": {f"rack-of-{shard}": {shard: weight}}}


def _weight(node) -> float:
    return float(sum(map(_weight, node.values()))) if isinstance(node, Mapping) else float(node)


def _descend(key: Column, node: Mapping, path: str) -> Column:
    draws = []
    for name, child in node.items():
        weight = _weight(child)
        if weight <= 0:
            continue
        here = f"{path}/{name}"
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(here), key), 11) + 1) / F.lit(float(2**53))
        draws.append((-F.log(u) / F.lit(weight), name, child, here))
    if not draws:
        raise ValueError(f"no positive weight below {path!r}")
    best = F.least(*[d[0] for d in draws]) if len(draws) > 1 else draws[0][0]
    out = None
    for draw, name, child, here in draws:
        inner = _descend(key, child, here) if isinstance(child, Mapping) else F.lit(int(name))
        out = F.when(draw <= best, inner) if out is None else out.when(draw <= best, inner)
    return out


def shard_of(key: Column, tree: Tree, seed: str = "inkwell") -> Column:
    """The shard of a key. A null key has one defined shard of its own hash."""
    return _descend(key, tree, seed).cast("int")


def shard_documents(docs: DataFrame, tree: Tree = EIGHT, grown: Tree | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1 (null text: 1, checksum 0). Slots run
    gapless from 0 in each shard, in the order of a hash of id and checksum;
    they are counted in hash-range buckets, so no task orders a whole shard.
    Rows equal in all of these get their slots in any order.
    """
    grown = grown or with_region(tree, 1 + max(s for racks in tree.values() for r in racks.values() for s in r))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    d = docs.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
    ).withColumn("_key", F.xxhash64("doc_id", "text_crc32")).withColumn("_one", F.lit(1).cast("long"))
    d = stored(d, "shards")  # the texts are read once
    d = running_sum(d, ["shard"], "_key", ["doc_id", "size"], "_one", "slot", d.count())
    return d.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
