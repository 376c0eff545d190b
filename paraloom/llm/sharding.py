"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard; at each level every child draws
-ln(u) / weight with u hashed from the row's key and the child's path, and the
smallest draw wins. A child's weight is the number of shards below it, so a
change of one subtree's weight moves rows only into or out of that subtree. The
shards that a cluster was set up with fill racks and regions; each later one is a
region of its own, so no other weight changes and it takes rows only into itself.

Law `key`: doc_id and the shard counts (set up with, and now) alone decide.

Defined cases: null text counts as 0 bytes (size 1, checksum 0); a null doc_id is
hashed as the string 'null'; repeated rows get the same shard and slots of their
own; an empty table gives an empty result; other columns of docs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, written

#: Rows that one slot group holds on average.
SLOT_GROUP = 20_000


@dataclass(frozen=True)
class Node:
    """A subtree: a shard if number is given, else the children below it."""

    name: str
    children: tuple[Node, ...] = ()
    number: int | None = None

    @property
    def weight(self) -> int:
        return 1 if self.number is not None else sum(c.weight for c in self.children)


def hash_tree(shards: int, setup: int | None = None, per_rack: int = 2, racks_per_region: int = 2) -> Node:
    """Shards 0 to setup - 1 (default: all) in regions of racks of shards, each of the others in a region of its own."""
    setup = min(shards, shards if setup is None else setup)
    leaf = lambda i: Node(f"shard{i}", number=i)
    racks = [Node(f"rack{i // per_rack}", tuple(leaf(j) for j in range(i, min(i + per_rack, setup)))) for i in range(0, setup, per_rack)]
    regions = [Node(f"region{i // racks_per_region}", tuple(racks[i : i + racks_per_region])) for i in range(0, len(racks), racks_per_region)]
    later = [Node(f"later{i}", (Node("rack", (leaf(i),)),)) for i in range(setup, shards)]
    return Node("root", (*regions, *later))


def _draw(key: Column, path: str, weight: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def descend(key: Column, node: Node, path: str = "") -> Column:
    """The number of the shard that key (a string column) falls to."""
    if node.number is not None:
        return F.lit(node.number)
    if len(node.children) == 1:
        return descend(key, node.children[0], f"{path}/{node.children[0].name}")
    paths = [f"{path}/{c.name}" for c in node.children]
    winner = F.array_min(F.array(*(F.struct(_draw(key, p, c.weight).alias("draw"), F.lit(i).alias("i")) for i, (p, c) in enumerate(zip(paths, node.children, strict=True)))))["i"]
    out = descend(key, node.children[-1], paths[-1])
    for i in range(len(paths) - 2, -1, -1):
        out = F.when(winner == i, descend(key, node.children[i], paths[i])).otherwise(out)
    return out


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", setup: int | None = None) -> DataFrame:
    """Per row: key, size, text_crc32, shard, grown_shard (with one shard more) and slot, gapless from 0 in its shard.

    setup: the number of shards that the cluster was set up with, if some were added since.
    """
    setup = shards if setup is None else setup
    ident = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        descend(ident, hash_tree(shards, setup)).cast("int").alias("shard"),
        descend(ident, hash_tree(shards + 1, setup)).cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("pid"),
    )
    rows = written(rows, "shards")
    groups = max(1, rows.count() // (SLOT_GROUP * shards))
    # rows that repeat one key spread over the partitions they were read in
    rows = rows.withColumn("sub", F.pmod(F.xxhash64(key, "text_crc32", "pid"), F.lit(groups)).cast("int"))
    slotted = gapless_rank(rows, "shard", "sub", [key, "text_crc32"], "slot")
    return slotted.select(key, "size", "text_crc32", "shard", "slot", "grown_shard")
