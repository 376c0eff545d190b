"""Exact dedup with a cuckoo-filter index over live digests.

A text is known by its SHA-256 and byte length. Each input partition is combined
on its own first, so a text that fills a third of the corpus crosses the shuffle
once per partition; what the partitions found is combined per digest, and the
outcome goes back to (digest, partition) pairs, whose groups are no larger than
a partition.

Defined cases: null text counts as empty; empty texts are equal; equal doc_ids
are rows of their own (each counts in group_size, and exact_groups() marks all that carry
the kept doc_id as kept; exact_dedup() leaves one of them); a null doc_id sorts below every other; keys are whole
numbers or strings, these in byte order; an empty table gives an empty result; other columns of docs are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from .common import kept_once, lean, spread_join, written

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Cuckoo filter whose slots also hold the stored key, so that hits are verified and overflow can rebuild.

    Two candidate buckets of four 16-bit fingerprints each; a fingerprint match
    is only a hint and is checked against the key in the slot's bucket. When an
    insertion cycles MAX_KICKS times, the table doubles and is filled again from
    the stored keys. Keys are digests (bytes, at least 12); values are free.
    """

    def __init__(self, buckets: int = 1 << 10) -> None:
        self._allot(max(2, 1 << (buckets - 1).bit_length()))

    def _allot(self, buckets: int) -> None:
        self.mask, self.size = buckets - 1, 0
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.keys: list[bytes | None] = [None] * (SLOTS * buckets)
        self.values: list[object] = [None] * (SLOTS * buckets)

    def _homes(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, first ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, key: bytes) -> int:
        """The slot that holds key, or -1."""
        mark, first, second = self._homes(key)
        for home in (first, second):
            for slot in range(SLOTS * home, SLOTS * home + SLOTS):
                if self.prints[slot] == mark and self.keys[slot] == key:
                    return slot
        return -1

    def insert(self, key: bytes, value: object) -> None:
        """key must not be live."""
        while (rest := self._place(key, value)) is not None:
            live = [(k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None] + [rest]
            self._allot(2 * (self.mask + 1))
            key, value = live.pop()
            for k, v in live:
                self.insert(k, v)

    def _place(self, key: bytes, value: object) -> tuple[bytes, object] | None:
        mark, first, second = self._homes(key)
        for home in (first, second):
            for slot in range(SLOTS * home, SLOTS * home + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
                    self.size += 1
                    return None
        home = second
        for kick in range(MAX_KICKS):
            slot = SLOTS * home + kick % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            key, self.keys[slot] = self.keys[slot], key
            value, self.values[slot] = self.values[slot], value
            home ^= mark * 0x5BD1E995 & self.mask
            for slot in range(SLOTS * home, SLOTS * home + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
                    self.size += 1
                    return None
        return key, value

    def delete(self, key: bytes) -> bool:
        slot = self.find(key)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


#: Digests that one index holds, about.
INDEX_ROWS = 500_000


def _combine(kind: pa.DataType):
    """One row per digest of a partition; the index holds the live row of each."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, doc, count in zip(*(batch.column(c).to_pylist() for c in ("digest", "keep_id", "group_size")), strict=True):
                if (slot := index.find(digest)) < 0:
                    index.insert(digest, (doc, count))
                    continue
                live, seen = index.values[slot]
                if doc is None or live is not None and doc <= live:
                    index.values[slot] = live, seen + count
                else:  # the live row is superseded: its entry goes, the new one enters
                    index.delete(digest)
                    index.insert(digest, (doc, seen + count))
        rows = list(index.items())
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], kind), pa.array([v[1] for _, v in part], pa.int64())], names=["digest", "keep_id", "group_size"])

    return run


def exact_groups(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key, keep_id (largest key of equal texts), group_size, kept, text_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.col(key).cast("long") if isinstance(docs.schema[key].dataType, IntegralType) else F.col(key)
    rows = docs.select(known.alias("id"), F.concat(F.unhex(F.sha2(text, 256)), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))).alias("digest"), F.spark_partition_id().alias("pid"))
    rows = written(rows, "exact-digests")
    seen = rows.select("digest", "pid", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    local = seen.groupBy("digest", "pid").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    kind, parts = rows.schema["id"].dataType, -(-rows.count() // INDEX_ROWS)
    dealt = local.drop("pid")
    dealt = dealt.repartition(parts, "digest") if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else dealt.repartition("digest")
    groups = dealt.mapInArrow(_combine(to_arrow_type(kind)), f"digest binary, keep_id {kind.simpleString()}, group_size long")
    return spread_join(rows, groups, ["digest"]).select(
        F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the copies: of equal texts, the row with the largest key stays; all columns as before.

    Each row goes or stays for its own text, whatever other rows its key has.
    """
    groups = exact_groups(docs, key)
    return kept_once(docs, key, groups.select(key, F.unhex("text_sha256").alias("digest"), "kept"))
