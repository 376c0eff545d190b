"""An inverted index of posting blocks: sorted ids of a term, delta-coded, a bounded number a row.

Pairs (term, id) are made distinct and sorted over all partitions, so a term that a third of all documents
have is dealt over as many tasks as it needs; each task cuts its run of a term into blocks of at most BLOCK_IDS ids.
A block holds its first and last id, and the differences between neighbours as bytes of 7 bits, low ones first.
A reader of some terms or of some ids skips blocks by term, first and last without decoding them.

Ids are longs of any sign; null terms and ids have no posting. No row is longer than its term and
10 * BLOCK_IDS bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_IDS = 1024
#: Blocks that are decoded at once.
ROWS_AT_ONCE = 1024
BLOCKS = "term string, first long, last long, n int, deltas binary"


def coded(values: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes of 7 bits, the high bit set on all but a number's last byte."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >> np.uint64(7 * k) > 0
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    parts = (np.repeat(values, sizes) >> (np.uint64(7) * place.astype(np.uint64))) & np.uint64(0x7F)
    more = place < np.repeat(sizes, sizes) - 1
    return (parts | (more.astype(np.uint64) << np.uint64(7))).astype(np.uint8).tobytes()


def decoded(data: bytes) -> np.ndarray:
    """The numbers of coded()."""
    octets = np.frombuffer(data, np.uint8)
    if not len(octets):
        return np.zeros(0, np.uint64)
    starts = np.concatenate(([0], np.flatnonzero(octets < 0x80)[:-1] + 1))
    place = np.arange(len(octets)) - np.repeat(starts, np.diff(np.append(starts, len(octets))))
    return np.add.reduceat((octets & 0x7F).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64)), starts)


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, held = None, np.zeros(0, np.int64)

        def given(whole: bool) -> list[dict]:
            """Blocks of the term at hand: all of them, or those that are full."""
            nonlocal held
            rows = []
            while len(held) >= most or (whole and len(held)):
                ids, held = held[:most], held[most:]
                gaps = ids[1:].view(np.uint64) - ids[:-1].view(np.uint64)
                rows.append({"term": term, "first": int(ids[0]), "last": int(ids[-1]), "n": len(ids), "deltas": coded(gaps)})
            return rows

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            shape = pa.schema([("term", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int32()), ("deltas", pa.binary())])
            return pa.RecordBatch.from_pylist(rows, shape)

        for batch in batches:
            terms, ids, rows = batch.column("term").dictionary_encode(), batch.column("id").to_numpy(), []
            codes = terms.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)] if len(codes) else [0]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                name = terms.dictionary[int(codes[s])].as_py()
                if name != term:
                    rows += given(True)
                    term = name
                held = np.concatenate((held, ids[s:e]))
                rows += given(False)
            if rows:
                yield batch_of(rows)
        if rows := given(True):
            yield batch_of(rows)

    return run


def posting_blocks(docs: DataFrame, terms: Column, key: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of the terms (an array) of docs: term, first, last, n, deltas."""
    pairs = docs.select(F.col(key).cast("long").alias("id"), F.explode(F.array_distinct(terms)).alias("term")).where("id IS NOT NULL AND term IS NOT NULL").distinct()
    return pairs.repartitionByRange("term", "id").sortWithinPartitions("term", "id").select("term", "id").mapInArrow(_blocks(block_ids), BLOCKS)


def postings(blocks: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """The postings (term, id) of blocks, of ids from low to high; blocks outside are not decoded."""
    if low is not None:
        blocks = blocks.where(F.col("last") >= low)
    if high is not None:
        blocks = blocks.where(F.col("first") <= high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [np.cumsum(np.concatenate((np.array([first], np.int64).view(np.uint64), decoded(deltas)))).view(np.int64) for first, deltas in zip(batch.column("first").to_pylist(), batch.column("deltas").to_pylist(), strict=True)]
            for at in range(0, len(runs), ROWS_AT_ONCE):
                part = runs[at : at + ROWS_AT_ONCE]
                of = pa.array(np.repeat(np.arange(at, at + len(part)), [len(r) for r in part]))
                yield pa.RecordBatch.from_arrays([batch.column("term").take(of), pa.array(np.concatenate(part))], names=["term", "id"])

    found = blocks.select("term", "first", "deltas").mapInArrow(run, "term string, id long")
    return found.where((F.col("id") >= low) if low is not None else F.lit(True)).where((F.col("id") <= high) if high is not None else F.lit(True))


def with_all(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """The ids that have all the terms. Only these terms' blocks are read, and of them those that meet the span that all share."""
    wanted = sorted(set(terms))
    mine = blocks.where(F.col("term").isin(wanted))
    spans = mine.groupBy("term").agg(F.min("first").alias("a"), F.max("last").alias("b"))
    low, high, n = spans.agg(F.max("a"), F.min("b"), F.count(F.lit(1))).first()
    if n < len(wanted) or low > high:
        return mine.select(F.col("first").alias("id")).limit(0)
    return postings(mine, low, high).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("id")
