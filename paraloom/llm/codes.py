"""Vector codes: every vector is cut into parts, and each part is told by the nearest entry of its position's codebook.

Codebooks are learned by Lloyd's rounds with Elkan's bounds. All decisions are on
integers: components are floor(SCALE * x), distances their squared sums, new
entries floor(sum / count), so rows and executors give the same codes in any order.

A pass reads the vectors with what the pass before knew of each part: its entry,
an upper bound of the distance to it and a lower bound of the distance to each
entry, both shifted by how far the entries have moved since. Entries that the
triangle inequality puts strictly farther than the own one are left out; distances
to the others are computed as integers, and ties go to the lower index. Bounds are
the upper half of a float's bits, rounded away from the truth, so they are never
wrong, only loose. Each pass is written in the shared folder with a few rows of
sums beside the vectors, of which the driver gets PARTS * ENTRIES * (components + 1)
totals, whatever the number of vectors. The table of the pass before goes.

Defined cases: rows go whose vector is null or has null or non-finite components;
components times SCALE must stay below LIMIT and all vectors must be of one length,
a multiple of the parts, else a ValueError says so (their squares would leave a
long); no components at all give code zeros and error 0. The first entries are the
rows with the smallest keys, null keys last, rows of one key by components; fewer
rows than entries make fewer entries. Repeated rows count as often as they occur.
An empty table gives an empty result. Null labels are one label; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, removed, small_batches, spread_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components must be smaller, so that squared distances of 4,096 components and sums of 2**37 rows fit a long.
LIMIT = 1 << 25


def kept_vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, x): the rows whose vectors are whole, with integer components."""
    scaled = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & F.forall("v", finite))
    fits = F.forall(F.col("v"), lambda x: F.abs(x.cast("double")) * SCALE < LIMIT)
    wrong = F.raise_error(F.lit(f"a component times {SCALE} is not below {LIMIT}"))
    return kept.select("key", "label", F.when(fits, F.transform(scaled, lambda x: x.cast("int"))).otherwise(wrong.cast("array<int>")).alias("x"))


def upper_half(x: np.ndarray) -> np.ndarray:
    """Positive floats as 16 bits, never smaller than they are."""
    bits = np.nextafter(x.astype(np.float32), np.float32(np.inf)).view(np.uint32)
    return ((bits + np.uint32(0xFFFF)) >> np.uint32(16)).astype(np.uint16)


def lower_half(x: np.ndarray) -> np.ndarray:
    """Floats from 0 as 16 bits, never greater than they are."""
    bits = np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0)).view(np.uint32)
    return (bits >> np.uint32(16)).astype(np.uint16)


def from_half(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


#: By this much a float's square root may be off, more than it ever is.
ROUNDING = 1e-9


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Part:
    """The codebook of one part position in one pass, with the distances that prune."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None) -> None:
        self.entries = entries
        gaps = np.sqrt(squares(entries[:, None], entries[None]).astype(np.float64)) * (1 - ROUNDING)
        self.half = gaps / 2
        apart = self.half + np.where(np.eye(len(entries), dtype=bool), np.inf, 0)
        self.nearest = apart.min(1)
        self.moved = None if before is None else np.sqrt(squares(entries, before).astype(np.float64)) * (1 + ROUNDING)

    def assign(self, x: np.ndarray, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest entries of the parts x, upper bounds, lower bounds and how many distances were computed.

        own, upper and lower are those of the pass before, None in the first one.
        """
        n, k = len(x), len(self.entries)
        if own is None:
            found = squares(x[:, None], self.entries[None])
            own = found.argmin(1)
            root = np.sqrt(found.astype(np.float64))
            return own, root[np.arange(n), own] * (1 + ROUNDING), root * (1 - ROUNDING), n * k
        upper = (upper + self.moved[own]) * (1 + ROUNDING)
        lower = np.maximum(lower * (1 - ROUNDING) - self.moved, 0)
        open_ = np.flatnonzero(upper >= self.nearest[own])
        near = (lower[open_] <= upper[open_, None]) & (self.half[own[open_]] <= upper[open_, None])
        near[np.arange(len(open_)), own[open_]] = False
        some = near.any(1)
        open_, near = open_[some], near[some]
        # the own distance makes the upper bound tight; what it rules out needs no distance
        exact = squares(x[open_], self.entries[own[open_]])
        tight = np.sqrt(exact.astype(np.float64)) * (1 + ROUNDING)
        near &= (lower[open_] <= tight[:, None]) & (self.half[own[open_]] <= tight[:, None])
        upper[open_], lower[open_, own[open_]] = tight, tight * (1 - 3 * ROUNDING)
        r, j = np.nonzero(near)
        found = np.full(near.shape, np.iinfo(np.int64).max)
        found[np.arange(len(open_)), own[open_]] = exact
        found[r, j] = squares(x[open_[r]], self.entries[j])
        lower[open_[r], j] = np.sqrt(found[r, j].astype(np.float64)) * (1 - ROUNDING)
        best = found.argmin(1)  # the first of equal ones
        own = own.copy()
        own[open_] = best
        upper[open_] = np.sqrt(found[np.arange(len(open_)), best].astype(np.float64)) * (1 + ROUNDING)
        return own, upper, lower, len(open_) + len(r)


def _components(column: pa.Array, n: int, parts: int) -> np.ndarray:
    """Rows, parts, components. All rows must have one length."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and ((lengths != lengths[0]).any() or lengths[0] % parts):
        raise ValueError(f"vectors must be of one length, a multiple of {parts}")
    return column.flatten().to_numpy().astype(np.int64).reshape(n, parts, -1) if n else np.zeros((0, parts, 0), np.int64)


def _pass(books: np.ndarray, before: np.ndarray | None, last: bool):
    """One pass over the vectors with these codebooks (parts, entries, components)."""
    parts, entries, width = books.shape

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pruned = [Part(books[p], None if before is None else before[p]) for p in range(parts)]
        totals, many, computed = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _components(batch.column("x"), n, parts)
            if x.shape[2] != width:
                raise ValueError(f"vectors must be of one length, here {parts * width}")
            old = None if before is None else (np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64), from_half(np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.uint16)).reshape(n, parts, entries + 1))
            code, bounds, error = np.zeros((n, parts), np.uint8), np.zeros((n, parts, entries + 1), np.uint16), np.zeros(n, np.int64)
            for p, part in enumerate(pruned):
                own, upper, lower, m = part.assign(x[:, p], *((None, None, None) if old is None else (old[0][:, p], old[1][:, p, 0], old[1][:, p, 1:])))
                code[:, p], computed = own, computed + m
                if last:
                    error += squares(x[:, p], part.entries[own])
                    continue
                bounds[:, p, 0], bounds[:, p, 1:] = upper_half(upper), lower_half(lower)
                np.add.at(totals[p], own, x[:, p])
                many[p] += np.bincount(own, minlength=entries)
            rows = [batch.column("key"), batch.column("label")]
            if last:
                yield pa.RecordBatch.from_arrays([*rows, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["key", "label", "code", "error"])
                continue
            blobs = [pa.array([b.tobytes() for b in blob], pa.binary()) for blob in (code, bounds)]
            yield pa.RecordBatch.from_arrays([*rows, batch.column("x"), *blobs, pa.nulls(n, pa.list_(pa.int64()))], names=["key", "label", "x", "code", "bounds", "sums"])
        if not last and many.any():
            sums = pa.array([np.concatenate([totals.ravel(), many.ravel(), [computed]])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), sums], names=["key", "label", "x", "code", "bounds", "sums"])

    kinds: list[pa.DataType] = []

    def over(rows: DataFrame) -> DataFrame:
        kinds[:] = [to_arrow_type(rows.schema[c].dataType) for c in ("key", "label")]
        types = [rows.schema[c].dataType.simpleString() for c in ("key", "label")]
        rest = "code string, error long" if last else "x array<int>, code binary, bounds binary, sums array<long>"
        return rows.mapInArrow(run, f"key {types[0]}, label {types[1]}, {rest}")

    return over


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(key, label, code, error) of each kept row, the final codebooks (parts, entries, components) and the distances each round computed."""
    small_batches(rows.sparkSession)
    now = written(kept_vectors(rows, key, vector, label), "vectors")
    first = now.orderBy(F.col("key").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if len({len(r.x) for r in first}) > 1 or first and len(first[0].x) % parts:
        raise ValueError(f"vectors must be of one length, a multiple of {parts}")
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2) if first else np.zeros((parts, 0, 0), np.int64)
    if not first:
        return now.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books, []
    before, work = None, []
    for _ in range(rounds):
        then = written(_pass(books, before, False)(now), "assigned")
        removed(now)
        now = then.where("sums IS NULL")
        sums = then.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
        total = np.zeros(books.size + books.shape[0] * books.shape[1] + 1, np.int64)
        for r in sums.collect():
            total[r["at"]] = r["n"]
        many = total[books.size : -1].reshape(books.shape[:2])
        work.append(int(total[-1]))
        used = many > 0
        before, books = books, books.copy()
        books[used] = total[: books.size].reshape(books.shape)[used] // many[used][:, None]
    coded = written(_pass(books, before, True)(now), "codes")
    removed(now)
    return coded, books, work


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over the rows of one label. A label of any share of the rows is dealt out."""
    keys = [F.col("label").isNull().alias("__none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("__label")]
    rows = coded.select("*", *keys, F.spark_partition_id().alias("pid"))
    sums = rows.groupBy("__none", "__label").agg(F.sum("error").alias("label_error"))
    return spread_join(rows, sums, ["__none", "__label"]).drop("__none", "__label", "pid")


def vector_codes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per kept row: key, code (two hexadecimal digits a part), error, label_error, codebooks_sha256."""
    coded, books, _ = encode_vectors(rows, key, vector, label)
    found = with_label_error(coded)
    digest: Column = F.lit(codebooks_digest(books))
    return found.select(F.col("key").alias(key), "code", "error", "label_error", digest.alias("codebooks_sha256"))
