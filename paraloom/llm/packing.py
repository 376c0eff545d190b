"""Packing token pieces into sequences by minimum bin slack over a histogram of lengths.

Whole windows of a document are sequences of their own; what is left of each is
packed. Only the counts of the lengths reach the driver (at most `capacity`
numbers, whatever the corpus): for each sequence the largest length left is the
seed, a bitset subset-sum program finds the multiset of lengths left that fills
the rest closest to capacity, and the pattern is used as often as the counts allow.
Pieces then find their pattern by their rank among the pieces of their length.

Defined cases: null or empty text is one piece, the end id alone; repeated rows
are packed as rows of their own; an empty table gives an empty result; columns of
docs other than key and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoded
from .common import gapless_rank, written

CAPACITY = 2048
END_ID = 1


@dataclass(frozen=True)
class Pattern:
    """times sequences that each hold count pieces of every (length, count)."""

    parts: tuple[tuple[int, int], ...]
    times: int


def closest_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts of each, whose sum is closest to room from below.

    Bit s of the bitset says that sum s can be had. Lengths enter from large to
    small, each in lots of doubling size; the bitsets before each lot are kept for
    the way back.
    """
    reach, fits, history = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:
            lot = min(lot, left)
            history.append((reach, length, lot))
            reach |= (reach << (length * lot)) & fits
            left -= lot
            lot *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, lot in reversed(history):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + lot
            at -= length * lot
    return chosen


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that together use each length as often as the histogram says."""
    counts, patterns = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = closest_filling(counts, capacity - seed)
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        patterns.append(Pattern(tuple(sorted(chosen.items(), reverse=True)), times))
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return patterns


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A document's ids and end_id, cut at multiples of capacity: key, start, length, doc_tokens, ids (binary)."""
    end = F.lit(end_id.to_bytes(4, "little"))
    rows = docs.select(F.col(key), F.concat(encoded(docs.sparkSession, path, F.col("text")), end).alias("all"))
    total = (F.octet_length("all") / 4).cast("long")
    cut = rows.select(key, "all", total.alias("doc_tokens"), F.explode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(capacity).cast("long"))).alias("start"))
    length = F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start"))
    return cut.select(key, "start", length.alias("length"), "doc_tokens", F.substring("all", (4 * F.col("start") + 1).cast("int"), F.lit(4 * capacity)).alias("ids"))


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a column length of 1 to capacity) with sequence_id, offset, sequence_tokens and padded_tokens."""
    spark = pieces.sparkSession
    pieces = written(pieces.withColumn("__part", F.spark_partition_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().toLocalIterator()}
    places: dict[int, list[tuple]] = {}
    first, used = 0, dict.fromkeys(histogram, 0)
    for pattern in plan_patterns(histogram, capacity):
        offset, total = 0, sum(k * n for k, n in pattern.parts)
        for length, n in pattern.parts:
            places.setdefault(length, []).append((used[length], n, first, offset, total))
            used[length] += n * pattern.times
            offset += length * n
        first += pattern.times
    plan = spark.createDataFrame(list(places.items()), "length long, __places array<struct<rank long, each long, sequence long, at long, total long>>")
    ranked = gapless_rank(pieces, "length", "__part", order, "__nth").join(F.broadcast(plan), "length")  # at most `capacity` rows
    place = F.element_at("__places", F.size(F.filter("__places", lambda p: p["rank"] <= F.col("__nth"))))
    ranked = ranked.withColumn("__place", place).withColumn("__nth", F.col("__nth") - F.col("__place.rank"))
    total = F.col("__place.total")
    return ranked.select(
        *[c for c in pieces.columns if c != "__part"],
        (F.col("__place.sequence") + F.floor(F.col("__nth") / F.col("__place.each"))).cast("long").alias("sequence_id"),
        (F.col("__place.at") + F.col("__nth") % F.col("__place.each") * F.col("length")).cast("long").alias("offset"),
        total.alias("sequence_tokens"),
        F.when(F.bit_count(total) == 1, total).otherwise(F.lit(capacity)).cast("long").alias("padded_tokens"),
    )
