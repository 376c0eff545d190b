"""One-to-one pairs of the largest total score on sparse pairs: components first, then an exact search in each, an auction in huge ones.

Pairs (src, tgt, score > 0) are a graph that falls into components; no pair of one bears on another. A component of at
most SMALL_PAIRS pairs is one task's: augmenting paths of least cost with potentials, on its own pairs only. In the others all
sources (or targets, if these are fewer) that are free bid, each for the target that is worth most to it at its price, by what it
is worth more than the next best (or than none); a target goes to the highest bid, who had it is free again. Bids are made in
blocks of at most about BLOCK_PAIRS pairs, one task each, and blocks meet by rounds. Prices start at 0 and only rise, so the result is within `step` a pair of the largest total, and the largest itself if scores are
whole numbers and step times the sources is below 1.

Pairs with null ends or without a positive score are never chosen; of repeated pairs the best counts; ties are
broken by source and target, so the result is the same in every run.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

SMALL_PAIRS = 200_000
#: Pairs of a block of bidders, the share of one task.
BLOCK_PAIRS = 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (id, component): the smallest id that each reaches, by alternating large and small stars."""
    now, seen = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    nodes = cut(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(small.where("a <> b").distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return nodes.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))
        seen = state


def best_pairs(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The pairs (source, target, score > 0) of the largest total, each source and target at most once.

    worth and price are the dual numbers: worth[s] + price[t] is never below a pair's score and equal for chosen ones,
    and 0 for who has none. Sources come in one by one; the search from a new one ends at a free target or at
    a source (itself perhaps) that may as well stay alone, whatever is nearer. Scores are counted in whole numbers of the
    smallest binary fraction among them: sums of floats are rounded, and a way around that seems to gain by it never ends.
    """
    known: dict[int, dict[int, float]] = {}
    for s, t, score in sorted(pairs):
        known.setdefault(s, {})[t] = score
    exact = {s: {t: float(score).as_integer_ratio() for t, score in ts.items()} for s, ts in known.items()}
    unit = max((d for ts in exact.values() for _, d in ts.values()), default=1)
    of = {s: {t: n * (unit // d) for t, (n, d) in ts.items()} for s, ts in exact.items()}
    worth = {s: max(ts.values()) for s, ts in of.items()}
    price: dict[int, int] = {}
    target_of: dict[int, int] = {}
    source_of: dict[int, int] = {}
    for root in of:
        near, reached, asked, heap, end = {root: 0}, {}, {}, [(0, root)], (worth[root], root, None)
        while heap:
            d, s = heapq.heappop(heap)
            if d >= end[0]:
                break
            if d > near[s]:
                continue
            if d + worth[s] < end[0]:
                end = (d + worth[s], s, None)
            for t, score in of[s].items():
                loss = d + worth[s] - score + price.get(t, 0)
                if loss >= min(end[0], reached.get(t, end[0])) or target_of.get(s) == t:
                    continue
                reached[t], asked[t] = loss, s
                if t not in source_of:
                    end = (loss, s, t)
                elif loss < near.get(source_of[t], end[0]):
                    near[source_of[t]] = loss
                    heapq.heappush(heap, (loss, source_of[t]))
        most, s, t = end
        for x, d in near.items():
            worth[x] -= max(0, most - d)
        for x, d in reached.items():
            price[x] = price.get(x, 0) + max(0, most - d)
        while True:  # s gets t, or stays alone; who asked for what s had gets that, up to the new one
            had = target_of.pop(s, None)
            if t is not None:
                target_of[s], source_of[t] = t, s
            if s == root:
                break
            t, s = had, asked[had]
    return sorted((s, t, known[s][t]) for s, t in target_of.items())


def bids(src: np.ndarray, tgt: np.ndarray, score: np.ndarray, price: np.ndarray, holder: np.ndarray, free: np.ndarray, step: float) -> list[tuple[int, int]]:
    """An auction among one block's sources, one bid after another; price (changed in place) and holder are by target, -1 for one that isn't here.

    Pairs are numbers in ascending order of src; free are the sources that start without a target. Returns (target, pair) of each target that changed hands.
    """
    starts = np.searchsorted(src, np.arange(int(src[-1]) + 2))
    of, changed, waiting = holder.tolist(), {}, deque(free.tolist())
    while waiting:
        s = waiting.popleft()
        low, high = starts[s], starts[s + 1]
        net = score[low:high] - price[tgt[low:high]]
        k = int(net.argmax())
        if net[k] <= 0:
            continue
        first, net[k] = net[k], 0.0
        t = int(tgt[low + k])
        price[t] += first - max(0.0, net.max()) + step
        if of[t] >= 0:
            waiting.append(of[t])
        of[t], changed[t] = s, low + k
    return list(changed.items())


def _bids_of_block(step: float, columns: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "tgt"], ignore_index=True)
        src, names = pd.factorize(rows["src"])
        tgt, _ = pd.factorize(rows["tgt"])
        one = np.unique(tgt, return_index=True)[1]
        price, holder = rows["price"].to_numpy()[one], pd.Index(names).get_indexer(rows["holder"].iloc[one])
        holder[rows["holder"].iloc[one].isna()] = -1
        found = bids(src, tgt, rows["score"].to_numpy(), price, holder, np.unique(src[rows["free"].to_numpy(bool)]), step)
        out = rows.iloc[[pair for _, pair in found]].copy()
        out["price"] = price[[t for t, _ in found]]
        return out[columns]

    return run


def _blocks(levels: list, block_pairs: int) -> dict[int, tuple[int, int]]:
    """(first block, how many) of each level of (level, pairs), the highest first; levels that fit share a block."""
    out, block, room = {}, -1, 0
    for level, n in sorted(levels, reverse=True):
        many = -(-n // block_pairs)
        if n > room:
            block, room = block + 1, many * block_pairs
        out[level] = (block, many)
        block, room = block + many - 1, room - n if many == 1 else 0
    return out


def auction(pairs: DataFrame, step: float, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One-to-one pairs (src, tgt, score) within `step` a pair of the largest total.

    The side of fewer members bids. Each round deals its players to blocks of about block_pairs pairs; a block is one task, which goes
    on bidding until none of its own is free; then each target is the highest bidder's, who lost it is free. Who was free in many
    rounds meets the others of that kind in one block, so that those who fight for the same targets don't do it by rounds.
    """
    kinds, session = dict(pairs.dtypes), pairs.sparkSession
    n_src, n_tgt = pairs.agg(F.count_distinct("src"), F.count_distinct("tgt")).first()
    if n_src > n_tgt:
        turned = auction(cut(pairs.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "score")), step, block_pairs)
        return turned.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "score")
    bidders = cut(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("times")))
    held = session.createDataFrame([], f"tgt {kinds['tgt']}, src {kinds['src']}, price double, score double")
    price, nth = F.coalesce("price", F.lit(0.0)).alias("price"), 0
    while True:
        left = bidders.join(held.select("src"), "src", "left_anti")
        asked = pairs.join(left.select("src"), "src", "left_semi").join(held.select("tgt", "price"), "tgt", "left").where(F.col("score") > F.coalesce("price", F.lit(0.0)))
        now = bidders.join(asked.select("src", F.lit(True).alias("free")).distinct(), "src", "left").withColumn("free", F.coalesce("free", F.lit(False)))
        if nth:
            now = now.withColumn("times", F.col("times") + F.col("free").cast("int"))
        bidders = cut(now.withColumn("level", F.floor(F.log2(F.col("times") + 1))))
        players = bidders.where("free OR times > 0")
        levels = players.groupBy("level").agg(F.sum("n").alias("n"), F.max("free").alias("free")).collect()  # a level for each power of 2 of the rounds
        if not any(r["free"] for r in levels):
            return held.select("src", "tgt", "score")
        dealt = session.createDataFrame([(k, *v) for k, v in _blocks([(r["level"], r["n"]) for r in levels], block_pairs).items()], "level long, first int, many int")
        seats = players.join(F.broadcast(dealt), "level").select("src", "free", (F.col("first") + F.pmod(F.xxhash64("src", F.lit(nth)), F.col("many"))).alias("block"))
        seats = seats.join(F.broadcast(seats.where("free").select("block").distinct()), "block", "left_semi")
        rows = pairs.join(seats, "src").join(held.select("tgt", "price", F.col("src").alias("holder")), "tgt", "left").select("block", "src", "tgt", "score", price, "holder", "free").where("score > price")
        made = rows.groupBy("block").applyInPandas(_bids_of_block(step, ["tgt", "src", "price", "score"]), held.schema)
        won = cut(made.groupBy("tgt").agg(F.max_by(F.struct("src", "price", "score"), F.struct("price", "src")).alias("w")).select("tgt", "w.*"))
        held, bidders, nth = cut(held.join(won.select("tgt"), "tgt", "left_anti").unionByName(won)), bidders.drop("free", "level"), nth + 1


def best_assignment(pairs: DataFrame, step: float = 1e-3, small_pairs: int = SMALL_PAIRS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One-to-one pairs (src, tgt, score) of the largest total score; in components of over small_pairs pairs within step a pair of it."""
    kinds = dict(pairs.dtypes)
    known = cut(pairs.where("src IS NOT NULL AND tgt IS NOT NULL AND score > 0 AND NOT isnan(score)").groupBy("src", "tgt").agg(F.max(F.col("score").cast("double")).alias("score")))
    edges = known.select("src", "tgt", "score", F.xxhash64(F.lit("src"), "src").alias("a"), F.xxhash64(F.lit("tgt"), "tgt").alias("b"))
    placed = cut(edges.join(components(edges.select("a", "b")).withColumnRenamed("id", "a"), "a").select("src", "tgt", "score", "component"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = placed.join(sizes, "component")
    shape = f"src {kinds['src']}, tgt {kinds['tgt']}, score double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = sorted(["src", "tgt"], key=lambda c: pdf[c].nunique())  # those of the smaller side search, so fewer are left alone
        return pd.DataFrame(best_pairs(list(zip(*(pdf[c] for c in sides), pdf["score"], strict=True))), columns=[*sides, "score"])[["src", "tgt", "score"]]

    small = placed.where(F.col("n") <= small_pairs).groupBy("component").applyInPandas(solve, shape)
    large = cut(placed.where(F.col("n") > small_pairs).select("src", "tgt", "score"))
    return small.unionByName(auction(large, step, block_pairs)) if large.head(1) else small
