"""Sparse assignment against a dense solver, the auction against its bound, posting blocks against plain postings."""

import random

import numpy as np
from pyspark.sql import functions as F

from paraloom.operators import assignment, postings
from paraloom.operators.matching import assignment as dense


def graph(seed, sources, targets, share, whole=True):
    r = random.Random(seed)
    return [(s, t, float(r.randint(1, 30)) if whole else r.random() + 1e-3) for s in range(sources) for t in range(targets) if r.random() < share]


def largest(pairs):
    n = 1 + max([max(s, t) for s, t, _ in pairs], default=0)
    score = np.zeros((n, n))
    for s, t, x in pairs:
        score[s, t] = max(x, score[s, t])
    return sum(score[i, j] for i, j in enumerate(dense(-score)))


def one_to_one(found):
    return len({s for s, _, _ in found}) == len(found) == len({t for _, t, _ in found})


def test_paths_equal_the_dense_solver():
    for seed in range(150):
        r = random.Random(seed)
        pairs = graph(seed, r.randint(1, 14), r.randint(1, 14), r.choice([0.1, 0.4, 1]), seed % 2)
        found = assignment.best_pairs(pairs)
        assert one_to_one(found) and set(found) <= set(pairs)
        assert abs(sum(x for _, _, x in found) - largest(pairs)) < 1e-9


def test_paths_end_for_scores_that_floats_round():
    for seed in range(60):
        r = random.Random(seed)
        values = [round(r.random() * 10, 3) for _ in range(4)]
        pairs = [(s, t, r.choice(values)) for s in range(12) for t in range(6) if r.random() < 0.5]
        found = assignment.best_pairs(pairs)
        assert one_to_one(found) and set(found) <= set(pairs)
        assert abs(sum(x for _, _, x in found) - largest(pairs)) < 1e-9


def test_auction_in_blocks(spark):
    pairs = [(s, f"t{t:02d}", x) for s, t, x in graph(1, 20, 8, 0.6)]  # more sources than targets; blocks fight for the same ones
    frame = spark.createDataFrame(pairs, "src long, tgt string, score double").repartition(3)
    found = [tuple(r) for r in assignment.auction(frame, 1 / 16, block_pairs=50).collect()]  # whole numbers, step times the smaller side below 1
    assert one_to_one(found) and set(found) <= set(pairs)
    assert sum(x for _, _, x in found) == largest([(s, int(t[1:]), x) for s, t, x in pairs])
    assert assignment._blocks([(0, 25), (1, 95), (2, 10), (3, 20)], 40) == {3: (0, 1), 2: (0, 1), 1: (1, 3), 0: (4, 1)}


def test_components_and_auction(spark):
    pairs = graph(1, 12, 9, 0.2) + [(s + 50, t + 50, x) for s, t, x in graph(2, 9, 12, 0.4)] + [(s + 90, t + 90, x) for s, t, x in graph(3, 6, 6, 1)]
    rows = [*pairs, pairs[0], (pairs[1][0], pairs[1][1], 0.5), (7, 7, -1.0), (None, 3, 9.0), (3, None, 9.0), (8, 8, None), (9, 9, float("nan"))]
    frame = spark.createDataFrame(rows, "src long, tgt long, score double").repartition(3)
    best = largest(pairs)
    exact = [tuple(r) for r in assignment.best_assignment(frame).collect()]
    assert one_to_one(exact) and sum(x for _, _, x in exact) == best
    some = [tuple(r) for r in assignment.best_assignment(frame, step=1 / 64, small_pairs=30).collect()]  # whole numbers, step times the sources below 1
    assert one_to_one(some) and sum(x for _, _, x in some) == best
    assert assignment.best_assignment(frame.where("src < -1")).count() == 0
    edges = [(1, 2), (2, 3), (7, 9), (4, 4), (9, 8), (20, 3)]
    found = {r.id: r.component for r in assignment.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7, 4: 4}


def test_numbers_of_seven_bits():
    r = np.random.default_rng(1)
    for values in (np.zeros(0), np.array([0, 1, 127, 128, 16383, 16384, (1 << 63) - 1, (1 << 64) - 1], np.uint64), r.integers(0, 1 << 40, 3000).astype(np.uint64) >> r.integers(0, 40, 3000).astype(np.uint64)):
        assert (postings.decoded(postings.coded(values)) == values.astype(np.uint64)).all()
    assert postings.coded(np.array([300], np.uint64)) == b"\xac\x02"


def test_blocks_hold_all_postings(spark):
    r = random.Random(4)
    rows = [(i * 7 - 900, ["every", *(f"w{r.randrange(60)}" for _ in range(r.randrange(8)))]) for i in range(700)]
    rows += [(-(1 << 63), ["far", "every"]), ((1 << 63) - 1, ["far"]), (None, ["far"]), (5, [None, "far", "far"]), (6, None), (7, [])]
    docs = spark.createDataFrame(rows, "id long, words array<string>").repartition(5)
    plain = {(w, i) for i, ws in rows for w in ws or [] if w is not None and i is not None}
    blocks = postings.posting_blocks(docs, F.col("words"), "id", block_ids=32).cache()
    stored = blocks.collect()
    assert max(b.n for b in stored) == 32 and max(len(b.deltas) for b in stored) <= 320
    assert sum(b.n for b in stored) == len(plain) and len([b for b in stored if b.term == "every"]) >= 20
    assert {tuple(x) for x in postings.postings(blocks).collect()} == plain
    assert {tuple(x) for x in postings.postings(blocks, -10, 300).collect()} == {(w, i) for w, i in plain if -10 <= i <= 300}
    for terms in (["every", "w3"], ["w1", "w2", "w1"], ["far"], ["far", "w5"], ["every", "absent"]):
        assert {x.id for x in postings.with_all(blocks, terms).collect()} == {i for _, i in plain if all((t, i) in plain for t in terms)}
