"""The registry of extractors and ratios: all combinations equal the single ones and plain formulas, new names join in."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paraloom.functions import similarity
from paraloom.operators import scorer


def docs():
    r = random.Random(1)
    rows = [(i, "\n".join(" ".join(r.choices(["a", "b", "cc", "d,", "é", "f."], k=r.randrange(9))) for _ in range(r.randrange(5)))) for i in range(40)]
    return [*rows, (100, None), (101, ""), (102, rows[3][1])]


def ratios(a, b):
    lo, size = (a & b).total(), (a.total(), b.total())
    dot, squares = sum(n * b[t] for t, n in a.items()), [sum(n * n for n in x.values()) for x in (a, b)]
    over = lambda x, y, empty=0.0: x / y if y else empty
    return {
        "jaccard": over(len(a.keys() & b.keys()), len(a.keys() | b.keys())), "dice": over(2 * len(a.keys() & b.keys()), len(a) + len(b), 1.0), "weighted_jaccard": over(lo, (a | b).total()),
        "legacy_cosine": over(dot, sum(squares)), "cosine": over(dot, math.sqrt(squares[0]) * math.sqrt(squares[1])), "quick": over(2 * lo, sum(size), 1.0), "size": over(min(size), max(size)),
    }


def test_all_combinations(spark):
    rows = docs()
    ids = [i for i, _ in rows]
    r = random.Random(2)
    pairs = {(r.choice(ids), r.choice(ids)) for _ in range(120)} | {(100, 101), (3, 102), (5, 5), (1, 777)}
    registry = scorer.Registry()
    registry.extractors["letters"] = lambda: F.filter(F.split("text", ""), lambda c: c.rlike("[a-z]"))
    registry.ratios["less"] = lambda s: F.least(s.kinds_a, s.kinds_b)
    frame = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    asked = scorer.all_of(registry)
    assert len(asked) == 5 * 8
    found = registry.scored(spark.createDataFrame([*pairs, (5, 5)], "src_id int, tgt_id int"), frame, asked + asked[:2]).cache()
    assert found.columns[2:] == [f"{e}_{x}" for e, x in asked] and found.count() == len(pairs)
    words = {i: (t or "").split() for i, t in rows} | {777: []}
    bigrams = {i: [" ".join(w[k : k + 2]) for k in range(max(1, len(w) - 1)) if w] for i, w in words.items()}
    for row in found.collect():
        for by, tokens in (("words", words), ("bigrams", bigrams)):
            for name, x in ratios(Counter(tokens[row.src_id]), Counter(tokens[row.tgt_id])).items():
                assert row[f"{by}_{name}"] == pytest.approx(x), (row.src_id, row.tgt_id, by, name)
        assert row.words_less == min(len(set(words[row.src_id])), len(set(words[row.tgt_id])))
    single = registry.scored(found, frame, [("wordpunct", "dice")])
    assert {(x.src_id, x.tgt_id, x.wordpunct_dice) for x in single.collect()} == {(x.src_id, x.tgt_id, x.wordpunct_dice) for x in found.collect()}
    side = lambda n: frame.select(F.col("doc_id").alias(f"{n}_id"), F.coalesce(registry.extractors["wordpunct"](), F.array().cast("array<string>")).alias(n))
    plain = single.join(side("src"), "src_id").join(side("tgt"), "tgt_id").where(F.abs(similarity.dice(F.col("src"), F.col("tgt")) - F.col("wordpunct_dice")) > 1e-12)
    assert plain.count() == 0
    assert scorer.combined(found, {"words_dice": 2.0, "lines_size": -1.0}).where(F.abs(F.col("score") - 2 * F.col("words_dice") + F.col("lines_size")) > 1e-12).count() == 0
    with pytest.raises(KeyError, match="nothing"):
        registry.scored(found, frame, [("words", "nothing")])


def test_pairs_are_scored_without_a_table_of_tokens(spark, monkeypatch):
    texts = ["a b a\n \nc d", None, "", "b a c c\nc d", "dé dé   x"]
    docs = spark.createDataFrame([(i, t, "more") for i, t in enumerate(texts)], "doc_id long, text string, src_id string").repartition(3)
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(6)], "src_id long, tgt_id long")  # 5 has no document
    asked, made, plain = scorer.all_of(scorer.Registry()), [], scorer.cut
    monkeypatch.setattr(scorer, "cut", lambda df: made.append(df.columns) or plain(df))
    found = scorer.Registry().scored(pairs, docs, asked)
    assert made == [["src_id", "tgt_id"]]  # and no counts
    monkeypatch.setattr(scorer, "one_row_each", lambda *_: False)  # as for documents of several rows
    expected = scorer.Registry().scored(pairs, docs.drop("src_id"), asked)
    rows = [sorted(tuple(round(v, 12) for v in r) for r in x.collect()) for x in (found, expected)]
    assert rows[0] == rows[1] and len(rows[0]) == 36
