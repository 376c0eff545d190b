"""Topic vectors: planted topics are found again, and documents of one topic are near each other."""

import random

import pytest
from pyspark.sql import functions as F

from paraloom.operators import topics

SUBJECTS = [["sea", "ship", "wave", "port", "sail"], ["bread", "oven", "flour", "salt", "yeast"], ["code", "bug", "test", "loop", "byte"]]


def test_planted_topics(spark):
    r = random.Random(1)
    rows = [(i, i % 3, " ".join(r.choices(SUBJECTS[i % 3], k=25) + r.choices(["the", "of"], k=3))) for i in range(240)]
    rows += [(900, -1, None), (901, -1, ""), (902, -1, "unseen words only")]
    docs = spark.createDataFrame(rows, "id int, subject int, text string").repartition(3)
    words = F.filter(F.split("text", " "), lambda w: w != "")
    model = topics.fit_topics(docs, words, topics=3, rounds=40)
    top = [set(t) for t in model.words(5)]
    assert len(top) == 3 and all(any(len(set(s) & t) >= 4 for t in top) for s in SUBJECTS)
    vectors = model.vectors(docs, words, "id").cache()
    assert {v.id for v in vectors.collect()} == set(range(240)) and all(sum(v.vector) == pytest.approx(1) for v in vectors.collect())
    pairs = spark.createDataFrame([(a, b) for a in range(30) for b in range(30, 60)] + [(1, 900)], "src_id int, tgt_id int")
    found = {(x.src_id, x.tgt_id): x.score for x in topics.vector_cosines(pairs, vectors, "id").collect()}
    assert len(found) == 901 and found[1, 900] == 0
    same = [s for (a, b), s in found.items() if b < 900 and a % 3 == b % 3]
    other = [s for (a, b), s in found.items() if b < 900 and a % 3 != b % 3]
    assert min(same) > 0.9 and max(other) < 0.6
