"""Searches against brute force: each query meets all rows of its group, over several blocks."""

import random

from pyspark.sql import functions as F

from paraloom.functions import similarity
from paraloom.operators import extraction, search


def test_nearest_sets_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    r = random.Random(1)
    made = [(r.choice(["a", "a", "b", None]), i, sorted(r.sample(range(30), r.randrange(0, 8)))) for i in range(120)]
    frame = spark.createDataFrame(made, "g string, id long, terms array<long>")
    found = {tuple(x) for x in search.nearest_sets(frame.where("id % 5 = 0"), frame.where("id % 5 <> 0"), "g", 4).collect()}
    expected = set()
    for g, i, own in made:
        near = [(-len({*own} & {*t}) / len({*own} | {*t}), j) for h, j, t in made if i % 5 == 0 and j % 5 and g is not None and g == h and {*own} & {*t}]
        expected |= {(i, j, -d) for d, j in sorted(near)[:4]}
    assert found == expected and len(expected) > 40


def test_link_search_is_link_similarity_of_all_pairs_asked_for(spark):
    r = random.Random(2)
    pages = spark.createDataFrame([(i, "h" if i % 3 else "k", "".join(f'<a href="{r.randrange(6)}">' for _ in range(r.randrange(5)))) for i in range(230)], "page long, host string, html string")
    side = lambda n: pages.select("host", F.col("page").alias(n))
    pairs = side("src").join(side("tgt"), "host").where("src % 100 = 0 AND src <> tgt").select("src", "tgt")
    expected = {tuple(x) for x in extraction.link_similarity(pairs, pages).collect()}
    assert {tuple(x) for x in extraction.link_search(pages).collect()} == expected and len(expected) > 200


def test_length_alignment_without_hopeless_cells():
    """A long pair takes time in proportion to its length; what it costs is what the full table gives."""
    a = [40 + i * 7 % 50 for i in range(1500)]
    assert similarity.gale_church(a, a) == -100.0
    assert similarity.gale_church(a, [*a[:700], 30, *a[700:]]) > -100.0
    assert similarity.gale_church([50, 60], [50]) == similarity.gale_church([50, 60], [50], 1e9) and similarity.gale_church([900] * 9, [1] * 9) == 100.0
