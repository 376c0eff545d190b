"""Registered queries over small tables made here: they take all of their input."""

import difflib

import pytest
from pyspark.sql import functions as F

from paraloom.functions import ngrams
from paraloom.operators import locate, matching
from paraloom.plans import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def made(spark, tmp_path):
    def write(texts):
        rows = [(i, t, lang, "s", len(t)) for i, (lang, t) in enumerate(texts)]
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


def test_sequence_candidates_use_words_of_many_documents(spark, made):
    given = [("fr" if i % 100 else "en", f"common shared word{i // 2}") for i in range(340)]
    words = {i: set(t.split()) for i, (_, t) in enumerate(given)}
    jaccard = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b])
    best = {(a, b) for a in range(0, 340, 100) for b in sorted((i for i in range(340) if i % 100), key=lambda b: (-jaccard(a, b), b))[:10]}
    assert {tuple(r) for r in queries._top_texts(spark, made(given)).select("src_id", "tgt_id").collect()} == best


def test_sequence_ratios_compare_whole_texts(spark, made):
    a, b = [f"w{i}" for i in range(900)], [f"w{i}" for i in range(450)] + [f"v{i}" for i in range(300)]
    (found,) = queries.sequence_ratios(spark, made([("en", " ".join(a)), ("fr", " ".join(b))])).collect()
    m = difflib.SequenceMatcher(None, a, b)
    assert tuple(found)[2:] == pytest.approx((m.ratio(), m.quick_ratio(), m.real_quick_ratio()))


def test_hashed_lines_hash_every_line(spark, made):
    found = queries.hashed_lines(spark, made([("en", "one two\nthree\n\nfour five"), ("fr", "")])).collect()
    assert sorted((r["doc_id"], r["line"]) for r in found) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]
    grams = ["<s>", "four", "five", "</s>", "<s>#four", "four#five", "five#</s>"]
    expected = spark.range(1).select(ngrams.double_hash_features(F.array(*map(F.lit, grams)), 3, 1024)).first()[0]
    assert next(r["bits"] for r in found if r["line"] == 3) == expected


def test_domain_query_has_more_than_ten_thousand_rows(spark):
    index = spark.range(10_100).select(F.lit("example.net").alias("domain"), F.concat(F.lit("http://a.example.net/"), "id").alias("url"), F.lit("c").alias("crawl"))
    assert locate.query_domain(index, "example.net", max_results=None).count() == 10_100 and locate.query_domain(index, "example.net").count() == 10_000


def test_first_target_of_equal_numbers_is_the_smallest(spark):
    target = spark.createDataFrame([(u, "s", 5) for u in range(50, 0, -1)], "url long, stripped string, idx long").repartition(7)
    (found,) = matching.ground_truth(spark.createDataFrame([(99, "s")], "url long, stripped string"), target).collect()
    assert tuple(found) == (99, 1)


def test_repeated_ngrams_inside_a_text_and_over_rows_of_one_id(spark, tmp_path):
    assert sorted(spark.sql("SELECT array('b', 'a', 'b', 'c', 'b', 'a') AS t").select(ngrams.repeated(F.col("t"))).first()[0]) == ["a", "a", "b", "b", "b"]
    for ids, name in (((1, 2), "alone"), ((1, 1), "shared")):
        path = tmp_path / name
        spark.createDataFrame([(ids[0], "a b c d a b c d"), (ids[1], "b c d a")], "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
        found = {tuple(r) for r in queries.ngrams4(spark, str(path)).collect()}
        assert found == ({(1, "a b c d", 2)} if name == "alone" else {(1, "a b c d", 2), (1, "b c d a", 2)})
