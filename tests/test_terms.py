"""Counts made in a document's own row against plain counts, and weights without the frequent terms' rows."""

import math
from collections import Counter

from pyspark.sql import functions as F

from paraloom.functions import ngrams
from paraloom.operators import scorer, terms

TEXTS = ["b a b c", "", None, "a a a d", "eé a eé", "z"]


def shuffled(df):
    """How many exchanges of rows by a hash df's plan has."""
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")


def test_counts_of_a_row(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    expected = sorted((i, w, n) for i, t in enumerate(TEXTS) for w, n in Counter((t or "").split()).items())
    found = terms.exploded(docs, words, ["id"])
    assert sorted((r["id"], r["term"], r["count"]) for r in found.collect()) == expected and shuffled(found) == 0
    whole = {r["id"]: (r["most"], r["total"]) for r in found.collect()}
    assert whole == {0: (2, 4), 3: (3, 4), 4: (2, 3), 5: (1, 1)}
    twice = docs.union(docs.where("id = 0"))  # an id of two rows
    assert {(r["term"], r["count"]) for r in terms.exploded(twice, words, ["id"]).where("id = 0").collect()} == {("a", 2), ("b", 4), ("c", 2)}
    for variant in (20, 29):
        sums = lambda x: {tuple(r) for r in terms.tfidf(x, ["id"], variant, 1, 2).select("id", "term", F.round("weight", 9)).collect()}
        assert sums(found) == sums(found.drop("most", "total"))
    assert ngrams.counted(F.lit(None).cast("array<string>")) is not None


def test_index_counts_equal_the_lists(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (3, "b a"), (None, "a")], "id long, text string")
    for given in (docs, docs.dropDuplicates(["id"])):
        plain = terms.inverted_index(given, F.split("text", " "), "id").select("term", F.size("docs"), F.get("docs", 0))
        assert {tuple(r) for r in plain.where("size(docs) > 0").collect()} == {tuple(r) for r in terms.index_counts(given, F.split("text", " "), "id").collect()}


def test_scores_of_repeated_ids_add_up(spark):
    pairs = spark.createDataFrame([(0, 1)], "src_id long, tgt_id long")
    docs = spark.createDataFrame([(0, "a b a"), (1, "a c")], "doc_id long, text string")
    halves = spark.createDataFrame([(0, "a b"), (0, "a"), (1, "a c")], "doc_id long, text string")
    asked = [("words", r) for r in scorer.RATIOS]
    one, two = (scorer.Registry().scored(pairs, d, asked).first() for d in (docs, halves))
    assert tuple(one) == tuple(two)


def test_weights_of_wanted_documents_equal_those_of_all_terms(spark):
    texts = ["a b b c", "b c\n", " c  d d", "", None, "a e f f f", "c b a"]
    rows = [(i, "en" if i % 3 else "fr", t) for i, t in enumerate(texts)]
    tokens, keys = F.split("text", r"\s+"), ["doc_id", "lang"]
    for more in ([], [(1, "en", "c a x")]):  # the second: two rows of one document
        docs = spark.createDataFrame(rows + more, "doc_id long, lang string, text string").repartition(3)
        for variant, least, most in ((7, 2, 4), (7, 1, 3), (10, 1, 1000), (20, 2, 1000)):
            counted = docs.select(*keys, F.explode(F.filter(tokens, lambda t: t != "")).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("count"))
            plain = terms.tfidf(counted, keys, variant, least, most).where("lang = 'en'")
            found = terms.tfidf_of(docs, tokens, keys, "lang = 'en'", variant, least, most)
            both = [sorted((*r[:3], round(r[3], 9)) for r in x.collect()) for x in (plain, found)]
            assert both[0] == both[1] and both[0]


def test_terms_of_all_documents_count_without_a_cap(spark, tmp_path, monkeypatch):
    from paraloom.plans import queries

    rows = [(i, f"all rare{i // 2} once{i}", "en", "s") for i in range(1002)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 3)  # fewer than there are
    found = queries.QUERIES["tfidf_augmented_smooth"](spark, str(tmp_path)).collect()
    expected = round(math.log(1 + 1002 / 1002) + math.log(1 + 1002 / 2), 4)
    assert len(found) == 1002 and {(r["n_terms"], r["total"]) for r in found} == {(2, expected)}
