"""Sentences of one language, texts made anew from HTML, links, evaluation in file names, lines by fields."""

import random

from pyspark.sql import functions as F

from paraloom.functions import text as T
from paraloom.operators import evaluation, extraction, languages
from paraloom.sources import ordered

SYLLABLES = {"aa": ["ka", "ro", "mi", "tel", "on"], "bb": ["sch", "ung", "ei", "tz", "ver"]}


def prose(lang, r):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=3)) for _ in range(9)) + "."


def fitted(spark):
    r = random.Random(1)
    return languages.fit(spark.createDataFrame([(lang, prose(lang, r)) for lang in SYLLABLES for _ in range(80)], "lang string, text string"))


def test_sentences_and_pairs_of_a_language(spark):
    r, model = random.Random(2), fitted(spark)
    a, b, c = prose("aa", r), prose("bb", r), prose("aa", r)
    docs = [("u1", f"{a} {c}\n{b}\n \n{c}"), ("u2", b), ("u3", None), ("u4", " \n"), ("u1", a)]
    rows = [(u, t, None if t is None else "<p>" + t.replace("\n", "<p>"), 7) for u, t in docs]
    frame = spark.createDataFrame(rows, "uri string, text string, html string, pos int").repartition(2)
    expected = sorted([("u1", 0, a), ("u1", 1, c), ("u1", 2, c), ("u1", 0, a)])
    for from_html in (False, True):
        found = extraction.foreign_sentences(frame, model, "aa", ["uri"], from_html)
        assert sorted(tuple(x) for x in found.collect()) == expected
    upper = extraction.foreign_sentences(frame, model, "bb", ["uri"], normalize=F.upper, tokenize=extraction.spaced_tokens)
    assert {tuple(x) for x in upper.collect()} == {(u, 0, b.upper().replace(".", " .")) for u in ("u1", "u2")}
    pairs = spark.createDataFrame([("s", f"<p>{a}<p>{b}", f"<p>{b}<p>{c}", "old"), ("t", "<script>x</script>", f"<p>{b}", "old"), ("v", None, f"<p>{b}", "old")], "src_url string, src_html string, tgt_html string, src_text string")
    assert [(x.src_text, x.tgt_text) for x in extraction.reextracted(pairs).collect()] == [(f"{a}\n{b}", f"{b}\n{c}")]
    (kept,) = extraction.reextracted(pairs, T.html_to_text, model, "aa", "bb").collect()
    assert (kept.src_url, kept.src_text, kept.tgt_text) == ("s", a, b)


def test_words_links_and_evaluation(spark):
    docs = spark.createDataFrame([(0, "fr", "Un, deux un!"), (1, "en", "One"), (2, "fr", ""), (3, "fr", None)], "row long, lang string, text string")
    assert [tuple(x) for x in extraction.lett_words(docs, "fr").collect()] == [(0, "fr", ["un", "deux", "un"])]
    assert [tuple(x) for x in extraction.lett_words(docs, as_set=True).orderBy("row").collect()] == [(0, "fr", ["deux", "un"]), (1, "en", ["one"])]
    pages = spark.createDataFrame([(1, "<a href='/x'></a><a href='/y'><img src='i'>"), (2, "<a href='/y'></a><A HREF=\"/z\">"), (3, "")], "page int, html string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 3)], "src int, tgt int")
    assert {tuple(x)[:3] for x in extraction.link_similarity(pairs, pages).collect()} == {(1, 2, 1 / 3), (1, 3, 0.0), (3, 3, 0.0)}
    assert {tuple(x)[:3] for x in extraction.link_similarity(pairs, pages, "img", "src").collect()} == {(1, 2, 0.0), (1, 3, 0.0), (3, 3, 0.0)}
    found = spark.createDataFrame([("f1", "b", 1), ("a", "c", 2), ("d", "b", 3), ("e", "g", 4)], "src string, tgt string, order int")
    truth = spark.createDataFrame([("a", "b", 1), ("e", "g", 2), ("e", "h", 3), ("d", "i", 4)], "src string, tgt string, order int")
    names = spark.createDataFrame([("f1", "a")], "file string, url string")
    assert tuple(extraction.evaluated(found, truth, names).first()) == (2, 1, 3)
    assert tuple(extraction.evaluated(found, truth).first()) == (1, 2, 3)


def test_outcomes_of_true_pairs(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "src string, tgt string")
    truth, kept = pairs([("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("a", "b")]), pairs([("a", "b"), ("c", "x"), ("y", "f")])
    found = evaluation.outcomes(truth, kept, pairs([("a", "b"), ("c", "d"), ("c", "x"), ("y", "f")]))
    assert {tuple(x) for x in found.collect()} == {("a", "b", "win", "b", "a", True), ("c", "d", "mismatch", "x", None, True), ("e", "f", "mismatch", None, "y", False), ("g", "h", "missing", None, None, False)}


def test_lines_by_fields(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "part-00000.txt").write_text("a x\nb y\na x\n")
    (folder / "part-00001.txt").write_text("c\nb z\nc d\n\n")
    found = extraction.first_of_field(ordered.read_lines(spark, f"file://{folder}"))
    assert sorted(x.value for x in found.collect()) == ["", "a x", "b y", "c"]
    lines = spark.createDataFrame([("k\tv\tw",), ("short",), (None,), ("k\t",)], "value string")
    assert sorted(x.value for x in extraction.column_of(lines, 1).collect()) == ["", "v"]
