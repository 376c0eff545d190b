"""Languages inside texts: the path of lines against all paths, spans of planted mixtures, percent, acceptance."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paraloom.operators import languages

SYLLABLES = {"aa": ["ka", "ro", "mi", "tel", "on"], "bb": ["sch", "ung", "ei", "tz", "ver"], "cc": ["ção", "lh", "que", "é", "nho"], "dd": ["шен", "ов", "да", "ми", "кра"]}


def line(lang, r):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(r.randint(3, 14))).capitalize() + "."


def test_best_path_is_the_best_of_all():
    r = np.random.default_rng(1)
    for n, k in itertools.product((1, 2, 5, 7), (1, 2, 3)):
        for _ in range(20):
            evidence = r.integers(0, 6, (n, k)).astype(float)
            worth = lambda p, e=evidence: sum(e[i, x] for i, x in enumerate(p)) - 2 * sum(a != b for a, b in itertools.pairwise(p))
            assert worth(languages.best_path(evidence, 2)) == max(map(worth, itertools.product(range(k), repeat=n)))
    assert len(languages.best_path(np.zeros((0, 3)))) == 0


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(2)
    rows = [(lang, "\n".join(line(lang, r) for _ in range(10))) for lang in SYLLABLES for _ in range(30)] + [(None, "nothing"), ("aa", None)]
    return languages.fit(spark.createDataFrame(rows, "lang string, text string").repartition(3))


KIND = "id int, pos int, text string, kept string, evidence int"


def test_planted_spans_are_found(spark, model):
    r = random.Random(3)
    truth = {}
    for i in range(80):
        parts = [(lang, r.randint(2, 6)) for lang in r.sample(sorted(SYLLABLES), r.randint(1, 3))]
        truth[i] = [lang for lang, n in parts for _ in range(n)]
    rows = [(i, 0, "\n\n".join(line(lang, r) for lang in langs), "k", 1) for i, langs in truth.items()]
    found = languages.language_spans(spark.createDataFrame(rows, KIND).repartition(3), model, ["id"])
    got = {i: [None] * len(langs) for i, langs in truth.items()}
    text = {i: t.replace("\n\n", "\n") for i, _, t, _, _ in rows}
    for s in languages.span_rows(found, ["id"]).collect():
        got[s.id][s.line : s.line + s.lines] = [s.language] * s.lines
        assert text[s.id].encode()[s.offset : s.offset + s.bytes].decode().rstrip("\n") == s.text
    right = sum(a == b for i in truth for a, b in zip(got[i], truth[i], strict=True))
    assert right / sum(map(len, truth.values())) > 0.99
    for t in languages.text_languages(found, ["id"]).collect():
        assert {x.language for x in t.languages} == set(truth[t.id]) and 98 <= sum(x.percent for x in t.languages) <= 100 and t.reliable
        assert [x.percent for x in t.languages] == sorted((x.percent for x in t.languages), reverse=True)


def test_defined_cases(spark, model):
    r = random.Random(4)
    aa, bb = line("aa", r), line("bb", r)
    texts = [None, "", " \n\n", "12 34\n--", f"{aa}\n12345\n{aa}", f"\n{aa}\n \n{aa}\n", f"{bb}\nka\n{bb}", aa * 3000, "\n".join([aa] * 3 + [bb] * 3 + [line("cc", r)] * 2 + [line("dd", r)])]
    rows = [(i, 0, t, "k", 1) for i, t in enumerate(texts)] + [(5, 0, texts[5], "k", 1), (None, 0, aa, "k", 1)]
    found = languages.language_spans(spark.createDataFrame(rows, KIND).repartition(2), model, ["id"])
    spans = {}
    for s in languages.span_rows(found, ["id"]).collect():
        spans.setdefault(s.id, []).append((s.line, s.lines, s.language))
    n = {i: len((t or "").encode()) for i, t in enumerate(texts)}
    assert {i: sorted(v) for i, v in spans.items()} == {
        4: [(0, 1, "aa"), (2, 1, "aa")], 5: [(0, 2, "aa")] * 2, 6: [(0, 3, "bb")], 7: [(0, 1, "aa")], 8: [(0, 3, "aa"), (3, 3, "bb"), (6, 2, "cc"), (8, 1, "dd")], None: [(0, 1, "aa")],
    }
    assert n[7] > 100_000
    told = languages.text_languages(found, ["id"])
    of = {t.id: t for t in told.collect()}
    assert told.count() == len(rows) and of[0].languages == of[3].languages == [] and not of[0].reliable and len(of[8].languages) == 3
    accepted = {t.id for t in told.where(languages.accepts(F.col("languages"), F.col("reliable"), "bb")).collect()}
    assert accepted == {0, 1, 2, 3, 6, 8}
    assert languages.language_spans(spark.createDataFrame([], KIND), model, ["id"]).count() == 0
