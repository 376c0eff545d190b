"""Language shares against plain expectation-maximisation, on planted mixtures and on held-out texts."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paraloom.llm import mixture, queries

SCHEMA = "doc_id long, text string, lang string, key string, slot int, n long, score string"
SYLLABLES = {"aa": ["ka", "ro", "mi", "tel", "on"], "bb": ["sch", "ung", "ei", "tz", "ver"], "cc": ["ção", "lh", "que", "é", "nho"], "dd": ["шен", "ов", "да", "ми", "кра"]}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) + r.choice(["", "", ",", "."]) for _ in range(n))


def odd():
    rows = [(i, prose(lang := "aabbccdd"[i % 4 * 2 :][:2], 20 + i % 60, i).title(), lang) for i in range(200)]
    rows += [(300 + i, prose(a, 60, i) + "\n" + prose(b, 60, i), a) for i, (a, b) in enumerate(itertools.permutations(SYLLABLES, 2))]
    rows += [(400, None, "aa"), (401, "", "aa"), (402, "12 -- !?", "bb"), (403, "É", None), (404, "x", "cc"), (None, prose("bb", 30, 1), "bb"), (405, "ein_wort2zwei", None), (406, "\n".join([prose("dd", 9, 9)] * 3), "dd")]
    return rows + rows[3:6]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "k", 1, 2, "s") for r in rows], SCHEMA).repartition(parts)


def slots(text):
    def mixed(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % (1 << 64)
        return x ^ (x >> 32)

    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = [f" {w} "[i : i + 3] for w in words for i in range(len(w))]
    return Counter(mixed(ord(g[0]) | ord(g[1]) << 21 | ord(g[2]) << 42) >> 48 for g in grams)


def plain_model(rows):
    counts = {}
    for key, text, lang in rows:
        if zlib.crc32(("" if key is None else str(key)).encode()) % 5 and lang is not None and text is not None and slots(text):
            counts.setdefault(lang, Counter()).update(slots(text))
    every = sum(counts.values(), Counter())
    even, shared = mixture.EVEN / mixture.SLOTS, mixture.SHARED / every.total()
    return {lang: lambda s, c=counts[lang], n=counts[lang].total(): (1 - mixture.SHARED - mixture.EVEN) * c[s] / n + shared * every[s] + even for lang in sorted(counts)}


def shares(grams, model, langs):
    share = dict.fromkeys(langs, 1 / len(langs))
    whole = lambda s: sum(share[x] * model[x](s) for x in langs)
    for _ in range(mixture.ROUNDS):
        sums = {s: whole(s) for s in grams}
        share = {x: share[x] * sum(n * model[x](s) / sums[s] for s, n in grams.items()) / grams.total() for x in langs}
    return share, sum(n * math.log(whole(s)) for s, n in grams.items())


def plain(text, model):
    grams = slots(text or "")
    if not grams:
        return "und", 0.0, {}
    everywhere = shares(grams, model, list(model))[0]
    single = {x: shares(grams, model, [x])[1] for x in model}
    langs = [max(model, key=single.get)]
    chosen, likelihood = {langs[0]: 1.0}, single[langs[0]]
    while len(langs) < len(model):
        more = [*langs, max((x for x in model if x not in langs), key=everywhere.get)]
        share, found = shares(grams, model, more)
        if found - likelihood <= mixture.PENALTY * math.log(grams.total() + 1):
            break
        langs, chosen, likelihood = more, share, found
    best = max(sorted(chosen), key=chosen.get)
    return best, everywhere[best], chosen


def test_equals_plain_steps(spark):
    rows = odd()
    docs, model = frame(spark, rows), plain_model(rows)
    found = mixture.identify_languages(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "languages"] and found.count() == len(rows)
    of = {r[0]: r[1] for r in rows}
    for r in found.collect():
        lang, score, chosen = plain(of[r.doc_id], model)
        assert (r.lang_pred, r.held_out) == (lang, zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.score == pytest.approx(score, abs=1e-4)
        got = dict(x.split(":") for x in r.languages.split(",")) if r.languages else {}
        assert {k: float(v) for k, v in got.items()} == pytest.approx({k: v for k, v in chosen.items() if k in got}, abs=2e-3)
        assert all(v < 1e-3 for k, v in chosen.items() if k not in got)


def test_planted_mixtures(spark):
    rows = [(i, prose(lang := "aabbccdd"[i % 4 * 2 :][:2], 80, i), lang) for i in range(240)]
    mixed = [(1000 + i, prose(a, 3 * n, i) + " " + prose(b, n, i), None) for i, ((a, b), n) in enumerate(itertools.product(itertools.permutations(SYLLABLES, 2), (20, 60)))]
    found = {r.doc_id: r for r in mixture.identify_languages(frame(spark, rows + mixed)).collect()}
    for i, ((a, b), _) in enumerate(itertools.product(itertools.permutations(SYLLABLES, 2), (20, 60))):
        got = [x.split(":") for x in found[1000 + i].languages.split(",")]
        assert [x for x, _ in got] == [a, b]
        letters = [len(re.sub(r"\W", "", t)) for t in (prose(a, 3 * (20, 60)[i % 2], i), prose(b, (20, 60)[i % 2], i))]
        assert float(got[0][1]) == pytest.approx(letters[0] / sum(letters), abs=0.06)
    assert all("," not in found[i].languages and found[i].lang_pred == lang for i, _, lang in rows)


def test_pieces_and_long_texts(spark, monkeypatch):
    """Cut between words, a text has the same trigrams; a long one is judged as its words are."""
    text = prose("aa", 4000, 1) + "\n\n" + prose("cc", 4000, 2)
    assert "".join(mixture.pieces(text, 100)) == text and max(map(len, mixture.pieces(text, 100))) < 130
    parts = Counter()
    for piece in mixture.pieces(text, 100):
        parts.update(mixture.trigram_slots([piece])[0].tolist())
    assert parts == slots(text)
    assert list(map(len, mixture.pieces("x" * 450, 100))) == [200, 200, 50]
    rows = [(i, prose(lang, 50, i), lang) for i, lang in enumerate(["aa", "bb", "cc", "dd"] * 10)] + [(99, text * 40, None)]
    long = mixture.identify_languages(frame(spark, rows)).where("doc_id = 99").first()
    assert [x.split(":")[0] for x in long.languages.split(",")] == ["aa", "cc"] or [x.split(":")[0] for x in long.languages.split(",")] == ["cc", "aa"]


def test_nothing_to_learn_and_empty(spark):
    rows = [(i, prose("aa", 5, i), None) for i in range(4)]
    assert {tuple(r)[2:] for r in mixture.identify_languages(frame(spark, rows)).collect()} == {("und", 0.0, "")}
    assert mixture.identify_languages(frame(spark, odd()).where("doc_id < -1")).count() == 0
    with pytest.raises(ValueError, match="languages"):
        mixture.fit(frame(spark, [(i, "ab cd", f"l{i}") for i in range(400)]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    found = queries.op12_languages(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
