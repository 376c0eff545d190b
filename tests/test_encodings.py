"""Bytes as text by the hint of a language: encodings that differ only in what they make of the same bytes."""

import random

from paraloom.operators import encodings, languages

SYLLABLES = {"ru": ["шен", "ов", "да", "ми", "кра", "ть"], "fr": ["é", "ça", "tion", "où", "pê", "les"], "cs": ["ře", "ží", "ký", "ští", "ně", "du"]}


def prose(lang, r, n=40):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=3)) for _ in range(n)) + ".\n" + "".join(r.choices(SYLLABLES[lang], k=3))


def test_the_decoding_that_reads_best(spark):
    r = random.Random(1)
    model = languages.fit(spark.createDataFrame([(lang, prose(lang, r)) for lang in SYLLABLES for _ in range(40)], "lang string, text string"))
    made = [(lang, prose(lang, r), e) for lang, names in (("ru", ["utf-8", "windows-1251", "koi8-r", "iso-8859-5", "utf-16"]), ("fr", ["utf-8", "windows-1252", "utf-16"]), ("cs", ["utf-8", "windows-1250", "iso-8859-2"])) for e in names for _ in range(6)]
    rows = [(i, t.encode(e), lang, "x") for i, (lang, t, e) in enumerate(made)]
    frame = spark.createDataFrame(rows, "id int, data binary, lang string, text string").repartition(3)
    found = {x.id: x for x in encodings.to_unicode(frame, model, ["id"], hint="lang").collect()}
    assert all(found[i].text == t and found[i].language == lang for i, (lang, t, _) in enumerate(made))
    assert all(found[i].encoding == e for i, (_, _, e) in enumerate(made) if e in ("utf-8", "koi8-r", "iso-8859-5"))
    alone = {x.id: x for x in encodings.to_unicode(frame, model, ["id"]).collect()}
    assert all(alone[i].text == t and alone[i].language == lang for i, (lang, t, _) in enumerate(made))


def test_defined_cases(spark):
    r = random.Random(2)
    model = languages.fit(spark.createDataFrame([("fr", prose("fr", r))], "lang string, text string"))
    rows = [(0, None, "fr"), (1, b"", "fr"), (2, b"abc", "xx"), (3, b"12", None), (4, "日本語".encode("shift_jis"), "ja"), (5, b"a\xff\xfe\xfd\x81", "zh"), (1, b"", "fr"), (None, b"a b", "en")]
    found = encodings.to_unicode(spark.createDataFrame(rows, "id int, data binary, lang string"), model, ["id"], hint="lang").collect()
    got = {x.id: (x.text, x.encoding, x.language) for x in found}
    assert len(found) == len(rows) and got == {0: (None, None, "fr"), 1: ("", "utf-8", "fr"), 2: ("abc", "utf-8", "xx"), 3: ("12", "utf-8", None), 4: ("日本語", "shift_jis", "ja"), 5: ("a", "utf-8", "zh"), None: ("a b", "utf-8", "en")}
    assert encodings.to_unicode(spark.createDataFrame([], "id int, data binary, lang string"), model, ["id"]).count() == 0


def test_utf8_with_a_foreign_word_stays_utf8(spark):
    r = random.Random(3)
    plain = lambda: " ".join("".join(r.choices(["the", "in", "er", "on"], k=3)) for _ in range(30))
    model = languages.fit(spark.createDataFrame([("en", plain()) for _ in range(20)], "lang string, text string"))
    rows = [(i, f"{plain()} {w}heitein {plain()}") for i, w in enumerate(("ö", "ü", "eröon", "ßthe"))]
    found = encodings.to_unicode(spark.createDataFrame([(i, t.encode(), "en") for i, t in rows], "id int, data binary, lang string"), model, ["id"], hint="lang").collect()
    assert {(x.id, x.text, x.encoding) for x in found} == {(i, t, "utf-8") for i, t in rows}
