"""Column functions on the documented examples and edge cases."""

import difflib
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paraloom.functions import ngrams, similarity
from paraloom.functions import text as T
from paraloom.functions import url as U


def values(spark, given, make, schema="x string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i int, {schema}")
    return [r["y"] for r in frame.select("i", make(F.col(schema.split()[0])).alias("y")).orderBy("i").collect()]


def test_parts_and_hosts(spark):
    urls = ["http://me:pw@radio1.bbc.co.uk:8080/a/b;p?q=1#f", "https://ex.com", "nohost/path", "//h/x", "", "http://a.b.example.org/?"]
    assert values(spark, urls, U.host) == ["radio1.bbc.co.uk", "ex.com", "", "h", "", "a.b.example.org"]
    assert values(spark, urls[:2], lambda u: U.registered(U.host(u))) == ["bbc.co.uk", "ex.com"]
    assert values(spark, urls[:2], lambda u: U.subdomain(U.host(u))) == ["radio1", ""]
    assert values(spark, urls[:2], lambda u: U.domain_label(U.host(u))) == ["bbc", "ex"]
    assert values(spark, ["nohost"], U.domain_key) == ["__UNKNOWN__"]


@pytest.mark.parametrize(
    ("url", "stripped"),
    [
        ("http://mypage.net/index.html?lang=fr", "http://mypage.net/index.html"),
        ("http://lesite.fr/en/bonsoir", "http://lesite.fr/bonsoir"),
        ("http://page.net/fr", "http://page.net"),
        ("http://h.com/enter/x_en.htm", "http://h.com/enter/x.htm"),
        ("http://h.com/de-at/x/", "http://h.com/x/"),
        ("https://u@h.com:81/en/a?page=2&l=en#top", "http://u@h.com:81/a?page=2"),
        ("http://h.com/a_en_b", "http://h.com/a_b"),
        ("http://h.com/plain/x", "http://h.com/plain/x"),
        ("no host", ""),
    ],
)
def test_strip_uri(spark, url, stripped):
    assert values(spark, [url], lambda u: U.strip_uri(u)["url"]) == [stripped]


def test_strip_uri_checks_the_language_and_removes_index(spark):
    assert values(spark, ["http://h.com/fr/x"], lambda u: U.strip_uri(u, "it")) == [("", False)]
    assert values(spark, ["http://h.com/fr/index.php"], lambda u: U.strip_uri(u, "fr", remove_index=True)) == [("http://h.com/", True)]
    assert values(spark, ["/x/DE_CH/y", "/a/b"], U.language_of) == ["de", ""]


def test_normalize_rules_and_mirrors(spark):
    assert values(spark, ["x.com??", "https://x.com", "http://x"], U.normalize) == ["http://x.com", "https://x.com", "http://x"]
    assert values(spark, ["https://x.com"], lambda u: U.normalize(u, legacy=True)) == ["http://https://x.com"]
    assert values(spark, ["http://h/mi0064_en.htm", "http://h/x=en", "http://h/en/x.htm"], lambda u: U.file_rule(u, "en")) == [True, True, False]
    assert values(spark, ["http://h/en/d/x.htm", "http://h/en/x.htm", "http://h/center/x"], lambda u: U.path_rule(u, "en")) == [True, False, False]
    assert values(spark, ["mi0064_it.htm", "a?l=it"], lambda u: U.renamed_file(u, "it", "en")) == ["mi0064_en.htm", "a?l=en"]
    html = "<!-- Mirrored from www.a.com/en by HTTrack -->x<!-- Mirrored from b by HTTrack -->"
    assert values(spark, [html, "x"], U.mirrored_from) == ["www.a.com/en", ""] and values(spark, [html], lambda h: U.mirrored_from(h, last=True)) == ["b"]
    assert values(spark, ["b/c"], lambda x: U.joined(F.lit("http://h/a/"), x)) == ["http://h/a/b/c"]


def test_text_functions(spark):
    assert values(spark, ["a  b\r\n\r\n c\t"], T.clean_whitespace) == ["a b\nc"]
    assert values(spark, ["a​b c\nd"], T.clean_characters) == ["a b c\nd"]
    assert values(spark, ["é"], T.composed) == ["é"]
    assert values(spark, ["Hi, you!"], T.wordpunct_tokens) == [["Hi", ",", "you", "!"]] and values(spark, ["Hi, (you)!"], T.bag_words) == [["hi", "you"]]
    assert values(spark, ["A b. C d!\nE"], T.sentences) == [["A b.", "C d!", "E"]]
    assert values(spark, ["Ã©tÃ©", "plain", "日本"], T.repaired_latin) == ["été", "plain", "日本"]
    assert values(spark, [bytearray(b"\xe9t"), bytearray("é".encode())], lambda b: T.decoded()(b, F.lit("latin-1")), "b binary") == ["ét", "é"]


HTML = '<html><head><style>p{}</style><script>var t="</p>";</script></head><body><p>One<b> two</b><p>Three<br>four<ul><li>A &amp; B<li><span>c</span>d</ul><table><tr><td>x<td>y</table><!-- no --><a href="/u">l</a></body>'


def test_html_to_text_in_both_forms(spark):
    expected = "One two\nThree\nfour\nA & B\nc d\nx y\nl"
    assert values(spark, [HTML], T.parsed_html_to_text()) == [expected]
    assert values(spark, [HTML], T.html_to_text) == [expected]
    assert values(spark, ["a<br>b"], T.parsed_html_to_text(ignore_br=True)) == ["a b"]
    assert values(spark, [HTML], T.links) == [["/u"]] and values(spark, ["<img src='i.png'>"], lambda h: T.links(h, "img", "src")) == [["i.png"]]
    assert values(spark, ["<p>one two three</p>"], T.tag_sequence()) == [["<p>", "0", "1", "</p>"]]


def test_ngrams(spark):
    split = lambda x: F.split(x, " ")
    assert values(spark, ["a b c", "a"], lambda x: ngrams.strict_ngrams(split(x), 2)) == [["a b", "b c"], []]
    assert values(spark, ["a b c", "a"], lambda x: ngrams.padded_ngrams(split(x), 2)) == [["a b", "b c"], ["a"]]
    assert values(spark, ["ab c"], lambda x: ngrams.character_ngrams(x, 2)) == [["ab", "bc"]]
    assert values(spark, ["a b"], lambda x: ngrams.orders_ngrams(split(x), 2)) == [["<s>", "a", "b", "</s>", "<s>#a", "a#b", "b#</s>"]]
    same, other = values(spark, ["one two three four", "five six seven eight"], lambda x: ngrams.simhash(split(x)))
    assert same != other and values(spark, [5], lambda x: ngrams.hamming(x, F.lit(6).cast("long")), "x long") == [2]
    bits = values(spark, ["a b"], lambda x: ngrams.sha1_features(50, ["s"])(split(x)))[0]
    assert bits == sorted({int(__import__("hashlib").sha1(b"s" + w).hexdigest(), 16) % 50 for w in (b"a", b"b")})


def test_similarities_equal_plain_python(spark):
    r = random.Random(1)
    pairs = [([r.choice("abcd") for _ in range(r.randrange(6))], [r.choice("abcd") for _ in range(r.randrange(6))]) for _ in range(60)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    ca, cb = similarity.counted(a), similarity.counted(b)
    rows = frame.select("i", similarity.jaccard(a, b).alias("j"), similarity.dice(a, b).alias("d"), similarity.weighted_jaccard(ca, cb).alias("w"), similarity.legacy_cosine(ca, cb).alias("c"), similarity.quick_ratio(a, b).alias("q"), similarity.sequence_ratio(a, b).alias("s"), similarity.levenshtein_ratios(a, b).alias("l")).collect()
    from collections import Counter

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, s in enumerate(x):
            new = [i + 1]
            for j, t in enumerate(y):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (s != t)))
            row = new
        return row[-1]

    for row in rows:
        x, y = pairs[row["i"]]
        sx, sy, cx, cy = set(x), set(y), Counter(x), Counter(y)
        assert row["j"] == pytest.approx(len(sx & sy) / len(sx | sy) if sx & sy else 0)
        assert row["d"] == pytest.approx(2 * len(sx & sy) / (len(sx) + len(sy)) if sx or sy else 1)
        assert row["w"] == pytest.approx(sum((cx & cy).values()) / sum((cx | cy).values()) if sx & sy else 0)
        dot = sum(cx[k] * cy[k] for k in sx & sy)
        assert row["c"] == pytest.approx(dot / (sum(v * v for v in cx.values()) + sum(v * v for v in cy.values())) if dot else 0)
        m = difflib.SequenceMatcher(None, x, y)
        assert row["s"] == pytest.approx(m.ratio()) and row["q"] == pytest.approx(m.quick_ratio())
        assert row["l"]["low"] == pytest.approx(1 - distance(x, y) / max(1, min(len(x), len(y))))


def test_gale_church_bounds():
    assert similarity.gale_church([10, 20], [10, 20]) == -100.0
    assert similarity.gale_church([10], [500] * 40) == 100.0
    assert -100 < similarity.gale_church([30, 31], [60]) < 0


def test_gale_church_is_the_cheapest_of_all_alignments():
    steps = {(1, 1): 0.89, (1, 0): 0.0099, (0, 1): 0.0099, (2, 1): 0.089, (1, 2): 0.089, (2, 2): 0.011}

    def cheapest(s, t):
        if not s and not t:
            return 0.0
        found = []
        for (a, b), prior in steps.items():
            if a <= len(s) and b <= len(t):
                x, y = sum(s[:a]), sum(t[:b])
                tail = 1.0 if x == y == 0 else max(math.erfc(abs(x - y) / math.sqrt(6.8 * (x + y) / 2) / math.sqrt(2)), 1e-300)
                found.append(cheapest(s[a:], t[b:]) - math.log(prior / 0.89) - math.log(tail))
        return min(found, default=math.inf)

    r = random.Random(7)
    for _ in range(120):
        s, t = ([r.randrange(0, 60) for _ in range(r.randrange(5))] for _ in range(2))
        cost = cheapest(s, t)
        assert similarity.gale_church(s, t) == pytest.approx(100.0 if cost >= 100 else -100.0 if cost == 0 else -cost)


def test_simhash_equals_plain_counting(spark):
    import xxhash

    texts = ["a b c d e f", "a b c", "", "x", "one two three four five six seven eight"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    for row in frame.select("id", ngrams.simhash(tokens).alias("h")).collect():
        hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in texts[row["id"]].split()]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert row["h"] % (1 << 64) == bits


def test_sha1_buckets_hash_a_word_once(monkeypatch):
    import hashlib

    asked, plain = [], hashlib.sha1
    monkeypatch.setattr(hashlib, "sha1", lambda x: asked.append(x) or plain(x))
    found = ngrams.sha1_buckets(pd.Series([["once"] * 5, ["once", "more"]]), ["salt", "x"], 997)
    of = lambda w: {int(plain((s + w).encode()).hexdigest(), 16) % 997 for s in ("salt", "x")}
    assert list(found) == [sorted(of("once")), sorted(of("once") | of("more"))] and len(asked) == 4


def test_hashed_bits_of_long_and_missing_lines(spark):
    import time

    words = F.transform(F.sequence(F.lit(1), F.col("id")), lambda i: F.concat(F.lit("w"), i))
    began = time.time()
    rows = spark.createDataFrame([(100_000,), (3,)], "id int").select("id", ngrams.double_hash_features(words, 3, 1 << 16).alias("bits")).collect()
    assert time.time() - began < 30  # the pairs of hashes were compared with one another
    assert sorted(r["bits"] == sorted(set(r["bits"])) for r in rows) == [True, True] and min(len(r["bits"]) for r in rows) <= 9
    lists = [["a", "b", "a"], None, [], ["b"] * 3]
    made = spark.createDataFrame(list(enumerate(lists)), "id int, w array<string>").coalesce(1)
    found = {r[0]: r[1:] for r in made.select("id", ngrams.double_hash_features(F.col("w"), 2, 7), ngrams.sha1_features(5, ["s", ""])("w")).collect()}
    of = lambda ws: sorted({int(__import__("hashlib").sha1((s + w).encode()).hexdigest(), 16) % 5 for s in ("s", "") for w in ws})
    assert [found[i][1] for i in range(4)] == [of("ab"), None, [], of("b")] and found[1][0] is None and found[2][0] == []
    for width, expected in ((1, ["a", "", "b"]), (2, ["a-", "-b"]), (4, ["a--b"])):
        assert spark.range(1).select(ngrams.padded_ngrams(F.array(F.lit("a"), F.lit(""), F.lit("b")), width, "-")).first()[0] == expected
