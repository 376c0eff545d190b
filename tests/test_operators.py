"""Operators, sources and the stream against plain Python."""

import gzip
import io
import itertools
import random
import tarfile

import numpy as np
from pyspark.sql import functions as F

from paraloom.operators import candidates, cleaning, langstats, locate, matching, terms
from paraloom.sources import archives, records
from paraloom.streaming import langstats as stream


def test_entropy_drops_single_languages(spark):
    spans = spark.createDataFrame([("http://a/1", "en", 500), ("http://a/2", "de", 500), ("http://b/1", "en", 700), ("http://a/3", "en", 50)], "uri string, language string, bytes long")
    rows = langstats.entropy(langstats.host_languages(spans)).collect()
    assert [(r["host"], round(r["entropy"], 6), r["total"]) for r in rows] == [("a", -0.693147, 1000)]


def test_cleaning_cascade_takes_the_first_reason(spark):
    lines = ["x", "a\tb\tc\td\te\tf", "same\tsame", "\tb", "a\t ", "u\tv\tsource\ttarget\t-1", "long long long long long long\tx", "x\tlong long long long long long", "u\tv\tgood\tgute\t0.5", "good\tgute", "good\tgute\t0.1"]
    rows = cleaning.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    found = {r["value"]: r["reason"] for r in rows.withColumn("reason", cleaning.deletion_reason(F.col("source"), F.col("target"), F.col("score"), columns=F.col("columns"))).collect()}
    assert [found[x] for x in lines] == ["line_short", "line_long", "identical", "source_empty", "target_empty", "low score", "source_too_long", "source_too_short", None, None, None]
    exact = spark.createDataFrame([("a" * 15, "b" * 5)], "s string, t string").select(cleaning.deletion_reason(F.col("s"), F.col("t")).alias("r"))
    assert exact.first()["r"] is None  # the ratio is 1.5, not above


def test_greedy_equals_the_sequential_scan(spark):
    r = random.Random(3)
    pairs = [(s, t, float(r.randrange(6))) for s in range(14) for t in range(9) if r.random() < 0.6]
    used_s, used_t, expected = set(), set(), set()
    for s, t, x in sorted(pairs, key=lambda p: (-p[2], -p[0], -p[1])):
        if s not in used_s and t not in used_t:
            expected.add((s, t))
            used_s.add(s)
            used_t.add(t)
    frame = spark.createDataFrame(pairs, "src int, tgt int, score double")
    assert {(r["src"], r["tgt"]) for r in matching.greedy(frame).collect()} == expected
    seeded = {(r["src"], r["tgt"]) for r in matching.greedy(frame, seeds=spark.createDataFrame([pairs[0][:2]], "src int, tgt int")).collect()}
    assert pairs[0][:2] in seeded


def test_assignment_is_the_best():
    r = np.random.default_rng(2)
    for n in (1, 2, 5, 6):
        cost = r.integers(0, 20, (n, n)).astype(float)
        to = matching.assignment(cost)
        assert sorted(to) == list(range(n))
        assert cost[np.arange(n), to].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_candidates_by_raw_then_stripped_url(spark):
    kv = lambda rows: spark.createDataFrame([("com", u, c, [(lang, 900), ("xx", 100)]) for u, c, lang in rows], "tld string, url string, crawl string, languages array<struct<lang:string,bytes:long>>")
    s = candidates.language_candidates(kv([("http://h.com/en/a", "1", "en"), ("http://h.com/x_en", "1", "en"), ("http://h.com/plain", "1", "en")]), "en")
    t = candidates.language_candidates(kv([("http://h.com/fr/a", "1", "fr"), ("http://h.com/fr/a", "2", "fr"), ("http://h.com/fr/", "1", "fr")]), "fr")
    assert s.count() == 2
    assert [tuple(r) for r in candidates.match_candidates(s, t).collect()] == [("http://h.com/a", "http://h.com/en/a", "1", "http://h.com/fr/a", "2")]
    kv_line = 'ex http://www.ex.com/id.html 2014_42\t{"languages": [["en", 1000], ["de", 5e2]]}'
    row = records.parse_kv(spark.createDataFrame([(kv_line,), ("broken",)], "value string")).collect()
    assert len(row) == 1 and [(x["lang"], x["bytes"]) for x in row[0]["languages"]] == [("en", 1000), ("de", 500)]


def test_exclusion_drops_repeats_and_known(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int")
    assert [r["x"] for r in candidates.excluded(a, spark.createDataFrame([(3,)], "x int")).collect()] == [1]


def test_update_keeps_stored_values(spark):
    row = "domain string, url string, crawl string, location map<string,string>"
    old = spark.createDataFrame([("d", "u", "c", {"a": "1", "b": "old"})], row)
    new = spark.createDataFrame([("d", "u", "c", {"b": "new", "z": "9"}), ("d", "v", "c", {"a": "1"})], row)
    assert locate.updated(old, new).first()["location"] == {"a": "1", "b": "old", "z": "9"}
    assert locate.not_inserted(old, new).count() == 1


def test_bag_similarity(spark):
    s = spark.createDataFrame([("g", 1, "cat"), ("g", 1, "dog"), ("g", 1, "cow")], "g string, src_id int, term string")
    t = spark.createDataFrame([("g", 7, "chat"), ("g", 7, "loup")], "g string, tgt_id int, term string")
    d = spark.createDataFrame([("cat", "chat"), ("kitty", "chat")], "w1 string, w2 string")
    row = terms.bag_similarity(s, t, d, "g").first()
    assert row["common"] == 1 and abs(row["score"] - 2 / 3) < 1e-9


def test_archives(spark, tmp_path):
    wet = "WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: http://a/1\r\n\r\nHello\nthere\r\n\r\nWARC/1.0\r\nWARC-Type: warcinfo\r\n\r\nx\r\n\r\nWARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: http://a/2\r\n\r\ncut off"
    (tmp_path / "x.wet").write_bytes(wet.encode())
    assert [tuple(r) for r in archives.read_wet(spark, str(tmp_path / "x.wet")).collect()] == [("http://a/1", "Hello\nthere")]
    wat = '{"Container":{"Offset":"5","Filename":"f","Gzip-Metadata":{"Deflate-Length":"9"}},"Envelope":{"WARC-Header-Metadata":{"WARC-Target-URI":"http://a"},"Payload-Metadata":{"HTTP-Response-Metadata":{"Headers":{"Content-Type":"text/html"},"HTML-Metadata":{"Links":[{"path":"A@/href","url":"/x.PDF","text":""},{"path":"IMG@/src","url":"y.pdf","text":""}]}}}}}\nnot json\n{"Container":{}}'
    (tmp_path / "x.wat").write_text(wat)
    pages = archives.read_wat(spark, str(tmp_path / "x.wat"))
    assert pages.count() == 1 and archives.wat_locations(pages, "c").first()["location"]["length"] == 9
    assert [r["url"] for r in archives.read_wat(spark, str(tmp_path / "x.wat"), pdf_only=True).collect()] == ["/x.PDF"]
    body = gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\nHTTP/1.1 200\r\n\r\n<html>\r\n\r\nx")
    (tmp_path / "f.gz").write_bytes(b"junk" + body)
    located = spark.createDataFrame([("u", ("f.gz", 4, len(body), "text/html")), ("v", ("none", 0, 1, "text/html"))], "url string, location struct<filename:string,offset:long,length:long,mime:string>")
    got = {r["url"]: r for r in archives.record_bodies(archives.fetched(located, archives.range_reader(str(tmp_path))).withColumn("record", F.col("record").cast("string"))).collect()}
    assert got["u"]["body"] == "<html>\r\n\r\nx" and got["v"]["record"] == ""
    magic = f"{archives.MAGIC} uri:http://0d1.info/ language:en offset:451 bytes:2.743e3\nline one\nline two\n{archives.MAGIC} uri:http://b/ language:de offset:0 bytes:7\nz\n"
    (tmp_path / "spans").write_text(magic)
    assert [tuple(r) for r in archives.read_magic(spark, str(tmp_path / "spans")).collect()][0] == ("http://0d1.info/", "en", 451, 2743, "line one\nline two\n")
    percent = f"{archives.MAGIC} uri:http://1-r.tumblr.com/post/4 encoding:utf-8 tld:com domain:tumblr bytes:2636\nENGLISH 92 719\nPORTUGUESE 7 254\n"
    (tmp_path / "percent").write_text(percent)
    rows = langstats.percent_languages(archives.read_percent_stream(spark, str(tmp_path / "percent"))).collect()
    assert [tuple(r) for r in rows] == [("tumblr.com", "ENGLISH", 2425)]


def test_site_archive_to_documents(spark, tmp_path):
    with tarfile.open(tmp_path / "site.tgz", "w:gz") as tar:
        for name, data in (("a.html", b"<!-- Mirrored from x.com/en by HTTrack --><p>Hi</p><a href='/l'>m</a>"), ("b.bin", b"\0")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    files = archives.read_tar(spark, str(tmp_path / "site.tgz"))
    docs = records.site_documents(files, F.lit("en"))
    assert [(r["url"], r["text"]) for r in docs.collect()] == [("x.com/en", "Hi\nm")]
    assert records.site_links(files).first()["links"] == ["/l"]
    again = records.parse_lett(records.lett_lines(docs, "en", "fr"))
    assert again.first()["text"] == "Hi\nm"


def test_dictionaries_and_groups(spark):
    lines = spark.createDataFrame([("fr en",), ("chat cat",), ("chien dog",)], "value string")
    assert {tuple(r) for r in records.parse_dictionary(lines, "en", "fr", "fr en").collect()} == {("cat", "chat"), ("dog", "chien")}
    groups = records.parse_groups(spark.createDataFrame([("a\tb\t<->\tx\ty",)], "value string"))
    assert groups.count() == 4
    giza = cleaning.harmonic_dictionary(*(spark.createDataFrame(r, s) for r, s in (([(1, 2, 0.5), (1, 3, 0.1)], "s int, t int, p double"), ([(1, 2, 0.5), (1, 3, 0.9)], "s int, t int, p double"), ([(1, "cat")], "id int, word string"), ([(2, "chat"), (3, "x")], "id int, word string"))))
    assert [(r["w1"], r["w2"]) for r in giza.collect()] == [("cat", "chat")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("http://a/1", "en", 0, 500), ("http://a/2", "de", 0, 300), ("http://b/1", "en", 0, 50)]
    spark.createDataFrame(rows, stream.SPANS).repartition(3).write.parquet(str(tmp_path / "in"))
    run = lambda: stream.run(stream.span_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("http://a/3", "en", 0, 200)], stream.SPANS).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    batch = langstats.host_languages(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect())) == [("a", "de", 300), ("a", "en", 700)]
