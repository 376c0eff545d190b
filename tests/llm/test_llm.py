"""The training-data operators against brute force, on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import os
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paraloom.llm import bpe, chat, exact, licenses, media, minhash, packing, quality, sharding, suffix
from paraloom.llm.jvm_kernel import call

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pid int, id string, length string, rank long"


def words(seed, n, k=400):
    r = random.Random(seed)
    return " ".join(r.choice(["ba", "thé", "Ing", "of", "xy,"]) + str(r.randrange(k)) for _ in range(n))


def texts():
    long = words(1, 4000)
    near = words(2, 300)
    shared = words(3, 40)
    return [
        None, "", "   \n", "one two", "One  TWO", "a" * 3000, "ab" * 700, long, long, near, near.replace(" of", " off", 2), near + " tail",
        words(4, 60) + " " + shared + " " + words(5, 60), words(6, 80) + shared + words(7, 20), shared, "x<|endoftext|>y  <|endoftext|>", "é" * 49, "é" * 50, "é" * 51, "\0\t  　z  z",
        words(8, 5), words(8, 4), words(9, 2500),
    ]


def rows():
    made = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None, 7, "x", "y", 1) for i, t in enumerate(texts())]
    return [*made, (1000, made[9][1], "en", None, None, 7, "x", "y", 1), (1000, made[9][1], "en", None, None, 7, "x", "y", 1)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("doc_id < -1")


def test_bpe_equals_the_tokenizers_library(docs, none):
    t = Tokenizer.from_file(VOCABULARY)
    found = bpe.with_ids(docs, VOCABULARY, decode=True).collect()
    assert len(found) == len(rows())
    by = {r[0]: r[1] for r in rows()}
    for r in found:
        ids = t.encode(by[r["doc_id"]] or "", add_special_tokens=False).ids
        assert array("I", r["ids"]).tolist() == ids
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.with_ids(none, VOCABULARY, decode=True).count() == 0


def test_bpe_over_all_code_points_and_random_text(spark):
    t = Tokenizer.from_file(VOCABULARY)
    r = random.Random(5)
    some = [f"a{chr(c)} {chr(c)}b1{chr(c)}{chr(c)} '{chr(c)}" for c in range(0, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF]
    some += ["".join(r.choice(" \n\t'sxyZ09.,é🙂<|endoftext|>") for _ in range(r.randrange(60))) for _ in range(3000)]
    some += ["".join(r.choice(["'s", "'re", "'ll", "'", " ", "  ", "\n", "x", "9", "<|endoftext|>", "é", "\u3000", "!"]) for _ in range(r.randrange(30))) for _ in range(3000)]
    some += ["".join(r.choice("abcdeth") for _ in range(900)), "z" * 2000, "é" * 400]
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id int, text string")
    found = {x["doc_id"]: x for x in bpe.with_ids(frame, VOCABULARY, decode=True).collect()}
    for i, (x, e) in enumerate(zip(some, t.encode_batch(some, add_special_tokens=False), strict=True)):
        assert array("I", found[i]["ids"]).tolist() == e.ids and found[i]["decoded"] == t.decode(e.ids, skip_special_tokens=False), x
    cut = array("I", [0, 200, 255, 447, 199]).tobytes()
    made = spark.createDataFrame([(bytearray(cut),)], "ids binary").select(bpe.decoded(spark, VOCABULARY, F.col("ids")).alias("d")).first()
    assert made["d"] == t.decode(list(array("I", cut)), skip_special_tokens=False)


def test_media_round_trip(docs, none):
    stored = media.store_texts(docs)
    found = media.read_media(stored).collect()
    by = {r[0]: (r[1] or "").encode() for r in rows()}
    assert len(found) == len(rows())
    for r in found:
        raw = by[r["doc_id"]]
        assert r["media_type"] == "audio/wav" and r["n_bytes"] == len(raw)
        assert len(r["payload"]) % 576 == 0 and r["payload"] == raw + b"\xff" * (len(r["payload"]) - len(raw)) and len(r["payload"]) - len(raw) <= 576
        assert media.wav_samples(r["media"]) == r["payload"] and r["feature"] == media.sample_feature(bytes(r["payload"]))
    assert media.read_media(media.store_texts(none)).count() == 0


def test_sniffing_confirms_structure_and_carves():
    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")
    gif = b"GIF89a" + bytes(4) + b"\0\0\0" + b",\0\0\0\0\1\0\1\0\0" + b"\2\2\x4c\1\0" + b";"
    wav = media.wav_bytes(b"abc" + png)
    assert media.sniff(png) == [("image/png", 0, len(png))]
    assert media.sniff(b"xx" + gif + b"RIFF....WAVE") == [("image/gif", 2, 2 + len(gif))]
    assert media.sniff(wav) == [("audio/wav", 0, len(wav)), ("image/png", 47, 47 + len(png))]
    assert media.sniff(png[:-1]) == [] and media.sniff(b"BM" * 40) == [] and media.sniff(b"") == []


def test_packing_is_gapless_and_whole(docs, none):
    t = Tokenizer.from_file(VOCABULARY)
    pieces = packing.token_pieces(docs, VOCABULARY)
    found = packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("crc"), "doc_tokens"), ["doc_id", "start"]).collect()
    expected = []
    for i, text in [(r[0], r[1]) for r in rows()]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            expected.append((i, s, len(ids[s : s + 2048]), zlib.crc32(array("I", ids[s : s + 2048]).tobytes()), len(ids)))
    assert sorted(expected) == sorted((r["doc_id"], r["start"], r["length"], r["crc"], r["doc_tokens"]) for r in found)
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.token_pieces(none, VOCABULARY).drop("ids"), ["doc_id", "start"]).count() == 0


def test_closest_filling_is_the_best_subset():
    r = random.Random(3)
    for _ in range(300):
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(r.randrange(1, 6))}
        room, sums = r.randrange(0, 90), {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        chosen = packing.closest_filling(dict(counts), room)
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
    histogram = {k: r.randrange(5000) for k in range(1, 2048)}
    used, total, sequences = {}, 0, 0
    for p in packing.plan_patterns(histogram):
        for k, n in p.parts:
            used[k] = used.get(k, 0) + n * p.times
            total += k * n * p.times
        sequences += p.times
    assert used == {k: v for k, v in histogram.items() if v} and total / (2048 * sequences) > 0.99


def test_exact_groups_keep_the_largest(docs, none):
    found = exact.exact_groups(docs).collect()
    groups = {}
    for i, text in [(r[0], r[1] or "") for r in rows()]:
        groups.setdefault(text, []).append(i)
    expected = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted(tuple(r) for r in found) == expected
    assert exact.exact_groups(none).count() == 0
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, k, *_ in expected if i == k})


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live, r = exact.CuckooIndex(2), {}, random.Random(2)
    for i in range(6000):
        key = hashlib.sha256(str(r.randrange(3000)).encode()).digest()
        if key in live and r.random() < 0.5:
            assert index.delete(key)
            del live[key]
        elif key not in live:
            index.insert(key, i)
            live[key] = i
    assert dict(index.items()) == live and index.size == len(live)
    assert index.find(b"\1" * 32) == -1 and not index.delete(b"\1" * 32)


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def groups_by_brute_force(items):
    """items (id, text): sorted (id, n_shingles, component, kept)."""
    items = [(i, shingles(t)) for i, t in items]
    parent = {i: i for i, _ in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in items:
        for y, b in items:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((root(x), root(y)))
                parent[hi] = lo
    return sorted((i, len(s), root(i), i == root(i)) for i, s in items)


def test_near_groups_equal_brute_force(docs, none):
    expected = groups_by_brute_force([(r[0], r[1]) for r in rows()])
    assert sorted(tuple(r) for r in minhash.near_groups(docs).collect()) == expected
    assert minhash.near_groups(none).count() == 0
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, c, k in expected if k}


@pytest.mark.parametrize("hot", [None, 4])
def test_near_groups_of_families_equal_brute_force(spark, hot, monkeypatch):
    """Families of near copies around the limit, chains of them, in plain buckets and in buckets dealt in blocks."""
    if hot:
        monkeypatch.setattr(minhash, "HOT_BUCKET", hot)
        monkeypatch.setattr(minhash, "HOT_CODES", 300)
    r, made = random.Random(31), []
    for f in range(8):
        base = [f"w{r.randrange(300)}" for _ in range(90)]
        last = base
        for k in range(24):
            text = list(last if k % 5 == 4 else base)
            for _ in range(r.randrange(0, 9)):
                text[r.randrange(len(text))] = r.choice(["up", "down", f"x{r.randrange(40)}"])
            last = text
            made.append(" ".join(text))
    r.shuffle(made)
    given = list(enumerate(made))
    found = minhash.near_groups(spark.createDataFrame(given, "doc_id long, text string"))
    expected = groups_by_brute_force(given)
    assert sorted(tuple(x) for x in found.collect()) == expected
    assert 8 < len({c for _, _, c, _ in expected}) < 150


def test_super_minhash_estimates_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[1000:])
    s = minhash.super_minhash(np.concatenate((a, b, a[:3])), np.array([0, 2000, 4000, 4003]), 255 // 3 * 3)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.1 and (s != minhash.UNFILLED).all()
    assert len(set(s[2] & np.uint64(0xFFFFFFFF))) == len(s[2])


def test_components_follow_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (203, 201), (5, 5)]
    found = {r["id"]: r["label"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in [*range(1, 41), 100]) and found[201] == found[203] == 200


def removed_by_brute_force(items, length=100):
    seen, out = set(), {}
    for i, text in sorted(items, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.setdefault(i, []).append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [64, 0])
def test_suffix_dedup_equals_brute_force(docs, none, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix, "BLOCK", 9000)
    monkeypatch.setattr(suffix, "CHUNK", 500)
    found = {}
    for r in suffix.remove_repeats(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    expected = removed_by_brute_force([(r[0], r[1]) for r in rows()])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    if hot:
        assert suffix.remove_repeats(none).count() == 0
        kept = suffix.substring_dedup(docs)
        assert kept.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in kept.collect() if r["doc_id"] < 1000} == {i: v[0][3].decode(errors="ignore") for i, v in expected.items() if i < 1000 and (v[0][3].decode(errors="ignore") or not v[0][1])}


def test_suffix_dedup_of_short_and_clashing_rows(spark, tmp_path):
    """Partitions without any window, empty ones, null and repeated keys, columns with the operator's own names."""
    long = words(41, 60)
    given = [(1, "a"), (2, None), (3, "b c"), (None, long), (5, "x " + long), (5, long + " y"), (7, "short")]
    schema = "doc_id long, text string, kept string, n_bytes long, n_removed int, n_spans int, block int, flags int"
    frame = spark.createDataFrame([(*g, "k", 1, 2, 3, 4, 5) for g in given], schema)
    for rows_ in (frame, frame.where("length(text) < 9"), frame.repartition(5, "doc_id")):
        rows_.write.mode("overwrite").parquet(str(tmp_path / "d"))
        read = spark.read.parquet(str(tmp_path / "d"))
        kept = suffix.substring_dedup(read)
        assert kept.columns == read.columns and all(tuple(x)[2:] == ("k", 1, 2, 3, 4, 5) for x in kept.collect())
        found = sorted(((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in suffix.remove_repeats(read).collect()), key=repr)
        given_now = [(x["doc_id"], x["text"]) for x in read.collect()]
        brute = removed_by_brute_force([(-1 if i is None else i, t) for i, t in given_now])
        if len(given_now) == 7:
            assert {x[0]: x[2] for x in found if x[0] != 5} == {1: 0, 2: 0, 3: 0, None: 0, 7: 0} and sum(x[2] for x in found if x[0] == 5) == sum(x[1] for x in brute[5])
        else:
            assert all(x[2] == 0 for x in found)


def test_linear_grouping_marks_repeats(spark):
    r = random.Random(4)
    cases = [bytes(r.choice(b"ab" if k % 2 else b"abc\xff") for _ in range(r.randrange(0, 120))) for k in range(400)] + [b"a" * 60, b"ab" * 40, b"\xff" * 9, b"abaab" * 20, b""]
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, b binary")
    for row in frame.select("i", F.unbase64(call(spark, "SuffixGroups", "suffix_groups.java", "repeats", F.base64("b"), F.lit(4))).alias("m")).collect():
        text, seen = cases[row["i"]], set()
        bits = np.unpackbits(np.frombuffer(row["m"], np.uint8), bitorder="little")
        for p in range(len(text)):
            w = text[p : p + 4]
            whole = len(w) == 4 and 255 not in w
            assert bits[p] == (whole and w in seen), (text, p)
            seen |= {w} if whole else set()


def test_licenses_by_canonical_digest(spark, none):
    mit = next(p for n, _, p in licenses.TEXTS if n == "MIT")
    bsd = "\n\n".join([licenses.BSD_INTRO, *(f" * {c}" for c in licenses.BSD_CLAUSES[:2]), licenses.BSD_WARRANTY.format(givers="THE COPYRIGHT HOLDERS", giver="THE COPYRIGHT OWNER")])
    wrapped = mit[0].replace(" copyright ", " copyright\n").replace(" of ", "\n  of ")
    given = [
        (1, "Copyright (c) 2001 Some One\nAll rights reserved.\n\n" + "\n\n".join(mit).upper().replace(" ", "\n  ", 30), "x"),
        (2, "text\nReleased under the MIT LICENCE\nmore\n (C) 1999\nLicensed under CC BY-NC 4.0", "x"),
        (3, None, "x"), (4, "", "x"), (4, "", "x"), (5, "the MIT License", "x"), (6, bsd.replace(" copyright notice", "\ncopyright notice"), "x"),
        (7, f"The MIT License (MIT)\r\n\r\n© Some One\n\n{mit[0]}\n\n{mit[1]}\n\n{mit[2]}", "x"), (8, f"We ship it so.\n\n{wrapped}\n \t\nEnd.", "x"),
    ]
    found = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(given, "doc_id long, text string, license string")).collect()}
    assert {i: r["document_license"] for i, r in found.items() if r["document_license"]} == {1: "MIT", 6: "BSD-2-Clause", 7: "MIT"}
    assert found[2]["line_licenses"] == "CC-BY-NC-4.0|MIT" and found[2]["n_license_lines"] == 2 and found[8]["paragraph_licenses"] == "MIT"
    assert all(found[i]["line_licenses"] == found[i]["paragraph_licenses"] == "" for i in (3, 4, 5))
    assert len(found) == 8 and licenses.license_scan(none).count() == 0


def test_long_licenses_have_the_digests_of_the_public_texts(spark):
    folder = "/usr/share/common-licenses/"
    files = [(d, f) for d, f in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("BSD-3-Clause", "BSD")) if os.path.exists(folder + f)]
    texts = [(d, open(folder + f).read().replace("``AS IS''", "AS IS")) for d, f in files]
    found = licenses.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id int, text string")) if texts else None
    assert not texts or [r["document_license"] for r in found.orderBy("doc_id").collect()] == [d for d, _ in texts]


def xxhash64_of(values, spark):
    """xxhash64 of pairs of strings, as Spark has it."""
    return [x[0] for x in spark.createDataFrame(values, "a string, b string").select(F.xxhash64("a", "b")).collect()]


def test_shards_equal_a_tree_walked_by_hand(spark):
    """Regions of two racks of two shards, one region for each later shard; draws -ln(u) / shards below."""
    keys = [str(i) for i in range(400)]
    regions = [[[0, 1], [2, 3]], [[4, 5], [6]], [[7]]]  # set up with 7, one more since
    names = {"0": "region0", "1": "region1", "2": "later7"}

    def draw(key, path, weight):
        (h,) = (draws[key, path],)
        return -np.log(((h % (1 << 64) >> 11) + 0.5) / (1 << 53)) / weight

    paths = ["/region0", "/region1", "/later7", "/region0/rack0", "/region0/rack1", "/region1/rack2", "/region1/rack3"]
    paths += [f"/region{i // 4}/rack{i // 2}/shard{i}" for i in range(7)]
    asked = [(k, p) for k in keys for p in paths]
    draws = dict(zip(asked, xxhash64_of(asked, spark), strict=True))
    count = lambda x: sum(map(count, x)) if isinstance(x, list) else 1
    expected = {}
    for k in keys:
        r = min(range(3), key=lambda i: draw(k, f"/{names[str(i)]}", count(regions[i])))
        if r == 2:
            expected[int(k)] = 7
            continue
        racks = regions[r]
        c = min(range(2), key=lambda i: draw(k, f"/region{r}/rack{2 * r + i}", count(racks[i])))
        expected[int(k)] = min(racks[c], key=lambda s: draw(k, f"/region{r}/rack{2 * r + c}/shard{s}", 1)) if len(racks[c]) > 1 else racks[c][0]
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert {x["doc_id"]: x["shard"] for x in sharding.assign_shards(frame, 8, setup=7).collect()} == expected
    assert {x["doc_id"]: x["grown_shard"] for x in sharding.assign_shards(frame, 7).collect()} == expected


def test_shards_move_rows_only_to_the_new_one(docs, none, spark):
    found = sharding.assign_shards(docs).collect()
    by = {r[0]: (r[1] or "").encode() for r in rows()}
    assert len(found) == len(rows())
    for r in found:
        assert r["size"] == len(by[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(by[r["doc_id"]]) and r["grown_shard"] in (r["shard"], 8)
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign_shards(none).count() == 0
    rows_ = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    many = sharding.assign_shards(rows_)
    assert min(r["count"] for r in many.groupBy("shard").count().collect()) > 2000 and 1500 < many.where("grown_shard = 8").count() < 3000
    for shards, setup in ((1, 1), (2, 2), (3, 3), (5, 5), (6, 6), (7, 7), (9, 9), (10, 10), (9, 8), (10, 8), (11, 6)):
        some = sharding.assign_shards(rows_.where("doc_id < 5000"), shards, setup=setup)
        assert some.where(f"grown_shard <> shard AND grown_shard <> {shards}").count() == 0 and some.where(f"grown_shard = {shards}").count() > 2500 / (shards + 1)
        assert some.select("shard").distinct().count() == shards


def rendering_by_brute_force(turns):
    """turns (conv_id, turn, role, text): {(conv_id, perspective): (rendered, own texts)}."""
    plain = lambda x: x.replace("<|", "< |")
    by, out = {}, {}
    for c, t, role, text in turns:
        by.setdefault(c, []).append((-1 if t is None else t, plain(role or "unknown"), plain(text or "")))
    for c, said in by.items():
        roles = {r for _, r, _ in said}
        for p in roles - {"system"} if len(roles) > 1 else roles:
            parts = [(f"<|assistant|>\n{x}\n" if r == p else f"<|system|>\n{x}\n" if r == "system" else f"<|user name={r}|>\n{x}\n") for _, r, x in sorted(said)]
            out[c, p] = "".join(parts), [x for _, r, x in sorted(said) if r == p]
    return out


def test_chat_rotation_masks_the_speaker(spark):
    r = random.Random(6)
    given = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi é"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 200, "ann", None), (2, None, None, "x"), (3, 0, "system", "s"), (None, 0, "u", "n"), (None, 1, "<|v", "<|assistant|>")]
    given += [(7, i, r.choice(["ann", "bob", "cy"]), f"t{i} 🙂") for i in range(130)] + [(8, 5, r.choice(["ann", "bob"]), f"t{i % 90}") for i in range(200)]
    frame = spark.createDataFrame([(*g, 9) for g in given], "conv_id long, turn long, role string, text string, part int")
    expected = rendering_by_brute_force(given)
    found = {(x["conv_id"], x["perspective"]): x for x in chat.rotate_perspectives(frame).collect()}
    assert set(found) == set(expected)
    for k, (rendered, own) in expected.items():
        x = found[k]
        assert x["rendered"] == rendered and x["n_masked"] == len(own)
        # SQL counts code points
        assert [rendered[int(s) : int(e)] for s, e in (m.split(":") for m in x["mask"].split(",") if m)] == own
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_kneser_ney_probabilities_sum_to_one():
    data = np.frombuffer(b"the cat and the hat and the bat sat" * 3, np.uint8)
    grams, counts = np.unique(quality.gram_codes(data, np.array([0, len(data)])), return_counts=True)
    made = quality.levels(grams, counts)
    cut = [quality.discounts(m.of_counts()) for m in made]
    two = quality._lower(made[-1].grams, 2)
    one = np.bincount((two.grams & np.uint64(0xFF)).astype(np.int64), minlength=256)
    singles = (np.maximum(one - 0.5, 0) + 0.5 * np.count_nonzero(one) / 256) / one.sum()
    for context in (b"the ", b" hat", b"zzzz", b"zzat"):
        head = int.from_bytes(context, "big") << 8
        codes = np.array([head | b for b in range(256)], np.uint64)
        p = two.interpolate(codes & np.uint64(0xFFFF), singles, quality.discounts(two.of_counts()))
        for i in range(len(made) - 1, -1, -1):
            p = made[i].interpolate(codes & np.uint64((1 << 8 * (quality.ORDER - i)) - 1), p, cut[i])
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_quality_rejects_junk(spark, docs, none, tmp_path):
    r = random.Random(8)
    vocabulary = ["".join(r.choice(["ba", "lo", "mi", "te", "run"]) for _ in range(r.randrange(1, 4))) for _ in range(200)]
    clean = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(20, 200))), "en") for i in range(300)]
    junk = [(1000 + i, " ".join(r.choice("#$%&*") * 3 + r.choice(vocabulary).upper() for _ in range(80)), "en") for i in range(20)]
    spark.createDataFrame([*clean, *junk, (2000, None, None), (2001, "", "en"), (2001, "", "en")], "doc_id long, text string, lang string").repartition(2, "doc_id").write.parquet(str(tmp_path / "d"))
    given = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000, 0, 0), (201, 1, 1), (5, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.classify(given, labels).collect()}
    assert len(found) == 322 and not any(found[1000 + i]["kept"] for i in range(20))
    assert sum(found[i]["kept"] for i in range(300)) >= 295 and found[2000]["kept"] and found[2001]["kept"]
    assert quality.classify(none, labels).count() == 0
    unlabelled = quality.classify(given, labels.where("quality = 7"))
    assert unlabelled.where("NOT kept").count() == 0
    assert quality.quality_filter(given, labels).columns == given.columns


def by_row(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_exact_dedup_judges_rows_not_keys(spark):
    given = [(5, "A"), (5, "B"), (9, "A"), (9, "A"), (None, "A"), (None, "C"), (None, "C"), (None, None), (7, "")]
    assert by_row(exact.exact_dedup(spark.createDataFrame(given, "doc_id long, text string"))) == sorted([(5, "B"), (9, "A"), (None, "C"), (7, "")], key=repr)


def test_near_dedup_judges_rows_not_keys(spark):
    a, b = words(21, 300), words(22, 300)
    given = [(3, a), (3, a), (5, a + " tail"), (5, b), (8, b + " tail"), (None, a + " end"), (None, words(23, 90)), (6, "one"), (6, "two"), (None, "")]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    assert by_row(minhash.near_dedup(frame)) == sorted([(3, a), (5, b), given[6], (6, "one"), (6, "two"), (None, "")], key=repr)
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_groups(frame).collect()), key=repr)
    assert found == sorted([(3, 3, True), (3, 3, True), (5, 3, False), (5, 5, True), (8, 5, False), (None, 3, False), (None, None, True), (6, 6, True), (6, 6, True), (None, None, True)], key=repr)


def test_quality_filter_judges_rows_not_keys(spark, tmp_path):
    clean = [(i, words(100 + i, 120), "en") for i in range(200)]
    junk = "#$%&* QX! " * 80
    spark.createDataFrame([*clean, (500, junk, "en"), (500, words(900, 120), "en"), (None, junk, "en"), (None, words(901, 120), "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(180)], "doc_id long, quality int, toxic int")
    kept = by_row(quality.quality_filter(spark.read.parquet(str(tmp_path / "d")), labels))
    assert (500, words(900, 120)) in kept and (None, words(901, 120)) in kept and not any(t == junk for _, t in kept)


def test_quality_rejects_repeated_words(spark, tmp_path):
    clean = [(i, words(100 + i, 120), "en") for i in range(200)]
    junk = [(500 + i, " ".join([words(400 + i, 1)] * 150), "en") for i in range(10)]
    spark.createDataFrame([*clean, *junk, (600, "", "en"), (601, "of7", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(180)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(spark.read.parquet(str(tmp_path / "d")), labels).collect()}
    assert not any(kept[500 + i] for i in range(10)) and sum(kept[i] for i in range(200)) >= 195 and kept[600] and kept[601]


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_words_of_one_pattern_are_not_one(spark):
    """Words that every polynomial hash modulo 2**64 takes for one have different codes; neither text goes."""
    made = [(i, "".join(letters[x] for x in thue_morse(n)), None, None, None, 7, "x", "y", 1) for i, (n, letters) in enumerate((n, s) for n in (1024, 2048, 4096) for s in ("ab", "ba"))]
    docs = spark.createDataFrame(made, SCHEMA)
    assert all(r.kept and r.component_id == r.doc_id for r in minhash.near_groups(docs).collect())
    assert minhash.near_dedup(docs).count() == len(made)


def test_long_text_has_a_bounded_share_of_memory():
    """A text of 20 MB, and one word of that length, take at most 20 bytes a byte beside the text."""
    import tracemalloc

    for text in (("lorem ipsum dolor sit amet " * 150 + "q%d ") * 5000, "x" * (20 << 20)):
        data = np.frombuffer(text.encode(), np.uint8)
        tracemalloc.start()
        _, ends = minhash.shingle_sets(data, np.array([0, len(data)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20 * len(data) and ends[-1] >= 1


def test_keys_that_are_strings(spark):
    """Exact dedup and the quality filter take string keys; of copies the last key in byte order stays."""
    text = words(31, 60)
    made = [("b", text, "en"), ("é", text, "en"), ("a", words(32, 50), "en"), (None, text, "en"), ("z", None, "fr"), ("y", "", None)]
    docs = spark.createDataFrame(made, "doc_id string, text string, lang string")
    groups = {r.doc_id: tuple(r)[1:4] for r in exact.exact_groups(docs).collect()}
    assert groups == {"b": ("é", 3, False), "é": ("é", 3, True), None: ("é", 3, False), "a": ("a", 1, True), "z": ("z", 2, True), "y": ("z", 2, False)}
    assert {r.doc_id for r in exact.exact_dedup(docs).collect()} == {"é", "a", "z"}
    labels = spark.createDataFrame([(k, 1, 0) for k, _, _ in made], "doc_id string, quality int, toxic int")
    assert quality.classify(docs, labels).count() == len(made) and quality.quality_filter(docs, labels).count() == len(made)


def test_quality_of_an_unstable_input(spark):
    """Rows whose order changes from read to read are written first; each is judged once."""
    docs = spark.createDataFrame([(i, words(40 + i, 200), "en") for i in range(60)], "doc_id long, text string, lang string").repartition(4).orderBy(F.rand())
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert not quality.plain_scan(docs)
    assert sorted(r.doc_id for r in quality.classify(docs, labels).collect()) == list(range(60))


def test_hot_windows_have_two_hashes():
    data = np.frombuffer(words(50, 300).encode(), np.uint8)
    found = suffix.Anchors(data, np.array([0, len(data)]))
    begin = np.arange(len(data) - 100)
    one, two = found.hashed(begin, begin + 100), found.hashed_again(begin, begin + 100)
    assert len(set(one)) == len(set(two)) == len(begin) and not (one == two).any()
    twice = suffix.Anchors(np.concatenate((data, data)), np.array([0, 2 * len(data)]))
    assert (twice.hashed_again(begin, begin + 100) == twice.hashed_again(begin + len(data), begin + len(data) + 100)).all()


def test_quality_trains_on_all_trusted_text(spark, tmp_path):
    """More trusted documents than any sample: those that come last by hash are known to the model as well."""
    n = 28_000
    tail = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) > n - 1_500
    made = spark.range(n).select(F.col("id").alias("doc_id")).withColumn("text", F.when(tail, "qzqzqzqzqzqzqzqz").otherwise("the cat sat")).withColumn("lang", F.lit("en"))
    made.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    worst = quality.score_documents(docs, labels).where("n_bytes = 16").agg(F.max(F.col("nll") / F.col("n_bytes"))).first()[0]
    assert worst < 1.0


def test_hot_anchors_are_a_share_of_the_blocks():
    """An anchor in 90 of 400 blocks keeps its zones; one in 150 goes by windows."""
    keys = lambda b: np.array([k for k, n in ((2, 90), (4, 150), (6, 1)) if b < n], np.uint64)
    blocks = list(range(400))
    asked = suffix.pa.table({"shard": [0] * 400, "block": blocks, "keys": [keys(b).tobytes() for b in blocks], "zones": [np.full(len(keys(b)), b << 1, np.uint64).tobytes() for b in blocks]})
    flags = [list(f.as_py()) for f in suffix._repeated_anchors(64, 4)(asked).column("flags")]
    plain, hot = suffix.AGAIN | suffix.DIFFERENT, suffix.AGAIN | suffix.DIFFERENT | suffix.HOT
    assert flags[0] == [plain, hot, 0] and flags[89] == [plain, hot] and flags[149] == [hot] and flags[150] == []


def test_suffix_dedup_writes_no_texts_of_a_plain_scan(spark, tmp_path, monkeypatch):
    names = []
    monkeypatch.setattr(suffix, "written", lambda df, name: names.append(name) or df)
    spark.createDataFrame([(i, words(41, 60)) for i in range(3)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(r["n_removed"] > 0 for r in suffix.remove_repeats(read).collect()) == [False, True, True] and names == ["anchor-flags"]
    assert suffix.remove_repeats(read.orderBy("doc_id")).count() == 3 and names[1:] == ["documents", "anchor-flags"]


def test_shards_follow_the_bytes_of_a_table_not_its_partitions(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i} {'text ' * 60}{i % 3}") for i in range(400)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    found = sorted(tuple(r) for r in suffix.remove_repeats(read).collect())
    size = sum(p.stat().st_size for p in (tmp_path / "d").glob("*.parquet"))
    monkeypatch.setattr(suffix, "SHARD_BYTES", -(-size // 40))
    assert read.rdd.getNumPartitions() == 1 and suffix.shards_of(read) == 40
    assert sorted(tuple(r) for r in suffix.remove_repeats(read).collect()) == found
