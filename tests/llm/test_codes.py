"""Vector codes against plain Lloyd's rounds on integers: ties, repeated rows, nulls, names that clash, empty tables, limits."""

import hashlib
import math
import random

import numpy as np
import pytest

from paraloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x string, code string, pid int, sums int"


def plain(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    kept = [(k, [math.floor(codes.SCALE * np.float32(c).item()) for c in v], label) for k, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(cut(r[1], p), books[p]) for r in kept]
            for e in range(len(books[p])):
                mine = [cut(r[1], p) for r, o in zip(kept, own, strict=True) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for k, v, label in kept:
        own = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((k, "".join(f"{o:02x}" for o in own), sum(far(cut(v, p), books[p][o]) for p, o in enumerate(own)), label))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    of = {label: sum(o[2] for o in out if o[3] == label) for label in {o[3] for o in out}}
    return sorted(((k, code, error, of[label], digest) for k, code, error, label in out), key=repr)


def made(n, width, seed, few=None):
    r = random.Random(seed)
    value = (lambda: r.choice(few)) if few else (lambda: r.gauss(0, 1))
    return [(i, [float(np.float32(value())) for _ in range(width)], r.choice([1, 2, None])) for i in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(k, v, label, "k", "x", "c", 7, 8) for k, v, label in rows], SCHEMA).repartition(parts)


def odd():
    rows = made(120, 16, 1, few=[-0.5, 0.0, 0.25, 1 / 3, -1e-5])  # ties everywhere
    rows += rows[3:9] + [rows[40]] * 50  # repeated rows
    rows += [(None, rows[5][1], 2), (1000, None, 1), (1001, [None] * 16, 1), (1002, [float("nan")] + [0.0] * 15, None), (1003, [0.0] * 15 + [float("-inf")], 3)]
    return rows


@pytest.mark.parametrize("rows", [made(300, 64, 2), odd(), made(9, 8, 3), made(40, 8, 4, few=[1.0]), [(i, [], 1) for i in range(20)]], ids=["plain", "odd", "few", "equal", "no components"])
def test_equals_plain_rounds(spark, rows):
    found = codes.vector_codes(frame(spark, rows))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows)


def test_bounds_leave_out_distances(spark):
    """On vectors round a few centres later rounds compute a small share of all distances, with the same outcome."""
    r = random.Random(5)
    centres = [[r.uniform(-8, 8) for _ in range(16)] for _ in range(16)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.01))) for c in centres[i % 16]], 0) for i in range(800)]
    coded, _, work = codes.encode_vectors(frame(spark, rows))
    assert work[0] == 800 * 8 * 16
    assert max(work[2:]) < work[0] / 4
    assert sorted(r.code for r in coded.collect()) == sorted(r[1] for r in plain(rows))


def test_halves_are_on_the_safe_side():
    x = np.concatenate([np.logspace(-30, 30, 997), [0.0, 1.0, 2.0, 65535.0, 1 << 40]])
    assert (codes.from_half(codes.upper_half(x)) >= x).all()
    assert (codes.from_half(codes.lower_half(x)) <= x).all()
    assert (codes.from_half(codes.upper_half(x)) <= x * 1.02 + 1e-30).all()


def test_empty_and_wrong_tables(spark):
    none = codes.vector_codes(frame(spark, made(3, 8, 6)).where("vec_id < 0"))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0
    for rows in ([(0, [1.0] * 8, 1), (1, [1.0] * 16, 1)], [(0, [1.0] * 7, 1)], [(0, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match="one length|not below"):
            codes.vector_codes(frame(spark, rows)).count()
