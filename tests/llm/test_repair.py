"""Conversation repair against all edits of short dialogues, and against whole-string layers where dialogues are cut into segments."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from paraloom.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, seg int, at string, n long, draw int"
SPACE = " \t\n\x0b\x0c\r"


def hurt(rows):
    """conv_id to its rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            mine += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return {c: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, m in out.items()}


def statistics(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.sub(f"[^{SPACE}]", "x", text).rstrip(SPACE)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if text[len(last) - 1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return faults, [gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs)]


def all_edits(rows, faults):
    """The least cost and audit of all edits with up to two inserted turns at each place."""
    found = []
    edits = ["D" if f in ("blank", "duplicate") else "DKR" for f in faults]
    for own in itertools.product(*edits):
        for inserted in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * inserted[0] + "".join(e + "I" * k for e, k in zip(own, inserted[1:], strict=True))
            cost, lines, state, at = 0, [], "", 0
            for e in audit:
                role, text = ("", "") if e == "I" else rows[at][1:]
                at += e != "I"
                cost += {"I": 5, "D": 2, "K": 0, "R": 1}[e] + (5 if e in "KR" and faults[at - 1] == "truncated" else 0)
                if e == "D":
                    continue
                role = role if e == "K" else "assistant" if state[-1:] == "u" else "user"
                state += role[:1] or "-"
                lines.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", state):
                found.append((cost, audit, "\n".join(lines)))
    cost, audit, text = min(found)
    return [cost, audit, hashlib.sha256(text.encode()).hexdigest()]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "at", 5, 3) for r in rows], SCHEMA).repartition(parts)


def made(seed, conversations, most):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "ursa", None]
    texts = ["Yes.", "No", "Why?", "", "\t ", None, "Fine!", "ok.", "é", "ok. \x0b", "End. "]
    rows = []
    for c in range(conversations):
        turns = range(r.randint(1, most))
        for t in turns:
            rows.append((c, r.choice([t, t, t, t, max(0, t - 1), None, t + 2]), r.choices(roles, [8, 8, 3, 1, 1, 1, 1])[0], r.choice(texts) if r.random() < 0.5 else f"text {c} {t}."))
    return rows + rows[::17] + [(None, t, role, "No conversation.") for t, role in ((0, "user"), (1, "assistant"), (None, "user"))]


def checked(found, rows, whole):
    assert found.columns == ["conv_id", *repair.STATS, "cost", "audit", "repaired_sha256"]
    got = {r[0]: list(r[1:]) for r in found.collect()}
    expected = hurt(rows)
    assert got.keys() == expected.keys() and found.count() == len(expected)
    for conv, mine in expected.items():
        faults, counts = statistics(mine)
        assert got[conv] == counts + whole(mine, faults), (conv, mine)


@pytest.mark.parametrize("segment_rows", [1, 2, 4096])
def test_equals_all_edits(spark, segment_rows):
    rows = made(1, 90, 4)
    short = {c for c, m in hurt(rows).items() if len(m) < 5}
    rows = [r for r in rows if r[0] in short]
    checked(repair.repair_conversations(frame(spark, rows), segment_rows), rows, all_edits)


def layers(rows, faults):
    """The least (cost, audit) with whole strings, each row by itself."""
    layer = repair.closed(repair.NOTHING)
    turns = [(role, text, 1, f == "duplicate") for (_, role, text), f in zip(rows, faults, strict=True)]
    for t in turns:
        layer = repair.step(layer, t)
    cost, audit = repair.best(layer)
    return [cost, audit, hashlib.sha256(repair.edited(turns, audit, repair.START).encode()).hexdigest()]


@pytest.mark.parametrize("segment_rows", [3, 16, 4096])
def test_long_dialogues_in_segments(spark, segment_rows):
    r = random.Random(3)
    rows = made(2, 12, 40)
    rows += [(500, t, r.choice(["user", "assistant"]), r.choice(["Hm.", f"Line {t}.", "cut", ""])) for t in range(700)]
    rows += [(501, None, "user", f"No number {t}.") for t in range(150)] + [(502, 3, "assistant", "Same.")] * 200
    checked(repair.repair_conversations(frame(spark, rows, 5), segment_rows), rows, layers)


def test_equals_sql(spark):
    rows = made(4, 60, 9)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = repair.repair_conversations(frame(spark, rows))
    expected = con.sql(queries.ORACLES["op11_repair"]).select(*found.columns).fetchall()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in found.collect())


def test_lost_and_empty(spark):
    lost = next(c for c in range(10_000) if not hurt([(c, 0, "user", "Hi.")])[c])
    found = repair.repair_conversations(frame(spark, [(lost, 0, "user", "Hi.")]))
    assert [tuple(r) for r in found.collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_conversations(frame(spark, made(5, 2, 2)).where("conv_id < -1")).count() == 0
