"""Conversation structure repair: the cheapest edits after which a dialogue's roles follow the grammar (s?(ua)+)?.

Forward Viterbi over four states (nothing yet, after a system turn, after a user
turn, after an assistant turn). Each state carries its least (cost, audit), the
audit being the edits' initials; after each turn the layer is closed by inserted
turns, of which two in a row are enough. Audits of a layer never begin one another
before it is closed, as each ends with an edit of the same turn, so the least one
stays the least whatever follows.

Turns are sorted over all partitions by (conversation, turn, role, text), equal ones
counted as one row, so a conversation of any size, or one turn number that many rows
share, is dealt out. A dialogue that lies inside one partition in at most
SEGMENT_ROWS rows and SEGMENT_BYTES of text is repaired as it is read. The others are cut into
segments of this size, and each segment tells for each state it may be entered in the
least cost of each state it may be left in, with the order of these audits. Only these
few numbers of a dialogue's segments meet: they tell in which state each segment is
entered and left, and then every segment writes its own piece. The SHA-256 of a
repaired text can't be computed in parts, so pieces of a dialogue stream through one
task in their order; only the audit, one letter an edit, is held.

Defined cases: null role and text are one space, as are null conv_id and turn in the
damage's key `conv_id:turn`; rows without conv_id make one dialogue; turns without
number come first; rows of one turn go by role and text. Role initials are of the
exact role, so rows of an empty role, ` ` and others can only be reroled or deleted. A dialogue that
lost all rows has zeros, an empty audit and the hash of nothing. Very long texts and
repeated rows are rows as any other; an empty table gives an empty result; other
columns, whatever their names, are ignored. Turn numbers are cast to long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, small_batches, written

INSERT, REROLE, DELETE, TRUNCATED = 5, 1, 2, 5
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
SPACES = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)
OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]

#: Cost and audit, or not to be reached.
Entry = tuple[int, str] | None
#: Role, text, how often, whether role and text were seen earlier.
Turn = tuple[str, str, int, bool]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n: the rows after damage, equal ones counted; a dialogue that lost a row has a row with n from 0."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    kept = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), draw.alias("draw"))
    gone = F.col("draw") == 0
    rows = kept.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("draw") == 1), "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("draw") == 3, 2).otherwise(1).alias("n"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def closed(layer: list[Entry]) -> list[Entry]:
    """The layer with the turns that may be inserted after it."""
    start, system, user, assistant = layer
    more = lambda e: (e[0] + INSERT, e[1] + "I")
    user = min((e for e in (user, *(more(e) for e in (start, system, assistant) if e)) if e), default=None)
    if user:
        assistant = min(assistant, more(user)) if assistant else more(user)
    return [start, system, user, assistant]


def fault(turn: Turn) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    last = turn[1].rstrip(SPACES)[-1:]
    return "blank" if not last else "duplicate" if turn[3] else "" if last in ".!?" else "truncated"


def step(layer: list[Entry], turn: Turn) -> list[Entry]:
    """The closed layer after one more turn; its further copies are duplicates."""
    initial, wrong = turn[0][:1], fault(turn)
    after: list[Entry] = [e and (e[0] + DELETE, e[1] + "D") for e in layer]
    if wrong in ("", "truncated"):
        more = TRUNCATED if wrong else 0
        for target, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,)), (SYSTEM, (START,))):
            keeps = OF_INITIAL.get(initial) == target
            if not keeps and target == SYSTEM:
                continue
            cost, edit = (more, "K") if keeps else (more + REROLE, "R")
            after[target] = min((e for e in (after[target], *((layer[s][0] + cost, layer[s][1] + edit) for s in sources if layer[s])) if e), default=None)
    after = closed(after)
    if turn[2] > 1:
        again = turn[2] - 1
        after = closed([e and (e[0] + DELETE * again, e[1] + "D" * again) for e in after])
    return after


def best(layer: list[Entry]) -> tuple[int, str]:
    return min(e for e in (layer[START], layer[ASSISTANT]) if e)


def edited(turns: Iterable[Turn], audit: str, state: int) -> str:
    """The repaired turns, one `role:text` after the other, that the audit makes from a state on."""
    copies = (t for t in turns for _ in range(t[2]))
    lines = []
    for edit in audit:
        if edit != "I":
            role, text = next(copies)[:2]
        if edit == "D":
            continue
        if edit == "K":
            state = OF_INITIAL[role[0]]
        else:
            state = ASSISTANT if state == USER else USER
            role, text = "assistant" if state == ASSISTANT else "user", "" if edit == "I" else text
        lines.append(f"{role}:{text}")
    return "\n".join(lines)


class Counts:
    """What is counted along the rows of a dialogue or a segment."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.first, self.last = 0, None, None
        self.least, self.most, self.turns = None, None, 0

    def add(self, number: int | None, turn: Turn) -> None:
        role, _, n, _ = turn
        wrong = fault(turn)
        self.faults[wrong] += 1
        self.faults["blank" if wrong == "blank" else "duplicate"] += n - 1
        self.join(role[:1], number, role[:1], number, n - 1, 0 if number is None else 1)

    def join(self, first: str, least: int | None, last: str, most: int | None, illegal: int, turns: int) -> None:
        """Go on with rows of these outer initials, turn numbers, illegal pairs and different numbers."""
        if self.last is None:
            self.first = first
        elif self.last + first not in LEGAL:
            self.illegal += 1
        self.illegal, self.last = self.illegal + illegal, last
        if least is not None:
            self.turns += turns - (least == self.most)
            self.least, self.most = least if self.least is None else self.least, most

    def stats(self) -> list[int]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return [gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal]


NOTHING: list[Entry] = [(0, ""), None, None, None]


def repaired(rows: list[tuple[int | None, str, str, int]]) -> list:
    """Statistics, cost, audit and hash of a whole dialogue's sorted rows (turn, role, text, n)."""
    seen, counts, layer, turns = set(), Counts(), closed(NOTHING), []
    for number, role, text, n in rows:
        if n:
            turns.append((role, text, n, (role, text) in seen))
            seen.add((role, text))
            counts.add(number, turns[-1])
            layer = step(layer, turns[-1])
    cost, audit = best(layer)
    return [*counts.stats(), cost, audit, hashlib.sha256(edited(turns, audit, START).encode()).hexdigest()]


RESULT = [*((c, pa.int64()) for c in [*STATS, "cost"]), ("audit", pa.string()), ("repaired_sha256", pa.string())]
ROW = [("seg", pa.int64()), ("at", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]
SQL_OF = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}


def _ddl(fields: list[tuple[str, pa.DataType]], key: str) -> str:
    return ", ".join([f"conv_id {key}", *(f"{n} {SQL_OF[t]}" for n, t in fields)])


def _batch(keys: list, kind: pa.DataType, fields: list[tuple[str, pa.DataType]], rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True))], names=["conv_id", *(n for n, _ in fields)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of record batches."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class Out:
    """Rows of a result, given out by the hundreds."""

    def __init__(self, kind: pa.DataType, fields: list[tuple[str, pa.DataType]], most: int = 512) -> None:
        self.kind, self.fields, self.most, self.keys, self.rows = kind, fields, most, [], []

    def add(self, key, row: list) -> Iterator[pa.RecordBatch]:
        self.keys.append(key)
        self.rows.append(row)
        if len(self.keys) >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            yield _batch(self.keys, self.kind, self.fields, self.rows)
        self.keys, self.rows = [], []


def _local(kind: pa.DataType, most: int):
    """Repair the dialogues that lie inside a partition and have at most `most` rows; give the others' rows out in segments."""
    fields = [*RESULT, *ROW]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size, seg = Out(kind, fields), [], 0, TaskContext.get().partitionId() << 32
        now, inside, any_row = None, False, False  # the dialogue at hand, and whether all of it is held

        def opened() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, seg, inside
            for at, row in enumerate(held):
                yield from out.add(now, [None] * len(RESULT) + [seg, at, *row])
            held, size, seg, inside = [], 0, seg + 1, False

        for conv, *row in _rows(batches):
            if not any_row or conv != now:
                if inside:
                    yield from out.add(now, [*repaired(held), *[None] * len(ROW)])
                    held, size = [], 0
                elif any_row:
                    yield from opened()
                now, inside, any_row = conv, any_row, True
            elif len(held) >= most or size >= SEGMENT_BYTES:
                yield from opened()
            held.append(row)
            size += len(row[2])
        if held:
            yield from opened()
        yield from out.rest()

    return run


MOVES = pa.list_(pa.int64())
SUMMARY = [("seg", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()), *((c, pa.int64()) for c in STATS[1:]), *((c, MOVES) for c in ("costs", "ranks", "inserted")), ("heads", pa.string())]
PATH = [("seg", pa.int64()), ("lead", pa.int64()), ("enter", pa.int64()), ("leave", pa.int64()), *((c, pa.int64()) for c in [*STATS, "cost"])]
PIECE = [("seg", pa.int64()), ("audit", pa.string()), ("text", pa.string())]


def _by_segment(rows: Iterator[tuple], at: int) -> Iterator[list[tuple]]:
    """Runs of rows with one value at a place."""
    held: list[tuple] = []
    for row in rows:
        if held and held[0][at] != row[at]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _layers(turns: list[Turn], state: int) -> list[Entry]:
    layer: list[Entry] = [None] * 4
    layer[state] = (0, "")
    for turn in turns:
        layer = step(layer, turn)
    return layer


def _summary(kind: pa.DataType):
    """Of each segment: counts, and for each pair of states the cost, the rank of the audit among those from one state, the turns inserted last and the first edit."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(kind, SUMMARY)
        for rows in _by_segment(_rows(batches), 1):
            counts, turns = Counts(), []
            for _, _, _, number, role, text, n, first in rows:
                if n:
                    turns.append((role, text, n, not first))
                    counts.add(number, turns[-1])
            costs, ranks, inserted, heads = [], [], [], ""
            for state in range(4) if turns else ():
                layer = _layers(turns, state)
                base = sorted({e[1].rstrip("I") for e in layer if e})
                for e in layer:
                    costs.append(e[0] if e else -1)
                    ranks.append(base.index(e[1].rstrip("I")) if e else -1)
                    inserted.append(len(e[1]) - len(e[1].rstrip("I")) if e else -1)
                    heads += e[1][0] if e else "-"
            yield from out.add(rows[0][0], [rows[0][1], counts.first, counts.last, counts.least, counts.most, counts.turns, *counts.stats()[1:], costs, ranks, inserted, heads])
        yield from out.rest()

    return run


def _fold(kind: pa.DataType):
    """Of each dialogue's summaries, in order: in which states each segment is entered and left; a row with seg -1 has the statistics and the cost."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(kind, PATH)
        for rows in _by_segment(_rows(batches), 0):
            counts, back, extra = Counts(), [], [0] * 3
            # of each state: cost, order among the audits without what was inserted last, turns inserted last
            layer = [(0, 0, 0), None, (INSERT, 0, 1), (2 * INSERT, 0, 2)]
            for _, seg, first, last, least, most, turns, *faults, illegal, costs, ranks, inserted, heads in rows:
                if not costs:
                    continue
                extra = [a + b for a, b in zip(extra, faults, strict=True)]
                counts.join(first, least, last, most, illegal, turns)
                found = []
                for t in range(4):
                    ways = [(layer[s][0] + costs[4 * s + t], (layer[s][1], "I" * layer[s][2] + heads[4 * s + t], ranks[4 * s + t]), s) for s in range(4) if layer[s] and costs[4 * s + t] >= 0]
                    found.append(min(ways, default=None))
                order = sorted({w[1] for w in found if w})
                back.append((seg, [w and w[2] for w in found]))
                layer = [w and (w[0], order.index(w[1]), inserted[4 * w[2] + t]) for t, w in enumerate(found)]
            ends = [(*layer[t], t) for t in (START, ASSISTANT) if layer[t]]
            cost, _, _, leave = min(ends)
            counts.faults.update(zip(STATS[1:4], extra, strict=True))
            yield from out.add(rows[0][0], [-1, 0, 0, leave if not back else 0, *counts.stats(), cost])
            path = []
            for seg, came in reversed(back):
                path.append((seg, came[leave], leave))
                leave = came[leave]
            for i, (seg, enter, leave) in enumerate(reversed(path)):
                lead = {START: 0, USER: 1, ASSISTANT: 2}[enter] if i == 0 else 0
                yield from out.add(rows[0][0], [seg, lead, enter, leave, *[None] * 6])
        yield from out.rest()

    return run


def _pieces(kind: pa.DataType):
    """The audit and the repaired text of each segment on its path."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(kind, PIECE, 1)
        for rows in _by_segment(_rows(batches), 1):
            turns = [(role, text, n, not first) for _, _, _, _, role, text, n, first, *_ in rows if n]
            lead, enter, leave = rows[0][-3:]
            audit = "I" * lead + _layers(turns, enter)[leave][1]
            yield from out.add(rows[0][0], [rows[0][1], audit, edited(turns, audit, START if lead else enter)])

    return run


def _joined(kind: pa.DataType):
    """Of each dialogue's row of statistics and pieces, in order, the result."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, audits, digest, empty = Out(kind, RESULT), None, [], hashlib.sha256(), True
        for conv, seg, *stats, audit, text in _rows(batches):
            if seg < 0:
                if now:
                    yield from out.add(now[0], [*now[1], "".join(audits), digest.hexdigest()])
                now, audits, digest, empty = (conv, stats), [], hashlib.sha256(), True
                continue
            audits.append(audit)
            if text:
                digest.update(text.encode() if empty else f"\n{text}".encode())
                empty = False
        if now:
            yield from out.add(now[0], [*now[1], "".join(audits), digest.hexdigest()])
        yield from out.rest()

    return run


def repair_conversations(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per dialogue: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    small_batches(turns.sparkSession)
    key = turns.schema["conv_id"].dataType
    sql = key.simpleString()
    kind = to_arrow_type(key)
    names = [n for n, _ in RESULT]
    order = ["conv_id", "turn", "role", "text"]
    # dealt by the first characters of texts only: ranges are planned on a sample of these on the driver
    dealt = damaged(turns).repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64)).sortWithinPartitions(*order)
    first = written(dealt.select(*order, "n").mapInArrow(_local(kind, segment_rows), _ddl([*RESULT, *ROW], sql)), "dialogues")
    inside = first.where("seg IS NULL").select("conv_id", *names)
    rows = first.where("seg IS NOT NULL").select("conv_id", *(n for n, _ in ROW))
    # the first row of each role and text, told by its place, which is unique
    firsts = rows.where("n > 0").groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("seg", "at")).alias("f")).select("f.seg", "f.at", F.lit(True).alias("first"))
    rows = written(rows.join(firsts, ["seg", "at"], "left").select("conv_id", "seg", "at", "turn", "role", "text", "n", F.coalesce("first", F.lit(False)).alias("first")), "segments")
    by = lambda df, *c: df.repartition(c[0]).sortWithinPartitions(*c)
    summaries = by(rows, "seg", "at").mapInArrow(_summary(kind), _ddl(SUMMARY, sql))
    path = written(by(summaries, "conv_id", "seg").mapInArrow(_fold(kind), _ddl(PATH, sql)), "paths")
    placed = rows.join(path.where("seg >= 0").select("seg", "lead", "enter", "leave"), "seg")
    pieces = by(placed.select("conv_id", "seg", "at", "turn", "role", "text", "n", "first", "lead", "enter", "leave"), "seg", "at").mapInArrow(_pieces(kind), _ddl(PIECE, sql))
    none = F.lit(None).cast("string")
    stats = path.where("seg < 0").select("conv_id", "seg", *STATS, "cost", none.alias("audit"), none.alias("text"))
    void = [F.lit(None).cast("long").alias(c) for c in [*STATS, "cost"]]
    together = stats.union(pieces.select("conv_id", "seg", *void, "audit", "text"))
    return inside.union(by(together, "conv_id", "seg").mapInArrow(_joined(kind), _ddl(RESULT, sql)))
