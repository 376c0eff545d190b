"""Suffix-array dedup: remove every byte covered by a string of LENGTH bytes that also starts earlier.

A minimiser picks one anchor, a string of GRAM bytes, in each window of LENGTH
bytes by content alone, so equal windows have equal anchors at equal places. A
zone is all that the windows with one anchor cover. Only zones whose anchor occurs
twice in the corpus can repeat; they meet by anchor. Where all zones of an anchor are
equal (128 bits of hash), all but the first repeat whole. Where they differ, the
suffix array of the different zones (linear grouping, see suffix_groups.java) tells
which of their windows occur earlier. Equal zones of a block travel once; different
zones of an anchor that occurs in over HOT_BLOCKS blocks and in over one of HOT_SHARE go on
window by window, keyed by the window's own content (128 bits of two independent hashes), so no
anchor gathers more than that many blocks' zones. Windows take several times a zone's bytes, so which anchors
are hot is told by a share of the blocks: a fixed number of blocks is passed by ever more anchors as the input grows.

The input is read twice in the same blocks of texts, so that no block is written; an input that is not a
plain scan of files is written first.

Earlier means smaller key, then (for repeated keys) the place in the table that was
written, then the position.

Defined cases: null text counts as empty; texts shorter than LENGTH lose nothing;
repeated rows and equal texts lose all but the first; strings may overlap; an empty
table gives an empty result; columns of docs other than key and text are ignored,
whatever their names. Keys are integers; a null key comes before every other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mixed, pack_arrays, small_batches, text_blocks, unpack_arrays, utf8_column, written
from .jvm_kernel import call
from .minhash import BASE, BASE_INVERSE, LEVEL_CODES, WORD_CODES
from .quality import plain_scan

LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1
BLOCK = 1 << 20
HOT_BLOCKS, HOT_SHARE = 64, 4
#: Bytes of zones that one suffix array takes at least (whole anchors stay together).
CHUNK = 1 << 20
#: Bytes of the input's files a shard at most, whatever the size of a partition: a shard's keys, and then its zones, meet in one Python worker.
SHARD_BYTES = 16 << 20
#: A place in a block; a text, being a JVM string, has fewer than 2**31 bytes.
PLACE_BITS = np.uint64(32)
#: Names inside the operator, which no column of docs can clash with.
KEY, FIRST = "__key", np.iinfo(np.int64).min
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
#: Of a second hash, independent of the first.
BASE_TWO, BASE_TWO_INVERSE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
BYTES_TWO = mixed(np.arange(1, 257, dtype=np.uint64) * BASE_TWO + LEVEL_CODES[201])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    return np.multiply.accumulate(power, out=power)


def _sums(data: np.ndarray, codes: np.ndarray, base: np.uint64) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * _powers(base, len(data))[:-1], out=sums[1:])
    return sums


class Anchors:
    """Anchors of a block of texts: place, first and last window, row, and hashes of anchor and zone."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        n = len(data)
        self.data, self.ends = data, ends
        if n < LENGTH:
            self.place = self.low = self.high = self.row = np.zeros(0, np.int64)
            self.key = self.zone = np.zeros(0, np.uint64)
            return
        sums, power = _sums(data, BYTES, BASE), _powers(BASE_INVERSE, n)
        code = mixed((sums[GRAM:] - sums[:-GRAM]) * power[: n - GRAM + 1])
        code = (code >> PLACE_BITS) << PLACE_BITS | np.arange(len(code), dtype=np.uint64)
        code = np.concatenate((code, np.full(-len(code) % WINDOW, ~np.uint64(0))))
        rows = code.reshape(-1, WINDOW)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - LENGTH + 1
        place = (np.minimum(behind[:windows], ahead[WINDOW - 1 : WINDOW - 1 + windows]) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        of_row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        inside = of_row[:windows] == of_row[LENGTH - 1 :]
        q = np.flatnonzero(inside)
        place, row = place[q], of_row[q]
        first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])))) if len(q) else q
        self.place, self.low, self.row = place[first], q[first], row[first]
        self.high = self.low + np.diff(np.append(first, len(q))) - 1
        words = data[self.place[:, None] + np.arange(GRAM)].view(np.uint64)
        self.key = mixed((words * WORD_CODES[: GRAM // 8]).sum(1, dtype=np.uint64)) & ~np.uint64(1)
        self._sums, self._inverse = sums, power
        self.zone = self.hashed(self.low, self.high + LENGTH)

    def hashed(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[begin]) * self._inverse[begin] + (end - begin).astype(np.uint64))

    def hashed_again(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A second hash of strings, independent of hashed()."""
        if not len(begin):
            return np.zeros(0, np.uint64)
        sums = _sums(self.data, BYTES_TWO, BASE_TWO)
        return mixed((sums[end] - sums[begin]) * _powers(BASE_TWO_INVERSE, len(self.data))[begin] + (end - begin).astype(np.uint64))


def _read(blob: bytes) -> tuple[pa.Table, np.ndarray, Anchors]:
    block = pa.ipc.open_stream(blob).read_all()
    return block, block.column(KEY).cast(pa.int64()).fill_null(int(FIRST)).to_numpy(), Anchors(*utf8_column(block.column("text")))


def _numbered_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    pid = TaskContext.get().partitionId()
    for seq, block in enumerate(text_blocks(batches, size)):
        yield pid << 32 | seq, block


def _blocks(size: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _numbered_blocks(batches, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(block.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])

    return run


def _anchor_requests(shards: int, size: int):
    """For each block and shard: sorted keys (lowest bit: occurs twice here) and their zones' hashes (lowest bit: zones differ here)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _numbered_blocks(batches, size):
            found = Anchors(*utf8_column(block.column("text")))
            if not len(found.key):
                continue  # no window in this block: it has no answers either
            order = np.lexsort((found.zone, found.key))
            keys, zones = found.key[order], found.zone[order] & ~np.uint64(1)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            last = np.append(first[1:], len(keys)) - 1
            keys, zones = keys[first] | (last > first).astype(np.uint64), zones[first] | (zones[first] != zones[last]).astype(np.uint64)
            shard = (keys >> np.uint64(1)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[p[0]]) for p in parts], pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([zones[p].tobytes() for p in parts], pa.binary())], names=["shard", "block", "keys", "zones"])

    return run


#: Flags of an anchor: it occurs again, in so many blocks that it is hot, with different zones.
AGAIN, HOT, DIFFERENT = 1, 2, 4


def _repeated_anchors(hot_blocks: int, hot_share: int):
    @lean
    def run(asked: pa.Table) -> pa.Table:
        """The flags of each block's anchors, in order."""
        parts = [np.frombuffer(k.as_py(), np.uint64) for k in asked.column("keys")]
        keys, zones = np.concatenate(parts), np.concatenate([np.frombuffer(z.as_py(), np.uint64) for z in asked.column("zones")])
        order = np.argsort(keys >> np.uint64(1), kind="stable")
        bare = keys[order] >> np.uint64(1)
        first = np.flatnonzero(np.concatenate(([True], bare[1:] != bare[:-1])))
        many = np.diff(np.append(first, len(bare)))
        twice = np.maximum.reduceat(keys[order] & np.uint64(1), first) > 0
        low, high = np.minimum.reduceat(zones[order], first), np.maximum.reduceat(zones[order], first)
        differ = (low != high) | (low & np.uint64(1)).astype(bool)
        hot = many > max(hot_blocks, asked.num_rows // hot_share)  # a row a block, so that nearly all blocks are here
        flag = ((many > 1) | twice).astype(np.uint8) * AGAIN | hot.astype(np.uint8) * HOT | differ.astype(np.uint8) * DIFFERENT
        flags = np.zeros(len(keys), np.uint8)
        flags[order] = np.repeat(flag, many)
        out = np.split(flags, np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "flags": pa.array([f.tobytes() for f in out], pa.binary())})

    return run


def _same_split(same: bool) -> None:
    if not same:
        raise RuntimeError("a block of documents was read in another split than before; give the operator a table that was written")


class Zones:
    """The zones of a block that may repeat: places, hashes, and the first of each set of equal ones (in key order)."""

    def __init__(self, found: Anchors, keys: np.ndarray, flags: dict[int, np.ndarray], shards: int) -> None:
        unique = np.unique(found.key)
        shard = ((unique >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)
        flag = np.zeros(len(unique), np.uint8)
        by_shard, many = np.argsort(shard, kind="stable"), np.bincount(shard, minlength=shards)
        upto = np.cumsum(many)
        for s, values in flags.items():
            _same_split(many[s] == len(values))
            flag[by_shard[upto[s] - many[s] : upto[s]]] = values
        flag = flag[np.searchsorted(unique, found.key)] if len(unique) else flag
        flag[flag & AGAIN == 0] = 0
        hot = np.flatnonzero(flag == AGAIN | HOT | DIFFERENT)
        plain = np.flatnonzero((flag > 0) & (flag != AGAIN | HOT | DIFFERENT))
        many = found.high[hot] - found.low[hot] + 1
        each = np.repeat(found.low[hot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.low = np.concatenate((found.low[plain], each)).astype(np.int64)
        self.end = np.concatenate((found.high[plain] + LENGTH, each + LENGTH)).astype(np.int64)
        self.row = np.concatenate((found.row[plain], np.repeat(found.row[hot], many)))
        self.differ = np.concatenate((flag[plain] & DIFFERENT > 0, np.zeros(len(each), bool)))
        content = found.hashed(self.low, self.end) if len(self.low) else np.zeros(0, np.uint64)
        self.key = np.concatenate((found.key[plain], found.hashed_again(self.low[len(plain) :], self.end[len(plain) :])))
        self.doc = keys[self.row] if len(self.row) else np.zeros(0, np.int64)
        order = np.lexsort((self.low, self.doc, content, self.key))
        for name in ("low", "end", "row", "key", "doc", "differ"):
            setattr(self, name, getattr(self, name)[order])
        self.content = content[order]
        self.head = np.concatenate(([True], (self.key[1:] != self.key[:-1]) | (self.content[1:] != self.content[:-1]))) if len(order) else np.zeros(0, bool)
        self.shard = ((self.key >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)
        heads = np.flatnonzero(self.head)
        self._heads, self._upto = heads[np.argsort(self.shard[heads], kind="stable")], np.cumsum(np.bincount(self.shard[heads], minlength=shards))

    def heads(self, shard: int) -> np.ndarray:
        return self._heads[self._upto[shard - 1] if shard else 0 : self._upto[shard]]


def _flags(answers: pa.Table) -> dict[int, np.ndarray]:
    return {s: np.frombuffer(f.as_py(), np.uint8) for s, f in zip(answers.column("shard").to_pylist(), answers.column("flags"), strict=True)}


def _joined(data: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - low
    return data[np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] if len(low) else data[:0]


def _send_zones(shards: int):
    @lean
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "block": [], "zones": []}
        _same_split(bool(texts.num_rows))
        if answers.num_rows:
            _, keys, found = _read(texts.column("texts")[0].as_py())
            zones = Zones(found, keys, _flags(answers), shards)
            for s in np.unique(zones.shard):
                h = zones.heads(s)
                d = h[zones.differ[h]]  # only these need their bytes compared
                sent = pack_arrays(zones.key[h], (zones.end[h] - zones.low[h]).astype(np.uint16), zones.doc[h], zones.low[h].astype(np.uint32), zones.differ[h].astype(np.uint8), zones.content[d], _joined(found.data, zones.low[d], zones.end[d]))
                out["shard"].append(int(s))
                out["block"].append(texts.column("block")[0].as_py())
                out["zones"].append(len(sent).to_bytes(8, "little") + pa.compress(sent, codec="zstd", asbytes=True))
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "block": pa.array(out["block"], pa.int64()), "zones": pa.array(out["zones"], pa.binary())})

    return run


CHUNKS = "shard int, text binary, owner binary, copies binary"


@lean
def _zone_texts(sent: pa.Table) -> pa.Table:
    """Texts of different zones of one anchor, first occurrences first, and which zones are mere copies."""
    shard, blocks = sent.column("shard")[0].as_py(), sent.column("block").to_numpy()
    blobs = [z.as_py() for z in sent.column("zones")]
    parts = [unpack_arrays(pa.decompress(z[8:], int.from_bytes(z[:8], "little"), codec="zstd", asbytes=True)) for z in blobs]
    key, length, doc, low, differ = (np.concatenate([p[i] for p in parts]) for i in range(5))
    length, differ = length.astype(np.int64), differ.astype(bool)
    content = np.zeros(len(key), np.uint64)
    content[differ] = np.concatenate([p[5] for p in parts])
    data = np.concatenate([p[6] for p in parts])
    begin = np.cumsum(length * differ) - length * differ
    block = np.repeat(blocks, [len(p[0]) for p in parts])
    index = np.concatenate([np.arange(len(p[0])) for p in parts])
    order = np.lexsort((low, block, doc, content, key))
    same = np.concatenate(([False], (key[order][1:] == key[order][:-1]) & (content[order][1:] == content[order][:-1])))
    copies, first = order[same], order[~same]
    first = first[differ[first]]
    first = first[np.lexsort((low[first], block[first], doc[first], key[first]))]
    if len(first):
        starts = np.flatnonzero(np.concatenate(([True], key[first][1:] != key[first][:-1])))
        several = np.diff(np.append(starts, len(first)))
        first = first[np.repeat(several, several) > 1]
    rows: list[tuple[bytes, bytes, bytes]] = [(b"", b"", pack_arrays(block[copies], index[copies], length[copies]))] if len(copies) else []
    if len(first):
        group = np.concatenate(([0], np.cumsum(key[first][1:] != key[first][:-1])))
        upto = np.cumsum(length[first] + 1)
        cut = np.flatnonzero(np.concatenate(([False], group[1:] != group[:-1])))
        held = [0]
        for c in cut:
            if upto[c - 1] - (upto[held[-1] - 1] if held[-1] else 0) >= CHUNK:
                held.append(int(c))
        for f in np.split(first, held[1:]):
            body = np.full(int((length[f] + 1).sum()), 255, np.uint8)
            to = np.cumsum(length[f] + 1) - length[f] - 1
            body[np.repeat(to - (np.cumsum(length[f]) - length[f]), length[f]) + np.arange(length[f].sum())] = _joined(data, begin[f], begin[f] + length[f])
            rows.append((body.tobytes(), pack_arrays(block[f], index[f], length[f], to), b""))
    fields = pa.schema({"shard": pa.int32(), "text": pa.binary(), "owner": pa.binary(), "copies": pa.binary()})
    return pa.Table.from_batches([pa.record_batch([[shard], *([x] for x in r)], schema=fields) for r in rows], fields)  # a batch each, as they are large


@lean
def _earlier_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block: its zones (by number in the shard) and a bit for each window that occurs earlier."""
    for batch in batches:
        for shard, owner, copies, marks in zip(batch.column("shard").to_pylist(), batch.column("owner"), batch.column("copies"), batch.column("marks"), strict=True):
            if copies.as_py():
                block, index, length = unpack_arrays(copies.as_py())
                bits = np.ones(int((length - LENGTH + 1).sum()), np.uint8)
            else:
                block, index, length, to = unpack_arrays(owner.as_py())
                bits = _joined(np.unpackbits(np.frombuffer(marks.as_py(), np.uint8), bitorder="little"), to, to + length - LENGTH + 1)
            windows = length - LENGTH + 1
            begin = np.cumsum(windows) - windows
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                mine = np.packbits(_joined(bits, begin[part], begin[part] + windows[part]), bitorder="little")
                yield pa.RecordBatch.from_arrays([pa.array([int(block[part[0]])], pa.int64()), pa.array([shard], pa.int32()), pa.array([pack_arrays(index[part], windows[part], mine)], pa.binary())], names=["block", "shard", "flags"])


def _apply(shards: int, carry: list[str], as_text: bool):
    @lean
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """answers: rows of anchor flags (kind 0) and of windows that occur earlier (kind 1)."""
        _same_split(bool(texts.num_rows))
        block, keys, found = _read(texts.column("texts")[0].as_py())
        kind = np.array(answers.column("kind").to_pylist(), np.int64)
        data, ends = found.data, found.ends
        step = np.zeros(len(data) + 1, np.int32)
        if len(found.key):
            zones = Zones(found, keys, _flags(answers.filter(pa.array(kind == 0))), shards)
            windows = zones.end - zones.low - LENGTH + 1
            begin = np.cumsum(windows) - windows
            earlier = np.repeat(~zones.head, windows)
            told = answers.filter(pa.array(kind == 1))
            for s, blob in zip(told.column("shard").to_pylist(), told.column("flags"), strict=True):
                index, many, bits = unpack_arrays(blob.as_py())
                at = zones.heads(s)[index]
                bits = np.unpackbits(bits, bitorder="little")[: int(many.sum())].astype(bool)
                earlier[np.repeat(begin[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())] |= bits
            q = (np.repeat(zones.low - begin, windows) + np.arange(windows.sum()))[earlier]
            np.add.at(step, q, 1)
            np.add.at(step, q + LENGTH, -1)
        gone = np.cumsum(step[:-1]) > 0
        upto = np.concatenate(([0], np.cumsum(gone)))
        opens = gone & ~np.concatenate(([False], gone[:-1]))
        opens[ends[:-1][ends[:-1] < len(gone)]] = gone[ends[:-1][ends[:-1] < len(gone)]]
        spans = np.concatenate(([0], np.cumsum(opens)))
        kept = data[~gone]
        kept_ends = ends - upto[ends]
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(kept_ends.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())])
        more = {c: block.column(c) for c in carry}
        texts_kept = {} if not as_text else {"text": pa.array([kept[s:e].tobytes().decode(errors="ignore") for s, e in zip(kept_ends[:-1], kept_ends[1:], strict=True)], pa.string())}
        return pa.table({KEY: block.column(KEY), **more, "n_bytes": pa.array(np.diff(ends)), "n_removed": pa.array(np.diff(upto[ends])), "n_spans": pa.array(np.diff(spans[ends])), "kept": column.cast(pa.binary()), **texts_kept})

    return run


def shards_of(rows: DataFrame) -> int:
    """How many shards keys are dealt over: by the bytes of the table, as its partitions may be of any size."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, rows._jdf.rdd().getNumPartitions(), -(-size // SHARD_BYTES) if size < 1 << 50 else 0)  # more: not known


def _repeats(docs: DataFrame, key: str, carry: list[str], as_text: bool) -> DataFrame:
    """Per row: KEY, the columns carry by number, n_bytes, n_removed, n_spans, kept and, if asked for, kept as text without incomplete characters."""
    spark = docs.sparkSession
    small_batches(spark)
    numbers = [f"__{i}" for i in range(len(carry))]
    rows = docs.select(F.col(f"`{key}`").alias(KEY), "text", *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, numbers, strict=True)))
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [KEY, *numbers])
    plain = plain_scan(docs)
    rows = rows if plain else written(rows, "documents")
    shards = shards_of(docs if plain else rows)  # a Project's size is guessed by its types
    blocks = rows.mapInArrow(_blocks(BLOCK), "block long, texts binary")
    asked = rows.mapInArrow(_anchor_requests(shards, BLOCK), "shard int, block long, keys binary, zones binary")
    flags = written(asked.groupBy("shard").applyInArrow(_repeated_anchors(HOT_BLOCKS, HOT_SHARE), "block long, shard int, flags binary"), "anchor-flags")
    sent = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_send_zones(shards), "shard int, block long, zones binary")
    chunks = sent.groupBy("shard").applyInArrow(_zone_texts, CHUNKS)
    sorted_chunks = chunks.withColumn("marks", F.unbase64(call(spark, "SuffixGroups", "suffix_groups.java", "repeats", F.base64("text"), F.lit(LENGTH))))
    told = sorted_chunks.mapInArrow(_earlier_windows, "block long, shard int, flags binary")
    answers = flags.withColumn("kind", F.lit(0)).unionByName(told.withColumn("kind", F.lit(1)))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_apply(shards, numbers, as_text), f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary" + ", text string" * as_text)


def remove_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans (maximal runs removed) and kept, the bytes that stay."""
    return _repeats(docs, key, [], False).withColumnRenamed(KEY, key)


def substring_dedup(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with what remove_repeats() keeps as their text; all columns as before, n_chars made anew.

    Characters that a cut left incomplete go; documents with nothing left go, unless they were empty before.
    """
    carry = [c for c in docs.columns if c not in (key, "text")]
    kept = _repeats(docs, key, carry, True).where("n_removed = 0 OR octet_length(text) > 0")
    was = {key: KEY, "text": "text"} | {c: f"__{i}" for i, c in enumerate(carry)}
    made = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in carry else {}
    return kept.select(*(made.get(c, F.col(was[c])).alias(c) for c in docs.columns))
