"""Media columns: signature sniffing, validation, carving, and a lossless 8-bit store.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass; each
hit is confirmed by that format's validator, which walks the structure and returns
where the medium ends. A medium at 0 corrects the declared type; confirmed media
inside other data are carved out.

The store writes a text's bytes as 8-bit mono PCM samples of a RIFF/WAVE file and
reads them back through the sniffer.

Defined cases: null text counts as empty (one padding frame); null data are empty
and of type None; equal data give equal values; repeated rows are rows of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Payloads are padded with PAD to a positive multiple of FRAME bytes.
FRAME, PAD = 576, b"\xff"
SAMPLE_RATE = 8000
OUT_BYTES = 8 << 20


def _wav_end(b: bytes, at: int) -> int | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, pos, kinds = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, []
    if end > len(b):
        return None
    while pos + 8 <= end:
        kinds.append(b[pos : pos + 4])
        pos += 8 + (n := struct.unpack_from("<I", b, pos + 4)[0]) + n % 2
    return end if pos == end and kinds[:1] == [b"fmt "] and b"data" in kinds else None


def _png_end(b: bytes, at: int) -> int | None:
    pos = at + 8
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or (pos == at + 8) != (kind == b"IHDR") or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos += 12 + n
        if kind == b"IEND":
            return pos
    return None


def _bmp_end(b: bytes, at: int) -> int | None:
    if len(b) < at + 30:
        return None
    size, _, data, head = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    fits = 26 <= data <= size <= len(b) - at and head in (12, 40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return at + size if fits else None


def _gif_end(b: bytes, at: int) -> int | None:
    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        return pos + 1

    if len(b) < at + 13:
        return None
    pos = at + 13 + (3 * (2 << (b[at + 10] & 7)) if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos = blocks(pos + 11 + (3 * (2 << (b[pos + 9] & 7)) if b[pos + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg_end(b: bytes, at: int) -> int | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind = b[pos + 1]
        if kind == 0xFF:
            pos += 1
        elif kind == 0xDA:  # entropy-coded data, up to a marker that isn't stuffing or a restart
            pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0 or pos + 1 >= len(b):
                return None
            if b[pos + 1] == 0xD9:
                return pos + 2
        elif kind in (0x00, 0x01, 0xD8, 0xD9):
            return None
        else:
            pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
    return None


@dataclass(frozen=True)
class Format:
    media_type: str
    magic: bytes
    end: Callable[[bytes, int], int | None]


#: Signatures of public formats.
FORMATS = [
    Format("audio/wav", b"RIFF", _wav_end),
    Format("image/png", b"\x89PNG\r\n\x1a\n", _png_end),
    Format("image/gif", b"GIF87a", _gif_end),
    Format("image/gif", b"GIF89a", _gif_end),
    Format("image/jpeg", b"\xff\xd8\xff", _jpeg_end),
    Format("image/bmp", b"BM", _bmp_end),
]


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for f in FORMATS:
        found.add_word(f.magic.decode("latin-1"), f)
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """Confirmed media in data as (type, start, end), in order; one inside a confirmed one comes after it.

    A validator reads a medium once; hits inside a medium already confirmed by the same
    format at the same end are its own content and not reported again.
    """
    found: list[tuple[str, int, int]] = []
    ends: set[tuple[str, int]] = set()
    for last, f in _automaton().iter(data.decode("latin-1")):
        start = last - len(f.magic) + 1
        if (end := f.end(data, start)) is not None and (f.media_type, end) not in ends:
            found.append((f.media_type, start, end))
            ends.add((f.media_type, end))
    return found


def wav_bytes(payload: bytes) -> bytes:
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wav_samples(media: bytes) -> bytes:
    """The bytes of the data chunk of a confirmed WAVE file with 8-bit mono samples."""
    pos = 12
    while media[pos : pos + 4] != b"data":
        pos += 8 + (n := struct.unpack_from("<I", media, pos + 4)[0]) + n % 2
    return media[pos + 8 : pos + 8 + struct.unpack_from("<I", media, pos + 4)[0]]


def sample_feature(payload: bytes) -> str:
    """Integer statistics of 8-bit samples: count, sum, sum of squares, sign changes about 128, and a 16-bin histogram."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    high = x >= 128
    bins = ",".join(map(str, counts.reshape(16, 16).sum(1)))
    return f"n={len(x)};sum={int(counts @ values)};sq={int(counts @ (values * values))};turns={int(np.count_nonzero(high[1:] != high[:-1]))};hist={bins}"


def _emit(names: list[str], kinds: list[pa.DataType], rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=names)


def store_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes (of the text), declared (nothing known) and media, the stored WAVE file."""
    rows = docs.select(key, "text")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k, text in zip(batch.column(key), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                media = wav_bytes(raw + PAD * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)))
                out.append([k.as_py(), len(raw), "application/octet-stream", media])
                size += len(media)
                if size >= OUT_BYTES:
                    yield _emit(["key", "n_bytes", "declared", "media"], [batch.schema.field(key).type, pa.int64(), pa.string(), pa.binary()], out)
                    out, size = [], 0
            if out:
                yield _emit(["key", "n_bytes", "declared", "media"], [batch.schema.field(key).type, pa.int64(), pa.string(), pa.binary()], out)

    return rows.mapInArrow(run, f"key {kind}, n_bytes long, declared string, media binary").withColumnRenamed("key", key)


def read_media(media: DataFrame, key: str = "doc_id", carve: bool = False) -> DataFrame:
    """Sniff each row's media: key, n_bytes, declared, media, media_type (corrected), payload, feature, n_embedded and, if asked for, carved.

    payload and feature are of 8-bit WAVE files, else null; carved holds the media found inside.
    """
    rows = media.select(key, "n_bytes", "declared", "media")
    names = [key, "n_bytes", "declared", "media", "media_type", "payload", "feature", "n_embedded", *["carved"] * carve]
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, n_bytes long, declared string, media binary, media_type string, payload binary, feature string, n_embedded long" + ", carved array<binary>" * carve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(key).type, pa.int64(), pa.string(), pa.binary(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.binary())][: len(names)]
            out, size = [], 0
            for row in zip(*(batch.column(c) for c in (key, "n_bytes", "declared", "media")), strict=True):
                k, n, declared, data = (x.as_py() for x in row)
                found = sniff(data or b"")
                whole = next((m for m in found if m[1] == 0), None)
                payload = wav_samples(data) if whole and whole[0] == "audio/wav" else None
                inside = [data[s:e] for _, s, e in found if s]
                out.append([k, n, declared, data, whole[0] if whole else declared if data else None, payload, None if payload is None else sample_feature(payload), len(inside), *[inside] * carve])
                size += len(data or b"") + len(payload or b"")
                if size >= OUT_BYTES:
                    yield _emit(names, kinds, out)
                    out, size = [], 0
            if out:
                yield _emit(names, kinds, out)

    return rows.mapInArrow(run, schema)
