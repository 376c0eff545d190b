"""Byte-level BPE encoding and decoding by a contiguous rank array.

Text is cut at special tokens, then by the byte-level pattern into words. A word
is an array of parts beside an array of the ranks of adjacent pairs: scan for the
smallest rank, delete that boundary, refresh the two ranks next to it (see
rank_arrays.java, which also tells what is done with long words). Each thread
remembers a fixed number of encoded words.

The vocabulary file's path is a parameter; the driver turns it into one table,
which the executors fetch as a jar (a vocabulary's size does not depend on the
data).

Defined cases: null text counts as empty and has no ids; repeated rows are rows of
their own; an empty table gives an empty result; columns of docs other than the
named key and text are ignored; a text of over half a billion tokens is an error.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache
from itertools import groupby

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jvm_kernel import call

#: The kinds of characters that the byte-level pattern tells apart; all others are of kind 0.
KINDS = [(1, regex.compile(r"\p{L}")), (2, regex.compile(r"\p{N}")), (3, regex.compile(r"\s"))]


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def character_kinds() -> bytes:
    """Runs (first, end, kind) of code points that are letters, numbers or blanks."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    kind = {m.group(): k for k, pattern in KINDS for m in pattern.finditer(every)}
    runs = []
    for _, run in groupby(enumerate(sorted(kind)), lambda x: (ord(x[1]) - x[0], kind[x[1]])):
        held = [c for _, c in run]
        runs.append(struct.pack(">iib", ord(held[0]), ord(held[-1]) + 1, kind[held[0]]))
    return struct.pack(">i", len(runs)) + b"".join(runs)


@lru_cache(maxsize=2)
def vocabulary_table(source: bytes) -> tuple[str, bytes]:
    """Name and content of the table that RankArrays reads, from the JSON of a byte-level BPE tokenizer."""
    spec = json.loads(source)
    model, of_char = spec["model"], byte_characters()
    ids, added = model["vocab"], [(t["content"].encode(), t["id"]) for t in spec["added_tokens"]]
    tokens = [b""] * (max([*ids.values(), *(i for _, i in added)]) + 1)
    for token, i in ids.items():
        tokens[i] = bytes(of_char[c] for c in token)
    for content, i in added:
        tokens[i] = content
    byte_ids = [0] * 256
    for c, b in of_char.items():
        byte_ids[b] = ids[c]
    pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
    strings = lambda all_: struct.pack(">i", len(all_)) + b"".join(struct.pack(">i", len(s)) + s for s in all_)
    table = b"".join([
        struct.pack(">256i", *byte_ids),
        strings(tokens),
        strings([content for content, _ in added]),
        struct.pack(f">{len(added)}i", *(i for _, i in added)),
        struct.pack(">i", len(pairs)),
        *(struct.pack(">iii", ids[a], ids[b], ids[a + b]) for a, b in pairs),
        character_kinds(),
    ])
    return f"vocabulary-{hashlib.sha256(table).hexdigest()[:32]}.bin", table


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _kernel(spark: SparkSession, path: str, method: str, column: Column) -> Column:
    name, table = vocabulary_table(vocabulary(path))
    return call(spark, "RankArrays", "rank_arrays.java", method, column, F.lit(name), data={name: table})


def encoded(spark: SparkSession, path: str, text: Column) -> Column:
    """Ids of a text (binary, little-endian unsigned 32-bit); null counts as empty."""
    return F.unbase64(_kernel(spark, path, "encode", F.coalesce(text, F.lit(""))))


def decoded(spark: SparkSession, path: str, ids: Column) -> Column:
    """The text of ids; bytes that are not valid UTF-8 become replacement characters."""
    return _kernel(spark, path, "decode", F.base64(ids))


def with_ids(docs: DataFrame, path: str, key: str = "doc_id", decode: bool = False) -> DataFrame:
    """Per row of docs: key, ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded (the ids' text)."""
    spark = docs.sparkSession
    rows = docs.select(key, encoded(spark, path, F.col("text")).alias("ids"))
    return rows.withColumn("decoded", decoded(spark, path, F.col("ids"))) if decode else rows
