"""n-grams and hashes of token arrays, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once; an inner lambda would work out what it closes over for every element."""
    return F.aggregate(F.array(F.lit(0)), value, lambda held, _: held, f)


def _windows(tokens: Column, n: int, separator: str) -> Column:
    if n == 1:
        return F.when(F.size(tokens) > 0, F.transform(tokens, lambda t: F.coalesce(t, F.lit("")))).otherwise(F.array(F.lit("")))
    # a token past the end is null and left out, and no slice is made for each place
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: F.concat_ws(separator, *(F.get(tokens, i + k) for k in range(n))))


def strict_ngrams(tokens: Column, n: int = 4, separator: str = " ") -> Column:
    """All n-grams; none if there are fewer than n tokens."""
    none = F.array().cast("array<string>")
    return bound(tokens, lambda t: F.when(F.size(t) >= n, _windows(t, n, separator)).otherwise(none))


def padded_ngrams(tokens: Column, n: int, separator: str = " ") -> Column:
    """All n-grams; the whole text as one if there are fewer than n tokens."""
    return bound(tokens, lambda t: _windows(t, n, separator))


def repeated(tokens: Column) -> Column:
    """All occurrences of the tokens that an array has more than once."""
    return bound(F.array_sort(tokens), lambda t: F.filter(t, lambda x, i: (x == F.get(t, i - 1)) | (x == F.get(t, i + 1))))


def counted(tokens: Column) -> Column:
    """(term, count) of each different token of an array, in one row's own memory."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0))), lambda i: (i < F.size(t)) & ((i == 0) | (F.get(t, i) != F.get(t, i - 1))))
        return bound(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - i).cast("long").alias("count"))))

    return bound(F.sort_array(F.filter(tokens, lambda x: x.isNotNull())), runs)


def character_ngrams(text: Column, n: int) -> Column:
    """n-grams of characters without blanks."""
    return padded_ngrams(F.split(F.replace(text, F.lit(" ")), ""), n, "")


def alnum_tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[^0-9a-zA-Z]+"), lambda t: t != "")


def orders_ngrams(tokens: Column, order: int = 1, marked_once: bool = True, separator: str = "#") -> Column:
    """n-grams of orders 1 to order; with sentence marks around all orders (once), or around each order over 1."""

    def grams(words: Column) -> Column:
        marked = F.concat(F.array(F.lit("<s>")), words, F.array(F.lit("</s>")))
        return F.concat(*(strict_ngrams(marked if marked_once or n > 1 else words, n, separator) for n in range(1, order + 1)))

    return bound(tokens, grams)


#: Bytes of the map of bits that is made of some lists at once.
BITMAP = 1 << 24


def _bit_lists(lists: pa.Array, bits: np.ndarray, size: int) -> pa.Array:
    """The different bits of each list, in order; bits has a row of them for each element."""
    upto = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    row, n, step = np.repeat(np.arange(len(lists)), np.diff(upto)), len(lists), max(1, BITMAP // size)
    found = [np.zeros(0, np.int64)]
    for low in range(0, n, step):
        part, seen = slice(upto[low], upto[min(low + step, n)]), np.zeros(min(step, n - low) * size, bool)
        seen[((row[part] - low)[:, None] * size + bits[part]).ravel()] = True
        found.append(np.flatnonzero(seen) + low * size)
    held = np.concatenate(found)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(held, np.arange(n + 1) * size), pa.int32()), pa.array(held % size, pa.int32()), mask=lists.is_null())


def _remainders(digests: list[bytes], size: int) -> np.ndarray:
    """160-bit numbers mod size, 32 bits at a time."""
    rest = np.zeros(len(digests), np.uint64)
    for part in np.frombuffer(b"".join(digests), ">u4").reshape(-1, 5).T:
        rest = (rest << np.uint64(32) | part) % np.uint64(size)
    return rest.astype(np.int64)


def _salted_bits(words: pa.Array, salts: list[str], size: int) -> pa.Array:
    import hashlib

    coded = words.flatten().dictionary_encode()  # each word of the batch is hashed once
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    table = np.stack([_remainders([hashlib.sha1(salt + w).digest() for w in known], size) for salt in (s.encode() for s in salts)], axis=1)
    return _bit_lists(words, table[coded.indices.to_numpy(zero_copy_only=False)], size)


def sha1_buckets(words: pd.Series, salts: list[str], size: int) -> pd.Series:
    return pd.Series(_salted_bits(pa.array(words, pa.list_(pa.string())), salts, size).to_pylist())


def sha1_features(size: int = 1000, salts: list[str] | None = None) -> Callable[[Column], Column]:
    """Set bits of a salted SHA-1 bit vector of the words (exact 160-bit remainders, so an Arrow-batched function)."""
    salts = salts or [""]

    def features(words: pa.Array) -> pa.Array:
        return _salted_bits(words, salts, size)

    return F.arrow_udf(features, "array<int>")


def double_hash_features(words: Column, n: int, size: int) -> Column:
    """Set bits by double hashing, (h1 + s * h2) mod size, with two seeds of the built-in 64-bit hash; bits meet in a map of a batch's lists."""

    def features(packed: pa.Array) -> pa.Array:
        a, b = np.divmod(packed.flatten().to_numpy(zero_copy_only=False), size)
        return _bit_lists(packed, (a[:, None] + np.arange(n) * b[:, None]) % size, size)

    pair = lambda w: F.pmod(F.xxhash64(w), F.lit(size)) * size + F.pmod(F.xxhash64(F.lit("x"), w), F.lit(size))
    return F.arrow_udf(features, "array<int>")(F.transform(words, pair))


def simhash(features: Column) -> Column:
    """64-bit simhash: each bit is set if most feature hashes have it; ties count as not set."""

    def bits(hashes: Column) -> Column:
        ones = lambda b: F.size(F.filter(hashes, lambda h: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)) == 1))
        one = F.lit(1).cast("long")
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: F.when(2 * ones(b) > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", one, b))).otherwise(acc))

    return bound(F.transform(features, lambda f: F.xxhash64(f)), bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
