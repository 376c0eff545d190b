"""Extractors times ratios: a registry that turns names into one plan over a table of pairs.

An extractor makes tokens of a document (a column of strings from its columns); a ratio is a formula of what two
multisets have alone and in common. Any name of the one goes with any of the other, and new ones are added by name.
All combinations asked for come from one plan: where each document is one row, a pair meets its two documents' columns, and
each extractor's tokens become a row of numbers in batches of pairs, so that no table of tokens is shuffled or written;
documents of several rows are counted in such a table. Documents without pairs are not read far.
Null and blank tokens don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ngrams
from ..functions import text as T
from .lineage import cut, small_batches
from .terms import one_row_each


@dataclass(frozen=True)
class Stats:
    """Of a pair and extractor: different tokens of each side and in common, all tokens, sums of squared counts, of the smaller counts and of the products."""

    kinds_a: Column
    kinds_b: Column
    common: Column
    size_a: Column
    size_b: Column
    squares_a: Column
    squares_b: Column
    smaller: Column
    product: Column


STATS = [f.name for f in fields(Stats)]


def token_stats(a: pa.Array, b: pa.Array) -> pa.Array:
    """STATS of each pair of token lists, as whole numbers."""
    n, lists = len(a), (a, b)
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    # number of a pair times different tokens, plus that of the token; null and blank ones go
    blank = pc.equal(pc.utf8_trim(coded.dictionary, " "), "").to_numpy(zero_copy_only=False)
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = np.append(~blank.astype(bool), False)[codes]
    many = [pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False) for x in lists]
    found, at = [], 0
    for each in many:
        upto = at + int(each.sum())
        key = (np.repeat(np.arange(n), each) * kinds + codes[at:upto])[kept[at:upto]]
        found.append(np.unique(key, return_counts=True))
        at = upto
    (keys_a, n_a), (keys_b, n_b) = found
    both, in_a, in_b = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)

    def of_pair(key: np.ndarray, value: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(value)))
        cut = np.searchsorted(key, np.arange(n + 1) * kinds)
        return total[cut[1:]] - total[cut[:-1]]

    one = np.ones_like
    values = dict(
        kinds_a=of_pair(keys_a, one(n_a)), kinds_b=of_pair(keys_b, one(n_b)), common=of_pair(both, one(in_a)), size_a=of_pair(keys_a, n_a), size_b=of_pair(keys_b, n_b),
        squares_a=of_pair(keys_a, n_a * n_a), squares_b=of_pair(keys_b, n_b * n_b), smaller=of_pair(both, np.minimum(n_a[in_a], n_b[in_b])), product=of_pair(both, n_a[in_a] * n_b[in_b]),
    )
    return pa.StructArray.from_arrays([pa.array(values[s].astype(np.int64)) for s in STATS], STATS)


Extractor = Callable[[], Column]
Ratio = Callable[[Stats], Column]


def _over(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def _words() -> Column:
    return F.filter(F.split(F.col("text"), r"\s+"), lambda t: t != "")


EXTRACTORS: dict[str, Extractor] = {
    "words": _words,
    "bigrams": lambda: ngrams.padded_ngrams(_words(), 2),
    "wordpunct": lambda: T.wordpunct_tokens(F.col("text")),
    "lines": lambda: F.filter(F.split(F.col("text"), "\n"), lambda t: F.trim(t) != ""),
}
RATIOS: dict[str, Ratio] = {
    "jaccard": lambda s: _over(s.common, s.kinds_a + s.kinds_b - s.common),
    "dice": lambda s: _over(2 * s.common, s.kinds_a + s.kinds_b, 1.0),
    "weighted_jaccard": lambda s: _over(s.smaller, s.size_a + s.size_b - s.smaller),
    "legacy_cosine": lambda s: _over(s.product, s.squares_a + s.squares_b),
    "cosine": lambda s: _over(s.product, F.sqrt(s.squares_a) * F.sqrt(s.squares_b)),
    "quick": lambda s: _over(2 * s.smaller, s.size_a + s.size_b, 1.0),
    "size": lambda s: _over(F.least(s.size_a, s.size_b), F.greatest(s.size_a, s.size_b)),
}


@dataclass(frozen=True)
class Registry:
    extractors: dict[str, Extractor] = field(default_factory=lambda: dict(EXTRACTORS))
    ratios: dict[str, Ratio] = field(default_factory=lambda: dict(RATIOS))

    def scored(self, pairs: DataFrame, docs: DataFrame, asked: Iterable[tuple[str, str]], key: str = "doc_id") -> DataFrame:
        """pairs (src_id, tgt_id, distinct) with a column extractor_ratio for each of asked; a pair whose document is missing has what empty documents have."""
        asked = list(dict.fromkeys(asked))
        if unknown := [n for e, r in asked for n, known in ((e, self.extractors), (r, self.ratios)) if n not in known]:
            raise KeyError(f"not registered: {unknown}")
        used = list(dict.fromkeys(e for e, _ in asked))
        wanted = cut(pairs.select("src_id", "tgt_id").distinct())
        needed = wanted.select(F.explode(F.array("src_id", "tgt_id")).alias(key)).distinct()
        mine = docs.join(needed, key, "left_semi")
        if one_row_each(docs, [key]):
            return self._scored_in_rows(wanted, mine, asked, used, key)
        tokens = mine.select(key, F.explode(F.array(*(F.struct(F.lit(e).alias("by"), self.extractors[e]().alias("t")) for e in used))).alias("x"))
        counts = cut(tokens.select(F.col(key).alias("id"), "x.by", F.explode("x.t").alias("token")).where("trim(token) <> ''").groupBy("id", "by", "token").agg(F.count(F.lit(1)).alias("n")))
        alone = counts.groupBy("id", "by").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), *(F.col(c) if c in ("by", "token") else F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "id"))
        meet = wanted.join(side(counts, "src"), "src_id").join(side(counts, "tgt"), ["tgt_id", "by", "token"])
        both = meet.groupBy("src_id", "tgt_id", "by").agg(F.count(F.lit(1)).alias("common"), F.sum(F.least("n_src", "n_tgt")).alias("smaller"), F.sum(F.col("n_src") * F.col("n_tgt")).alias("product"))
        rows = wanted.withColumn("by", F.explode(F.array(*map(F.lit, used))))
        rows = rows.join(side(alone, "src"), ["src_id", "by"], "left").join(side(alone, "tgt"), ["tgt_id", "by"], "left").join(both, ["src_id", "tgt_id", "by"], "left").na.fill(0)
        stats = Stats(*(F.col(c).cast("double") for c in ("kinds_src", "kinds_tgt", "common", "size_src", "size_tgt", "squares_src", "squares_tgt", "smaller", "product")))
        each = {r: self.ratios[r](stats) for _, r in asked}
        columns = [F.max(F.when(F.col("by") == e, each[r])).alias(f"{e}_{r}") for e, r in asked]
        return rows.groupBy("src_id", "tgt_id").agg(*columns)

    def _scored_in_rows(self, wanted: DataFrame, docs: DataFrame, asked: list[tuple[str, str]], used: list[str], key: str) -> DataFrame:
        small_batches(docs.sparkSession)
        held = {c: f"__src_{c}" for c in docs.columns}  # of the first document, while the second's tokens are made
        first = docs.select(*(F.col(f"`{c}`").alias(h) for c, h in held.items()))
        ids = wanted.select(F.col("src_id").alias("__src"), F.col("tgt_id").alias("__tgt"))
        rows = ids.join(first, F.col("__src") == F.col(f"`{held[key]}`"), "left").join(docs, F.col("__tgt") == F.col(f"`{key}`"), "left")
        rows = rows.select("__src", "__tgt", *(F.col(f"`{h}`") for h in held.values()), *(self.extractors[e]().alias(f"__b{i}") for i, e in enumerate(used)))
        rows = rows.select("__src", "__tgt", *(f"__b{i}" for i in range(len(used))), *(F.col(f"`{h}`").alias(c) for c, h in held.items()))
        rows = rows.select("__src", "__tgt", *(f"__b{i}" for i in range(len(used))), *(self.extractors[e]().alias(f"__a{i}") for i, e in enumerate(used)))
        many = len(used)

        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [token_stats(batch.column(f"__a{i}"), batch.column(f"__b{i}")) for i in range(many)]
                yield pa.RecordBatch.from_arrays([batch.column("__src"), batch.column("__tgt"), *found], names=["__src", "__tgt", *(f"__x{i}" for i in range(many))])

        each = ", ".join(f"{s}: bigint" for s in STATS)
        kinds = (f"{c} {ids.schema[c].dataType.simpleString()}" for c in ids.columns)
        rows = rows.mapInArrow(numbers, ", ".join([*kinds, *(f"__x{i} struct<{each}>" for i in range(many))]))
        stats = {e: Stats(*(F.col(f"__x{i}.{s}").cast("double") for s in STATS)) for i, e in enumerate(used)}
        return rows.select(F.col("__src").alias("src_id"), F.col("__tgt").alias("tgt_id"), *(self.ratios[r](stats[e]).alias(f"{e}_{r}") for e, r in asked))


def all_of(registry: Registry) -> list[tuple[str, str]]:
    return [(e, r) for e in registry.extractors for r in registry.ratios]


def combined(scores: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """scores with a weighted sum of some of their columns."""
    return scores.withColumn(name, reduce(lambda a, b: a + b, (F.col(c) * w for c, w in weights.items()), F.lit(0.0)))
