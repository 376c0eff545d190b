"""Similarities of two token arrays: set and multiset ones as expressions, sequence ones as Arrow-batched functions."""

from __future__ import annotations

import difflib
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def counted(tokens: Column) -> Column:
    """Token array to a map of counts."""
    kinds = F.array_distinct(tokens)
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(tokens, lambda t: t == k))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _count(counts: Column, key: Column) -> Column:
    return F.coalesce(F.element_at(counts, key), F.lit(0))


def weighted_jaccard(a: Column, b: Column, weights: Column | None = None) -> Column:
    """Sum of weighted smaller counts over sum of weighted larger counts; a, b: maps of counts, weights: map."""
    w = lambda t: F.coalesce(F.element_at(weights, t), F.lit(0.0)) if weights is not None else F.lit(1.0)
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    num = _sum(F.transform(keys, lambda t: w(t) * F.least(_count(a, t), _count(b, t))))
    return F.when(num > 0, num / _sum(F.transform(keys, lambda t: w(t) * F.greatest(_count(a, t), _count(b, t))))).otherwise(F.lit(0.0))


def legacy_cosine(a: Column, b: Column, weights: Column | None = None) -> Column:
    """Dot product over the sum of both squared norms: 0.5 for identical texts."""
    w = lambda t: F.coalesce(F.element_at(weights, t), F.lit(0.0)) if weights is not None else F.lit(1.0)
    square = lambda m: _sum(F.transform(F.map_keys(m), lambda t: (_count(m, t) * w(t)) * (_count(m, t) * w(t))))
    num = _sum(F.transform(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda t: _count(a, t) * _count(b, t) * w(t) * w(t)))
    return F.when(num > 0, num / (square(a) + square(b))).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def quick_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Upper bound of the sequence ratio: twice the common multiset over the total length.

    Arrow-batched: as an expression the counts are made anew for every token.
    """
    both = (sum((Counter(x) & Counter(y)).values()) for x, y in zip(a, b, strict=True))
    return pd.Series([2.0 * n / (len(x) + len(y)) if len(x) + len(y) else 1.0 for n, x, y in zip(both, a, b, strict=True)], dtype="float64")


def real_quick_ratio(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.size(a), F.size(b)) / total)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2M/T by longest matching blocks. Equal pairs of a batch are worked out once."""
    known: dict[tuple, float] = {}
    keys = [(tuple(x), tuple(y)) for x, y in zip(a, b, strict=True)]
    for x, y in keys:
        if (x, y) not in known:
            known[x, y] = difflib.SequenceMatcher(None, x, y).ratio()
    return pd.Series([known[k] for k in keys], dtype="float64")


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two token sequences, one row at a time with vector steps."""
    codes = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[t] for t in a], np.int64), np.array([codes[t] for t in b], np.int64)
    row, steps = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, t in enumerate(x):
        best = np.concatenate(([i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != t))))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("low", "high", "mean")]))
def levenshtein_ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """1 - distance / norm, for the norms min (1 at least), max and mean of the lengths."""
    rows = []
    for x, y in zip(a, b, strict=True):
        d = edit_distance(list(x), list(y))
        high, mean = max(len(x), len(y)), (len(x) + len(y)) / 2
        rows.append((1 - d / max(1, min(len(x), len(y))), 1 - d / high if high else 1.0, 1 - d / mean if mean else 1.0))
    return pd.DataFrame(rows, columns=["low", "high", "mean"])


#: Fixed values of the length-based alignment model: mean ratio, variance, and penalties of the steps.
LENGTH_RATIO, LENGTH_VARIANCE = 1.0, 6.8
STEP_PENALTY = {(1, 1): 0.0, (1, 0): -math.log(0.0099 / 0.89), (0, 1): -math.log(0.0099 / 0.89), (2, 1): -math.log(0.089 / 0.89), (1, 2): -math.log(0.089 / 0.89), (2, 2): -math.log(0.011 / 0.89)}


def _length_cost(s: float, t: float) -> float:
    if not s and not t:
        return 0.0
    mean = (s + t / LENGTH_RATIO) / 2
    z = abs(s * LENGTH_RATIO - t) / math.sqrt(LENGTH_VARIANCE * mean)
    return -math.log(max(math.erfc(z / math.sqrt(2)), 1e-300))


def gale_church(source: list[int], target: list[int], most: float = 100.0) -> float:
    """Negated cost of the cheapest alignment of sentence lengths; +most if every way costs most or more, -most if it costs nothing."""
    s, t = [0, *np.cumsum(source).tolist()], [0, *np.cumsum(target).tolist()]
    none = [math.inf] * (len(t))
    rows: list[list[float]] = [none, none]  # of the last two sources
    spans = [(len(t), -1), (len(t), -1)]  # first and last cell of each that costs less than most: no other one can be on the way
    for i in range(len(s)):
        row, low, high = none[:], len(t), -1
        if not i:
            row[0], low, high = 0.0, 0, 0
        first, last = min(spans[0][0], spans[1][0], low), max(spans[0][1], spans[1][1]) + 2
        for j in range(max(first, int(not i)), len(t)):
            if j > last and row[j - 1] >= most:
                break
            best = math.inf
            for (a, b), penalty in STEP_PENALTY.items():
                if a <= i and b <= j:
                    before = (row, rows[1], rows[0])[a][j - b]
                    if before < most:
                        best = min(best, before + penalty + _length_cost(s[i] - s[i - a], t[j] - t[j - b]))
            if best < most:
                row[j], low, high = best, min(low, j), j
        rows, spans = [rows[1], row], [spans[1], (low, high)]
        if high < 0 and spans[0][1] < 0:
            return most
    cost = rows[-1][-1]
    return most if cost >= most else -most if cost == 0 else -cost


@F.pandas_udf(DoubleType())
def gale_church_score(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([gale_church(list(map(int, s)), list(map(int, t))) for s, t in zip(source, target, strict=True)])
