"""Searches: rows whose id is divisible by ASKED are held against all rows of their group, in blocks of bounded size.

Few groups may hold all rows, so a group's rows are dealt over SALTS (joins) or over blocks (sets of terms) by hash, and its queries
go to all of these. Each pair is made in one task and never shuffled with its contents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import top_k

ASKED = 100
SALTS = 64
#: Rows and queries that meet in one task at most, about.
BLOCK_ROWS, BLOCK_QUERIES = 4000, 1000


def asked(key: Column) -> Column:
    return key % ASKED == 0


def paired(queries: DataFrame, rows: DataFrame, group: str, key: str) -> DataFrame:
    """Queries and rows of one group; the rows of a group are dealt over SALTS by their key."""
    q = queries.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r = rows.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return q.join(r, [group, "__salt"]).drop("__salt")


def _nearest(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"src_id": [], "tgt_id": [], "jaccard": []})
        ids, sizes = rows["id"].to_numpy(), np.array([len(t) for t in rows["terms"]])
        terms = np.concatenate([np.asarray(t, np.int64) for t in rows["terms"]])
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        owner, (known, first, many) = owner[order], np.unique(terms[order], return_index=True, return_counts=True)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for query, own in zip(queries["id"], queries["terms"], strict=True):
            own = np.asarray(own, np.int64)
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            at = at[known[at] == own] if len(known) else at[:0]
            n = many[at]
            hits = owner[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            common = np.bincount(hits, minlength=len(ids))
            some = np.flatnonzero(common)
            jaccard = common[some] / (len(own) + sizes[some] - common[some])
            best = np.lexsort((ids[some], -jaccard))[:k]
            out.append((np.full(len(best), query), ids[some[best]], jaccard[best]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("src_id", "tgt_id", "jaccard"))})

    return run


def nearest_sets(queries: DataFrame, rows: DataFrame, group: str, k: int = 10) -> DataFrame:
    """(src_id, tgt_id, jaccard): of each query (group, id, terms) the k rows of its group with the largest Jaccard of terms, ties by id.

    terms are sets of 64-bit codes. A block of rows is turned into postings, and each query counts what it has in common with all of its
    rows at once; only the k best of a block are shuffled. Rows without a common term are never found.
    """
    kept = lambda df: df.where(F.col(group).isNotNull() & (F.size("terms") > 0))
    queries, rows = kept(queries), kept(rows)
    blocks = lambda df, name, most: df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = blocks(queries, "__q", BLOCK_QUERIES).join(blocks(rows, "__r", BLOCK_ROWS), group)
    place = lambda n, of: F.pmod(F.xxhash64("id", F.lit(of)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, group).withColumn("qb", place("__q", "q")).withColumn("rb", every("__r")).select(F.col(group).alias("of"), "qb", "rb", F.col("id").alias("id"), F.col("terms").alias("terms"))
    r = rows.join(sizes, group).withColumn("rb", place("__r", "r")).withColumn("qb", every("__q")).select(F.col(group).alias("of"), "qb", "rb", F.col("id").alias("id"), F.col("terms").alias("terms"))
    keys = ["of", "qb", "rb"]
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(_nearest(k), f"src_id {queries.schema['id'].dataType.simpleString()}, tgt_id {rows.schema['id'].dataType.simpleString()}, jaccard double")
    return top_k(found, k, "jaccard").drop("rank")
