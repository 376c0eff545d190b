"""Texts looked up among others: exactly, else as a collation takes them to be equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes after the exact one, from the strictest: canonically equal, but for case, but for case and accents.
COLLATIONS = ("UNICODE", "UNICODE_CI", "UNICODE_CI_AI")


def looked_up(wanted: DataFrame, known: DataFrame, text: str = "text", value: str = "value", collations: tuple[str, ...] = COLLATIONS) -> tuple[DataFrame, DataFrame]:
    """wanted with found (the known text) and value, and the rest of wanted. known (text, value) has each text once.

    Each pass takes only what the passes before have not found; of known texts that a collation takes to be
    one the smallest is found. Texts are joined once each, however often they are wanted. Null texts are not found.
    """
    asked = wanted.select(text).where(F.col(text).isNotNull()).distinct()
    all_known = known.select(F.col(text).alias("found"), value).where("found IS NOT NULL")
    hits = asked.join(all_known, F.col(text) == F.col("found"))
    left = asked.join(all_known, F.col(text) == F.col("found"), "left_anti")
    for name in collations:
        least = all_known.groupBy(F.collate("found", name).alias("__key")).agg(F.min_by(F.struct("found", value), "found").alias("__k"))
        same = F.collate(F.col(text), name) == F.col("__key")
        hits = hits.unionByName(left.join(least, same).select(text, F.col("__k.found").alias("found"), F.col(f"__k.{value}").alias(value)))
        left = left.join(least, same, "left_anti")
    return wanted.join(hits, text), wanted.join(hits.select(text), text, "left_anti")
