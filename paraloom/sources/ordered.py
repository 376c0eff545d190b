"""Rows of files in the order in which they stand there: last writes, row numbers, row-aligned files.

A row's place is (load, file, block, place): which path it was read from, its file's name, where its split of
the file begins, and a number that grows within the split. Writers number files in their rows' order, so this
is the order of the rows. Row numbers without gaps come from the counts of the splits: rows are never sorted, and
the one window is over a row a split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACE = ["load", "file", "block", "place"]
#: Splits up to which their starts, a row each, go to every task instead of being joined by shuffle.
FEW_SPLITS = 100_000


def placed(rows: DataFrame, load: int = 0) -> DataFrame:
    """Rows of a file source with their place. Must be asked of the scan itself, before any filter, join or shuffle."""
    here = [F.lit(load).alias("load"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")]
    return rows.select("*", *here)


def read_lines(spark: SparkSession, *paths: str, separator: str | None = None) -> DataFrame:
    """Lines (value) of text files with their place; each path is a load, later ones come later."""
    options = {} if separator is None else {"lineSep": separator}
    return reduce(DataFrame.unionAll, [placed(spark.read.options(**options).text(p), i) for i, p in enumerate(paths)])


def key_values(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Lines key TAB value as columns key and value, places kept. A line without exactly one tab is an error, or goes if not strict."""
    tabs = F.length("value") - F.length(F.replace("value", F.lit("\t"))) == 1
    checked = lines.where(tabs) if not strict else lines.withColumn("value", F.when(tabs, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not one tab: "), F.substring("value", 1, 200))).cast("string")))
    return checked.withColumn("key", F.substring_index("value", "\t", 1)).withColumn("value", F.substring_index("value", "\t", -1))


def last_written(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key (null is one) the row that stands last, without its place. Aggregated before the shuffle, so a hot key costs a row a task."""
    others = [c for c in rows.columns if c not in (*keys, *PLACE)]
    last = F.max_by(F.struct(*others), F.struct(*PLACE)) if others else F.lit(None)
    return rows.groupBy(*keys).agg(last.alias("__last")).select(*keys, *(F.col("__last")[c].alias(c) for c in others))


def row_numbers(rows: DataFrame, name: str = "row") -> DataFrame:
    """Placed rows with their numbers, gapless from 0 over all loads in order. Rows must be as scanned: none filtered out before."""
    split = PLACE[:3]
    counts = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*split, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    if starts.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS:
        starts = F.broadcast(starts)
    return rows.join(starts, split).withColumn(name, (F.col("place") + F.col("shift")).cast("long")).drop("shift")


def zipped(**frames: DataFrame) -> DataFrame:
    """Placed rows (value) of several files side by side, as long as the shortest: row and one column a file, by the names given."""
    sides = [row_numbers(f).select("row", F.col("value").alias(n)) for n, f in frames.items()]
    return reduce(lambda a, b: a.join(b, "row"), sides)


