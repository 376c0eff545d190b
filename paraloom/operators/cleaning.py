"""Cleaning of sentence pairs, splitting by domain, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

MOST_RATIO, SMOOTH = 1.5, 15


def length_reason(source: Column, target: Column, of=F.length) -> Column:
    s, t = of(source) + SMOOTH, of(target) + SMOOTH
    return F.when(s / t > MOST_RATIO, "source_too_long").when(t / s > MOST_RATIO, "source_too_short")


def deletion_reason(source: Column, target: Column, score: Column | None = None, min_score: float = 0.0, source_ok: Column | None = None, target_ok: Column | None = None, columns: Column | None = None) -> Column:
    """The first reason to delete a sentence pair, or null: columns, identical, empty, score, lengths, languages."""
    yes = F.lit(True)
    n = columns if columns is not None else F.lit(5)
    return (
        F.when(n <= 1, "line_short")
        .when(n > 5, "line_long")
        .when(source == target, "identical")
        .when(F.trim(source) == "", "source_empty")
        .when(F.trim(target) == "", "target_empty")
        .when((score if score is not None else F.lit(1.0)) < min_score, "low score")
        .when(length_reason(source, target).isNotNull(), length_reason(source, target))
        .when(~(source_ok if source_ok is not None else yes), "source_lang")
        .when(~(target_ok if target_ok is not None else yes), "target_lang")
    )


def old_deletion_reason(source: Column, target: Column, source_ok: Column, target_ok: Column) -> Column:
    """The older order: empty, language, identical, lengths in bytes."""
    return (
        F.when(F.trim(source) == "", "source_empty")
        .when(F.trim(target) == "", "target_empty")
        .when(~source_ok, "source_lang")
        .when(~target_ok, "target_lang")
        .when(source == target, "identical")
        .otherwise(length_reason(source, target, F.octet_length))
    )


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated sentence pairs of 2 to 5 columns: columns, src_url, tgt_url, source, target, score."""
    parts = F.split(F.col(column), "\t")
    n = F.size(parts)
    at = lambda k: F.get(parts, F.lit(k))
    urls = n >= 4
    score = F.when(n == 5, at(4)).when(n == 3, at(2))
    return lines.select(column, n.alias("columns"), *(F.when(urls, at(i)).alias(c) for i, c in enumerate(("src_url", "tgt_url"))), F.when(urls, at(2)).otherwise(at(0)).alias("source"), F.when(urls, at(3)).otherwise(at(1)).alias("target"), F.coalesce(score.try_cast("double"), F.lit(1.0)).alias("score"))


def deletion_report(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Number of pairs by reason; null counts as written."""
    return rows.groupBy(F.coalesce(reason, F.lit("written")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def by_domain(pairs: DataFrame, registered: bool = False) -> DataFrame:
    """Pairs whose two urls have one host (or registered domain), which they get as a column."""
    of = (lambda c: U.registered(U.host(F.col(c)))) if registered else (lambda c: U.host(F.col(c)))
    return pairs.withColumn("domain", of("src_url")).where(F.col("domain") == of("tgt_url"))


def parallel_dedupe(pairs: DataFrame) -> DataFrame:
    """One of each (domain, source, target)."""
    return pairs.select("domain", "source", "target").distinct()


def is_long(source: Column, target: Column, most: int = 50) -> Column:
    """Whether a side has over `most` tokens."""
    return (F.size(F.split(source, " ")) > most) | (F.size(F.split(target, " ")) > most)


def single_words(entries: DataFrame, column: str = "value") -> DataFrame:
    """Dictionary entries w1@#@w2 with one word on both sides."""
    parts = F.split(F.col(column), "@#@")
    return entries.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("w1"), F.trim(parts[1]).alias("w2")).where((F.col("w1") != "") & (F.col("w2") != "") & ~F.col("w1").contains(" ") & ~F.col("w2").contains(" "))


def harmonic_dictionary(forward: DataFrame, backward: DataFrame, source_words: DataFrame, target_words: DataFrame, least: float = 0.2) -> DataFrame:
    """Word pairs (w1, w2, p) whose two translation probabilities (s, t, p) and (t, s, p) have a harmonic mean over least."""
    both = forward.join(backward.select("s", "t", F.col("p").alias("q")), ["s", "t"]).withColumn("mean", 2 / (1 / F.col("p") + 1 / F.col("q"))).where(F.col("mean") > least)
    both = both.join(source_words.select(F.col("id").alias("s"), F.col("word").alias("w1")), "s")
    return both.join(target_words.select(F.col("id").alias("t"), F.col("word").alias("w2")), "t").select("w1", "w2", "mean")


def reversed_dictionary(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("w2").alias("w1"), F.col("w1").alias("w2")).orderBy("w1", "w2")


def url_agreement(pairs: DataFrame) -> DataFrame:
    """Share of sentence pairs whose urls strip to different ones (1), and also counting a pair of equal urls as wrong (2)."""
    s, t = U.plain_strip_uri(F.col("src_url"))["url"], U.plain_strip_uri(F.col("tgt_url"))["url"]
    wrong, same = s != t, F.col("src_url") == F.col("tgt_url")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(wrong.cast("double")).alias("acc1"), F.avg((wrong | same).cast("double")).alias("acc2"))


def replaced_labels(rows: DataFrame, valid: list[str], default: str | None = None) -> DataFrame:
    """Labels that aren't valid become the default, or their rows go."""
    ok = F.col("label").isin(valid)
    return rows.where(ok) if default is None else rows.withColumn("label", F.when(ok, F.col("label")).otherwise(default))


def kept_features(features: Column, valid: list[str] | None = None, prefixes: list[str] | None = None) -> Column:
    """Features in the valid set or with one of the prefixes."""
    out = features
    if valid is not None:
        out = F.filter(out, lambda f: f.isin(valid))
    if prefixes:
        out = F.filter(out, lambda f: F.exists(F.array(*map(F.lit, prefixes)), lambda p: f.startswith(p)))
    return out


def sampled_english(rows: DataFrame, max_percent: float = 100, share: float = 1.0, seed: int = 1) -> DataFrame:
    """Rows (english_percent) with no more English than max_percent, and a sample of those that have any."""
    kept = rows.where(F.coalesce("english_percent", F.lit(0)) <= max_percent)
    return kept if share >= 1 else kept.where((F.coalesce("english_percent", F.lit(0)) == 0) | (F.rand(seed) <= share))
