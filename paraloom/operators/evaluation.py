"""Evaluation against gold url pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U


def in_devset(rows: DataFrame, truth: DataFrame, side: str = "src") -> DataFrame:
    return rows.join(truth.select(side).distinct(), side, "left_semi")


def missing(truth: DataFrame, found: DataFrame) -> DataFrame:
    """True pairs that were not found."""
    return truth.join(found.select("src", "tgt").distinct(), ["src", "tgt"], "left_anti")


def unreachable(truth: DataFrame, urls: DataFrame, side: str) -> DataFrame:
    """True urls of a side that the crawl (url) does not have."""
    return truth.select(F.col(side).alias("url")).distinct().join(urls, "url", "left_anti")


def by_phase(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs and true pairs of each phase of generated_pairs()."""
    hit = truth.select("src", "tgt").distinct().withColumn("hit", F.lit(1))
    return found.join(hit, ["src", "tgt"], "left").groupBy("phase").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("wins"), (F.count(F.lit(1)) - F.count("hit")).alias("fails"))


def outcomes(truth: DataFrame, kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each true pair (src, tgt): outcome (win, mismatch or missing), what its ends are paired with among the kept one-to-one pairs, and whether it was among all pairs."""
    true = truth.select("src", "tgt").distinct()
    s2t, t2s = kept.select("src", F.col("tgt").alias("paired_tgt")), kept.select("tgt", F.col("src").alias("paired_src"))
    was = pairs.select("src", "tgt").distinct().withColumn("__was", F.lit(True))
    x = true.join(s2t, "src", "left").join(t2s, "tgt", "left").join(was, ["src", "tgt"], "left")
    win = F.col("paired_tgt").eqNullSafe(F.col("tgt"))
    outcome = F.when(win, "win").when(F.col("paired_tgt").isNotNull() | F.col("paired_src").isNotNull(), "mismatch").otherwise("missing")
    return x.select("src", "tgt", outcome.alias("outcome"), "paired_tgt", "paired_src", F.coalesce("__was", F.lit(False)).alias("was_in_pairs"))


def language_labels(truth: DataFrame, source: str, target: str) -> DataFrame:
    """How the two urls of each true pair name their languages: ok, swapped, mismatch or missing."""
    of = lambda c: F.when(U.language_of(U.path(F.col(c))) != "", U.language_of(U.path(F.col(c)))).otherwise(U.language_of(U.query(F.col(c))))
    s, t = of("src"), of("tgt")
    kind = F.when((s == "") | (t == ""), "missing").when((s == source) & (t == target), "ok").when((s == target) & (t == source), "swapped").otherwise("mismatch")
    return truth.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def language_check(truth: DataFrame, pages: DataFrame, source: str, target: str) -> DataFrame:
    """Of gold pairs: total, both pages in the crawl, unknown language, right languages, wrong languages. pages: url, lang."""
    side = lambda n: pages.select(F.col("url").alias(n), F.col("lang").alias(f"{n}_lang"), F.lit(True).alias(f"{n}_in"))
    x = truth.join(side("src"), "src", "left").join(side("tgt"), "tgt", "left")
    both = F.col("src_in").isNotNull() & F.col("tgt_in").isNotNull()
    unknown = both & (F.col("src_lang").isNull() | F.col("tgt_lang").isNull())
    right = both & F.coalesce((F.col("src_lang") == source) & (F.col("tgt_lang") == target), F.lit(False))
    return x.agg(F.count(F.lit(1)).alias("total"), F.count_if(both).alias("possible"), F.count_if(unknown).alias("unknown"), F.count_if(right).alias("right"), F.count_if(both & ~unknown & ~right).alias("wrong"))


def corpus_stats(pages: DataFrame, source: str = "en", target: str = "fr") -> DataFrame:
    """Pages with text, in the source language, in the target language, and with a translation attached."""
    has = F.length(F.coalesce("text", F.lit(""))) > 0
    return pages.agg(F.count_if(has).alias("with_text"), F.count_if(F.col("lang") == source).alias("in_source"), F.count_if(F.col("lang") == target).alias("in_target"), F.count_if(F.length(F.coalesce("translation", F.lit(""))) > 0).alias("translated"))


def domain_table(pages: DataFrame, found: DataFrame, source: str, target: str) -> DataFrame:
    """Of each host: pages of both languages, their product, pairs found (src, tgt)."""
    n = pages.groupBy(U.host(F.col("url")).alias("host")).agg(F.count_if(F.col("lang") == source).alias("n_source"), F.count_if(F.col("lang") == target).alias("n_target"))
    f = found.groupBy(U.host(F.col("src")).alias("host")).agg(F.count(F.lit(1)).alias("found"))
    return n.join(f, "host", "left").select("host", "n_source", "n_target", (F.col("n_source") * F.col("n_target")).alias("product"), F.coalesce("found", F.lit(0)).alias("found"))


def strip_agreement(pages: DataFrame) -> DataFrame:
    """Mirrored pages (url, html): how many name their address, and how many of these strip to what the url strips to."""
    made = U.mirrored_from(F.col("html"))
    named = made != ""
    return pages.agg(F.count(F.lit(1)).alias("n"), F.count_if(named).alias("named"), F.count_if(named & (U.plain_strip(U.bare(made)) == U.plain_strip(U.bare(F.col("url"))))).alias("agree"))
