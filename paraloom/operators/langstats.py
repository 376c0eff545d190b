"""Language statistics of pages, hosts and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U


def page_languages(spans: DataFrame) -> DataFrame:
    """Bytes of each known language of a page, as one row a page: uri, languages (by name)."""
    sums = spans.where("language <> 'un'").groupBy("uri", "language").agg(F.sum("bytes").alias("bytes"))
    return sums.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct(F.col("language").alias("lang"), "bytes"))).alias("languages"))


def host_languages(spans: DataFrame, min_bytes: int = 100, languages: list[str] | None = None) -> DataFrame:
    """Bytes by host and language of chunks of at least min_bytes."""
    kept = spans.where(F.col("bytes") >= min_bytes)
    if languages:
        kept = kept.where(F.col("language").isin(languages))
    return kept.groupBy(U.host(F.col("uri")).alias("host"), "language").agg(F.sum("bytes").alias("bytes"))


def percent_languages(pages: DataFrame, min_percent: float = 10, min_bytes: int = 100, languages: list[str] | None = None) -> DataFrame:
    """Bytes by domain and language from shares in percent: pages (domain, tld, bytes, langs)."""
    each = pages.select(F.concat_ws(".", "domain", "tld").alias("domain"), "bytes", F.explode("langs").alias("l"))
    each = each.select("domain", F.col("l.lang").alias("language"), "l.percent", F.floor(F.col("bytes") * F.col("l.percent") / 100).cast("long").alias("bytes"))
    each = each.where((F.col("percent") >= min_percent) & (F.col("bytes") >= min_bytes))
    if languages:
        each = each.where(F.col("language").isin(languages))
    return each.groupBy("domain", "language").agg(F.sum("bytes").alias("bytes"))


def entropy(stats: DataFrame, key: str = "host", monolingual: bool = False) -> DataFrame:
    """Signed entropy (sum of p ln p) of each key's distribution; keys with one language only if asked for."""
    total = stats.groupBy(key).agg(F.sum("bytes").alias("total"), F.sort_array(F.collect_list(F.struct("bytes", "language")), asc=False).alias("dist"))
    share = lambda d: d["bytes"] / F.col("total")
    out = total.withColumn("entropy", F.aggregate("dist", F.lit(0.0), lambda acc, d: acc + F.when(d["bytes"] > 0, share(d) * F.log(share(d))).otherwise(0.0)))
    return out if monolingual else out.where("entropy <> 0")


def merged_distributions(dists: DataFrame, monolingual: bool = True, total: bool = False) -> DataFrame:
    """Sum of (domain, language, bytes) rows of many files: lower case, xx-yy as xx, domain up to a question mark; total: all as one."""
    clean = dists.select(
        F.lit("TOTAL").alias("domain") if total else F.substring_index("domain", "?", 1).alias("domain"), F.substring_index(F.lower("language"), "-", 1).alias("language"), "bytes"
    )
    sums = clean.groupBy("domain", "language").agg(F.sum("bytes").alias("bytes"))
    if not monolingual:
        several = sums.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sums = sums.join(several, "domain", "left_semi")
    return sums


def characters(spans: DataFrame) -> DataFrame:
    """Characters of the trimmed lines of each language: spans (language, text)."""
    lines = spans.select("language", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("language").agg(F.sum(F.length(F.trim("line"))).alias("characters"))


def main_languages(languages: Column, min_ratio: float = 0.1) -> Column:
    """Languages with at least min_ratio of a page's bytes; none if the page has none."""
    total = F.aggregate(languages, F.lit(0).cast("long"), lambda acc, x: acc + x["bytes"])
    return F.transform(F.filter(languages, lambda x: (total > 0) & (x["bytes"] / total >= min_ratio)), lambda x: x["lang"])


def language_codes(stats: DataFrame, table: DataFrame) -> DataFrame:
    """Language names replaced by codes; table (name, code) is a small fixed list."""
    return stats.join(F.broadcast(table.withColumnRenamed("name", "language")), "language").drop("language").withColumnRenamed("code", "language")


def distinct_urls(urls: DataFrame, by: str = "file", precision: int = 17) -> DataFrame:
    """HyperLogLog sketches of distinct urls a file."""
    return urls.groupBy(by).agg(F.hll_sketch_agg("url", precision).alias("sketch")).withColumn("estimate", F.hll_sketch_estimate("sketch"))


def cumulative_urls(sketches: DataFrame, by: str = "file") -> DataFrame:
    """Estimate over each file and all before it, by name; a join of the files' sketches, which are few."""
    a, b = sketches.select(F.col(by).alias("upto")), sketches.select(F.col(by).alias("f"), "sketch")
    return a.join(b, F.col("f") <= F.col("upto")).groupBy("upto").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def paired_urls(sketches: DataFrame, by: str = "file") -> DataFrame:
    """Estimates of the union of every two files."""
    a, b = sketches.select(F.col(by).alias("a"), F.col("sketch").alias("x")), sketches.select(F.col(by).alias("b"), F.col("sketch").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.hll_sketch_estimate(F.hll_union("x", "y")).alias("estimate"))


def frequency(rows: DataFrame, key: str) -> DataFrame:
    """Counts of a key (domain, archive file), most frequent first."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def spans_of_lines(lines: DataFrame, language: Column, key: str = "uri") -> DataFrame:
    """Language spans: neighbouring lines (key, pos, text) of one language as one, with byte offset; unknown languages and blank lines are skipped."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pos")
    kept = lines.where(F.trim("text") != "").withColumn("language", language).withColumn("size", F.octet_length("text") + 1)
    kept = kept.withColumn("end", F.sum("size").over(w)).withColumn("new", (~F.col("language").eqNullSafe(F.lag("language").over(w))).cast("int"))
    runs = kept.withColumn("run", F.sum("new").over(w)).where("language IS NOT NULL AND language <> 'un'")
    return runs.groupBy(key, "run", "language").agg(F.min(F.col("end") - F.col("size")).alias("offset"), F.sum("size").alias("bytes"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n").alias("text"))
