"""The location index: keys, lookups, merges and queries over (domain, url, crawl)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U


def indexed(locations: DataFrame) -> DataFrame:
    """Locations (url, crawl, location) with their domain, the last one of each key (by location)."""
    keyed = locations.withColumn("domain", U.domain_key(F.col("url")))
    return keyed.groupBy("domain", "url", "crawl").agg(F.max("location").alias("location"))


def updated(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Maps of changes merged into existing keys; the stored value wins. Unknown keys are not inserted."""
    new = changes.select("domain", "url", "crawl", F.col("location").alias("__new"))
    both = index.join(new, ["domain", "url", "crawl"])
    more = F.map_filter("__new", lambda k, v: ~F.map_contains_key("location", k))
    return both.withColumn("location", F.map_concat("location", more)).drop("__new")


def not_inserted(index: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(index, ["domain", "url", "crawl"], "left_anti")


def located(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs whose pages both have a location."""
    side = lambda n: index.select(F.col("url").alias(f"{n}_url"), F.col("crawl").alias(f"{n}_crawl"), F.col("location").alias(f"{n}_location"))
    return pairs.join(side("src"), ["src_url", "src_crawl"]).join(side("tgt"), ["tgt_url", "tgt_crawl"])


def attach_locations(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Locations (uri, container, offset) of candidate uris: few domains first, then the uris; Spark's runtime filters prune the scan."""
    domains = candidates.select(U.domain_key(F.col("uri")).alias("domain")).distinct()
    likely = links.withColumn("domain", U.domain_key(F.col("uri"))).join(domains, "domain", "left_semi")
    return likely.join(candidates.select("uri").distinct(), "uri", "left_semi").drop("domain")


def query_prefix(index: DataFrame, url: str, crawl: str | None = None, exact: bool = False, max_results: int = 10_000) -> DataFrame:
    """Locations of a url or of all urls that begin with it."""
    key = index.sparkSession.range(1).select(U.domain_key(F.lit(url)).alias("d")).first()["d"]
    found = index.where(F.col("domain") == key).where(F.col("url") == url if exact else F.col("url").startswith(url))
    if crawl:
        found = found.where(F.col("crawl") == crawl)
    return found.orderBy("url", "crawl").limit(max_results)


def query_domain(index: DataFrame, name: str, crawl: str | None = None, max_results: int | None = 10_000) -> DataFrame:
    """Locations whose host contains name and lies under its registered domain; without max_results all of them, in no order."""
    key = index.sparkSession.range(1).select(U.domain_key(F.lit(f"http://{name}/")).alias("d")).first()["d"]
    found = index.where(F.col("domain") == key).where(U.host(F.col("url")).contains(name))
    if crawl:
        found = found.where(F.col("crawl") == crawl)
    return found if max_results is None else found.orderBy("url", "crawl").limit(max_results)


def crawls(index: DataFrame) -> DataFrame:
    return index.select("crawl").distinct().orderBy("crawl")


def domain_report(index: DataFrame, url: str) -> tuple[DataFrame, DataFrame]:
    """All urls of a url's domain, and their number by crawl."""
    key = index.sparkSession.range(1).select(U.domain_key(F.lit(url)).alias("d")).first()["d"]
    mine = index.where(F.col("domain") == key)
    return mine.select("url").distinct(), mine.groupBy("crawl").agg(F.count(F.lit(1)).alias("n"))


def pages_of_pairs(pages: DataFrame) -> DataFrame:
    """Located pages (pair_id, side, url, html, text) to one row a pair; pairs with an empty html or text go."""
    full = pages.where("length(html) > 0 AND length(text) > 0")
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = full.groupBy("pair_id").agg(*(side(s, c).alias(f"{s}_{c}") for s in ("src", "tgt") for c in ("url", "text", "html")))
    return both.where("src_url IS NOT NULL AND tgt_url IS NOT NULL")
