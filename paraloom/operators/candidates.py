"""URL candidates and pairs: pages whose URLs differ in the language code only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from .langstats import main_languages
from .lineage import cut


def language_candidates(kv: DataFrame, language: str, min_ratio: float = 0.1, remove_index: bool = False, aggressive: bool = False, strip: bool = True) -> DataFrame:
    """Pages (url, crawl, languages) with enough of the language and a URL that names it, with their stripped url."""
    mine = kv.where(F.array_contains(main_languages(F.col("languages"), min_ratio), language))
    mine = mine.withColumn("norm", U.normalize(F.col("url")))
    if not strip:
        return mine.withColumn("stripped", F.col("norm"))
    # a generator's row is worked out once, however often what comes after asks for its parts
    mine = mine.withColumn("made", F.explode(F.array(U.strip_uri(F.col("norm"), language, remove_index, aggressive))))
    return mine.where(F.col("made.ok")).withColumn("stripped", F.col("made.url")).drop("made")


def one_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by a declared order."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def match_candidates(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source pages with the target page found under their raw url, else under their stripped url; a page is no pair with itself."""
    build = target.groupBy("stripped").agg(F.max(F.struct("crawl", "url")).alias("t"))
    probe = cut(source.select("url", "crawl", "norm", "stripped"))
    keys = probe.select("url", "crawl", F.explode(F.array(F.struct(F.lit(1).alias("priority"), F.col("norm").alias("key")), F.struct(F.lit(2).alias("priority"), F.col("stripped").alias("key")))).alias("k"))
    hits = keys.join(build, F.col("k.key") == F.col("stripped")).select("url", "crawl", "k.priority", F.col("k.key").alias("stripped"), F.col("t.url").alias("tgt_url"), F.col("t.crawl").alias("tgt_crawl"))
    first = hits.where("url <> tgt_url").groupBy("url", "crawl").agg(F.min(F.struct("priority", "stripped", "tgt_url", "tgt_crawl")).alias("m"))
    return first.select("m.stripped", F.col("url").alias("src_url"), F.col("crawl").alias("src_crawl"), "m.tgt_url", "m.tgt_crawl")


def generated_pairs(source: DataFrame, target: DataFrame, first_phase: int = 1) -> DataFrame:
    """Pairs (phase, src, tgt): stripped source is a target, stripped target is a source, both strip to the same.

    Both sides are stripped once and written, as each phase reads them.
    """
    s, t = cut(source.select(F.col("url").alias("src"), F.col("stripped").alias("s"))), cut(target.select(F.col("url").alias("tgt"), F.col("stripped").alias("t")))
    one = s.join(t, F.col("s") == F.col("tgt"))
    two = s.join(t, F.col("t") == F.col("src"))
    three = s.join(t, F.col("s") == F.col("t"))
    phases = [df.select(F.lit(first_phase + i).alias("phase"), "src", "tgt") for i, df in enumerate((one, two, three))]
    return phases[0].unionByName(phases[1]).unionByName(phases[2]).where("src <> tgt").distinct()


def stripped_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every source with every target of one language-independent url."""
    return source.select("stripped", F.col("url").alias("src_url")).join(target.select("stripped", F.col("url").alias("tgt_url")), "stripped")


def qualified_groups(rows: DataFrame) -> DataFrame:
    """Rows (stripped, url, stripped_language, detected) of groups with two urls, languages and detections at least, one of whose languages was detected."""
    names = F.transform(F.split(F.lower("detected"), "/"), lambda x: F.when(x == "chineset", F.lit("chinese")).otherwise(x))
    groups = rows.groupBy("stripped").agg(
        F.count_distinct("url").alias("urls"), F.count_distinct("stripped_language").alias("languages"), F.count_distinct("detected").alias("detections"),
        F.collect_set(F.lower("stripped_language")).alias("named"), F.array_distinct(F.flatten(F.collect_set(names))).alias("seen"),
    )
    good = groups.where((F.col("urls") >= 2) & (F.col("languages") >= 2) & (F.col("detections") >= 2) & F.arrays_overlap("named", "seen"))
    return rows.join(good.select("stripped"), "stripped", "left_semi")


def excluded(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that occur exactly once and are not among the known ones."""
    once = rows.groupBy(*rows.columns).count().where("count = 1").drop("count")
    return once.join(known.select(*rows.columns).distinct(), rows.columns, "left_anti")


def swapped(pairs: DataFrame) -> DataFrame:
    """Matched pairs of the other direction, for exclusion: urls change places, crawls stay."""
    return pairs.select("stripped", F.col("tgt_url").alias("src_url"), "src_crawl", F.col("src_url").alias("tgt_url"), "tgt_crawl")


def renamed_crawl(pairs: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return pairs.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))


def url_links(pages: DataFrame, left: str = "en", right: str = "fr") -> DataFrame:
    """Left pages with the right pages of the same plainly stripped url, score 1: src, cands."""
    p = pages.withColumn("p", U.plain_strip_uri(F.col("url")))
    s, t = p.where(F.col("lang") == left).select(F.col("url").alias("src"), "p.url"), p.where(F.col("lang") == right).select(F.col("url").alias("tgt"), "p.url")
    return s.join(t, "url").groupBy("src").agg(F.sort_array(F.collect_set(F.struct(F.col("tgt"), F.lit(1.0).alias("score")))).alias("cands"))


def ruled(urls: DataFrame, source: str, target: str) -> DataFrame:
    """Old candidate rows: side S or D by the file rule and the path rule; the source wins."""
    u = F.col("url")
    both = urls.select("url", *(getattr(U, f"{kind}_rule")(u, lang).cast("int").alias(f"{side}{n}") for side, lang in (("s", source), ("d", target)) for n, kind in ((1, "file"), (2, "path"))))
    side = F.when((F.col("s1") == 1) | (F.col("s2") == 1), "S").when((F.col("d1") == 1) | (F.col("d2") == 1), "D")
    pick = lambda n: F.when(F.col("side") == "S", F.col(f"s{n}")).otherwise(F.col(f"d{n}")).alias(f"rule{n}")
    return both.withColumn("side", side).where("side IS NOT NULL").select("side", "url", pick(1), pick(2))


def rule_mappings(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Source and target urls that map to each other: by whole path first; by file name only where neither is taken yet."""
    bare, name = U.bare(F.col("url")), F.substring_index(U.bare(F.col("url")), "/", -1)
    r = rows.select("side", "url", "rule1", "rule2", bare.alias("bare"), name.alias("name"), F.regexp_replace(bare, "/?[^/]*$", "").alias("folder"), F.substring_index(bare, "/", 1).alias("domain"))
    d = r.where("side = 'D'").select(F.col("url").alias("tgt"), "domain", "folder", "rule1", "rule2", U.renamed_path(F.col("bare"), target, source).alias("path_as"), U.renamed_file(F.col("name"), target, source).alias("name_as"), "bare", "name")
    s = r.select(F.col("url").alias("src"), F.col("bare").alias("b"), F.col("name").alias("n"), F.col("folder").alias("f"), F.col("domain").alias("dom"), F.col("side").alias("of"))
    two = d.where("rule2 = 1 AND path_as <> bare").join(s, (F.col("path_as") == F.col("b")) & (F.col("domain") == F.col("dom"))).groupBy("src").agg(F.max("tgt").alias("tgt"))
    one = d.where("rule1 = 1 AND name_as <> name").join(s.where("of = 'S'"), (F.col("name_as") == F.col("n")) & (F.col("folder") == F.col("f"))).groupBy("src").agg(F.max("tgt").alias("tgt"))
    one = one.join(two.select("src"), "src", "left_anti").join(two.select("tgt"), "tgt", "left_anti")
    return two.withColumn("rule", F.lit(2)).unionByName(one.withColumn("rule", F.lit(1)))


def mapping_info(mappings: DataFrame, info: DataFrame) -> DataFrame:
    """Information (url, info) of both ends of each mapping."""
    s, t = info.select(F.col("url").alias("src"), F.col("info").alias("src_info")), info.select(F.col("url").alias("tgt"), F.col("info").alias("tgt_info"))
    return mappings.join(s, "src", "left").join(t, "tgt", "left")
