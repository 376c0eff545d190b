"""Record files: kv rows, documents (lett, ett), dictionaries, gold pairs, word tables, crawl results; and their writers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U

#: XML's own entities; the one for & comes last.
XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def parse_kv(lines: DataFrame, column: str = "value") -> DataFrame:
    """tld, url, crawl, languages of kv lines; malformed lines go."""
    key, value = F.split(F.substring_index(column, "\t", 1), " "), F.regexp_extract(column, r"\t(.*)$", 1)
    pairs = F.from_json(value, "languages array<array<string>>")["languages"]
    languages = F.transform(pairs, lambda p: F.struct(p[0].alias("lang"), F.floor(p[1].cast("double")).cast("long").alias("bytes")))
    return lines.where((F.size(key) == 3) & pairs.isNotNull()).select(key[0].alias("tld"), key[1].alias("url"), key[2].alias("crawl"), languages.alias("languages"))


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    return parse_kv(spark.read.text(path))


def kv_lines(rows: DataFrame) -> DataFrame:
    """Kv rows as lines again."""
    languages = F.to_json(F.struct(F.transform("languages", lambda x: F.array(x["lang"], x["bytes"].cast("string"))).alias("languages")))
    return rows.select(F.concat(F.concat_ws(" ", "tld", "url", "crawl"), F.lit("\t"), languages).alias("value"))


def parse_lett(lines: DataFrame, html: bool = True, column: str = "value", more: Sequence[str] = ()) -> DataFrame:
    """Documents of lett lines: lang, mime, encoding, url, html, text; base64 is decoded. A seventh column (serialised words) and the columns `more` of lines come along."""
    p = F.split(F.col(column), "\t")
    plain = lambda i: F.try_validate_utf8(F.unbase64(p[i]).cast("string"))
    rows = lines.where(F.size(p) >= 6).select(*more, p[0].alias("lang"), p[1].alias("mime"), p[2].alias("encoding"), p[3].alias("url"), plain(4).alias("html"), plain(5).alias("text"), F.get(p, F.lit(6)).alias("serialized"))
    return rows if html else rows.drop("html")


def lett_lines(docs: DataFrame, source: str, target: str) -> DataFrame:
    """Documents as lett lines, those in the source language first."""
    rows = docs.where(F.col("lang").isin(source, target)).orderBy(F.col("lang") != source, "url")
    one_line = lambda c: F.translate(F.base64(F.encode(c, "UTF-8")), "\r\n", "")
    return rows.select(F.concat_ws("\t", "lang", "mime", "encoding", "url", one_line("html"), one_line("text")).alias("value"))


def site_documents(files: DataFrame, language: Column, keep: list[str] | None = None, ignore_br: bool = False) -> DataFrame:
    """Files of read_tar() as documents: decoded, language found, those without one dropped, text taken from the html."""
    page = files.withColumn("html", T.decoded()(F.col("data"), F.lit(None).cast("string")))
    page = page.withColumn("url", F.when(U.mirrored_from(F.col("html")) != "", U.mirrored_from(F.col("html"))).otherwise(F.col("name")))
    page = page.withColumn("text", T.parsed_html_to_text(ignore_br)(F.col("html"))).withColumn("lang", language).where("lang IS NOT NULL AND lang <> ''")
    if keep:
        page = page.where(F.col("lang").isin(keep))
    return page.select("lang", "mime", F.lit("charset=utf-8").alias("encoding"), "url", "html", "text")


def site_links(files: DataFrame) -> DataFrame:
    """Files of read_tar() as ett rows: html, url, links."""
    page = files.withColumn("html", T.decoded()(F.col("data"), F.lit(None).cast("string")))
    return page.select("html", F.coalesce(F.nullif(U.mirrored_from(F.col("html")), F.lit("")), F.col("name")).alias("url"), T.hrefs(F.col("html")).alias("links"))


def with_translations(docs: DataFrame, sentences: DataFrame, name: str) -> DataFrame:
    """Documents with the sentences (url, pos, text) of their url joined in order."""
    joined = sentences.groupBy("url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n").alias(name))
    return docs.join(joined, "url", "left")


def non_empty(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.where(F.trim(column) != "")


def parse_dictionary(lines: DataFrame, first: str, second: str, header: str, lower: bool = False, column: str = "value") -> DataFrame:
    """Entries w1, w2 of a dictionary whose header line names two languages; columns change places if the header is reversed."""
    langs = header.split()
    if sorted(langs) != sorted([first, second]):
        raise ValueError(f"the dictionary is for {langs}, not for {first} and {second}")
    p = F.split(F.lower(column) if lower else F.col(column), "[\t ]", 2)
    rows = lines.where((F.col(column) != header) & (F.size(p) == 2))
    a, b = (0, 1) if langs[0] == first else (1, 0)
    return rows.select(F.trim(p[a]).alias("w1"), F.trim(p[b]).alias("w2")).distinct()


def read_dictionary(spark: SparkSession, path: str, first: str, second: str, lower: bool = False) -> DataFrame:
    lines = spark.read.text(path)
    return parse_dictionary(lines, first, second, lines.first()["value"], lower)


def read_language_names(spark: SparkSession, path: str) -> DataFrame:
    """Language names and codes: name, code."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(p) >= 2).select(F.upper(p[0]).alias("name"), p[1].alias("code")).distinct()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Gold pairs: src, tgt."""
    return spark.read.csv(path, sep="\t", schema="src string, tgt string")


def parse_groups(lines: DataFrame, column: str = "value") -> DataFrame:
    """n:m gold lines (s.. <-> t..) as pairs: group_id, src, tgt; the id is the line's hash."""
    halves = F.split(F.col(column), "\t<->\t")
    rows = lines.where(F.size(halves) == 2).select(F.xxhash64(column).alias("group_id"), F.split(halves[0], "\t").alias("s"), F.split(halves[1], "\t").alias("t"))
    return rows.select("group_id", F.explode("s").alias("src"), "t").select("group_id", "src", F.explode("t").alias("tgt"))


def parse_old_candidates(lines: DataFrame, column: str = "value") -> DataFrame:
    """Old candidate lines S#:url TAB rule1 TAB rule2: side, url, rule1, rule2; separators go."""
    p = F.split(F.col(column), "\t")
    return lines.where(F.col(column).rlike("^[SD]#:") & (F.size(p) == 3)).select(F.substring(F.col(column), 1, 1).alias("side"), F.substring(p[0], F.lit(4), F.length(p[0])).alias("url"), p[1].cast("int").alias("rule1"), p[2].cast("int").alias("rule2"))


def parse_url_listing(lines: DataFrame, column: str = "value") -> DataFrame:
    """Urls of lines `(S*lang S*)` style: language, url."""
    p = F.split(F.col(column), r"\s+")
    return lines.where(F.size(p) >= 2).select(p[0].alias("lang"), p[1].alias("url"))


def read_crawl_xml(spark: SparkSession, path: str) -> DataFrame:
    """Crawl result pages (XML header): file, title, url, and the mapping in names like 59_12_m.xml: src_file, tgt_file."""
    return parse_crawl_xml(spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value"))


def parse_crawl_xml(raw: DataFrame) -> DataFrame:
    """Texts of crawl result pages (file, value) as read_crawl_xml() has them."""
    plain = lambda x: reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), XML_ENTITIES, x)
    tag = lambda n: F.trim(plain(F.regexp_extract("value", f"(?is)<{n}[^>]*>(.*?)</{n}>", 1)))
    number = lambda k: F.when(F.col("file").rlike(r"^\d+_\d+_\w+\.xml$"), F.concat(F.split("file", "_")[k], F.lit(".xml")))
    return raw.select("file", tag("title").alias("title"), tag("eAddress").alias("url"), number(0).alias("src_file"), number(1).alias("tgt_file"))


def url_map(pages: DataFrame, names: DataFrame, column: str = "file") -> DataFrame:
    """Pages with their file names replaced by urls (file, url)."""
    return pages.join(names, column, "inner").drop(column)


def save_locations(index: DataFrame, path: str) -> None:
    """The location index by crawl, each file sorted by (domain, url) so that prefix queries skip row groups."""
    index.repartitionByRange("crawl", "domain", "url").sortWithinPartitions("crawl", "domain", "url").write.mode("overwrite").partitionBy("crawl").parquet(path)


def save_by_domain(pairs: DataFrame, path: str) -> None:
    """Pairs by domain; a domain of many pairs is dealt over several tasks and files, small ones share a task."""
    pairs.repartitionByRange("domain", F.xxhash64(*pairs.columns)).write.mode("overwrite").partitionBy("domain").parquet(path)


def save_downloads(pages: DataFrame, path: str) -> None:
    """Downloaded pages by domain and language; compressed."""
    pages.repartition("domain", "lang").write.mode("append").partitionBy("domain", "lang").json(path, compression="gzip")


def save_table(rows: DataFrame, path: str) -> None:
    """Score matrices, index maps and corpora: a plain columnar table."""
    rows.write.mode("overwrite").parquet(path)


def keys(index: DataFrame) -> DataFrame:
    return index.select("url")


def nth(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n-th record (from 1) by an order."""
    return rows.orderBy(*order).offset(n - 1).limit(1)
