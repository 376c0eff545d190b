"""Crawl archives: WET, WAT, CDX, archive metadata, WARC records, tar files, magic-header streams.

Readers of text formats use Spark's own text source with a record separator, so
files are read once and split by Spark; binary containers are opened per file.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the header mark of span streams.
MAGIC = "df6fa1abb58549287111ba8d776733e9"
BLANK_LINE = r"\r?\n\r?\n"


def header(record: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(record, f"(?m)^{name}:[ \\t]*([^\\r\\n]*)", 1))


def field(line: Column, name: str) -> Column:
    """A name:value field of a header line; the value ends at a blank."""
    return F.regexp_extract(line, f"(?:^|\\s){name}:(\\S+)", 1)


def read_wet(spark: SparkSession, path: str) -> DataFrame:
    """Conversion records: uri, text. A record without a blank line after its text is not complete and goes."""
    raw = spark.read.text(path, lineSep="WARC/1.0")
    parts = F.split(F.col("value"), BLANK_LINE, 3)
    rows = raw.select(header(parts[0], "WARC-Type").alias("kind"), header(parts[0], "WARC-Target-URI").alias("uri"), F.get(parts, F.lit(1)).alias("text"), F.size(parts).alias("n"))
    return rows.where("kind = 'conversion' AND uri <> '' AND n = 3").select("uri", "text")


WAT = "Container struct<Offset:string,Filename:string,`Gzip-Metadata`:struct<`Deflate-Length`:string>>, Envelope struct<`WARC-Header-Metadata`:struct<`WARC-Target-URI`:string>,`Payload-Metadata`:struct<`HTTP-Response-Metadata`:struct<Headers:struct<`Content-Type`:string>,`HTML-Metadata`:struct<Links:array<struct<path:string,url:string,text:string>>>>>>"


def read_wat(spark: SparkSession, path: str, links: bool = True, pdf_only: bool = False) -> DataFrame:
    """Pages of WAT JSON lines: uri, content_type, container, links; lines without one of these go."""
    parsed = spark.read.text(path).where("value LIKE '{%'").select(F.from_json("value", WAT).alias("w"))
    http = F.col("w.Envelope.Payload-Metadata.HTTP-Response-Metadata")
    rows = parsed.select(F.col("w.Envelope.WARC-Header-Metadata.WARC-Target-URI").alias("uri"), http["Headers"]["Content-Type"].alias("content_type"), F.col("w.Container").alias("container"), http["HTML-Metadata"]["Links"].alias("links"))
    rows = rows.where("uri IS NOT NULL AND content_type IS NOT NULL AND container IS NOT NULL AND links IS NOT NULL")
    if pdf_only:
        return rows.select("uri", F.explode(F.filter("links", is_pdf_link)).alias("link")).select("uri", "link.url", "link.text")
    return rows if links else rows.drop("links")


def is_pdf_link(link: Column) -> Column:
    """A link of an anchor whose url ends in .pdf or whose text mentions pdf."""
    return (F.substring_index(link["path"], "@", 1) == "A") & (F.lower(link["url"]).endswith(".pdf") | F.lower(F.coalesce(link["text"], F.lit(""))).contains("pdf"))


CDX = "url string, filename string, offset string, length string, mime string, status string"


def read_cdx(spark: SparkSession, path: str, crawl: str) -> DataFrame:
    return parse_cdx(spark.read.text(path), crawl)


def parse_cdx(lines: DataFrame, crawl: str, column: str = "value") -> DataFrame:
    """Index entries (several a line may be): url, crawl, location."""
    each = lines.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r'(\S+\s\S+\s\{[^}]+"\})'), F.lit(1))).alias("e"))
    j = F.from_json(F.regexp_extract("e", r"(\{.*\})", 1), CDX)
    rows = each.select(j.alias("j")).where("j.url IS NOT NULL")
    return rows.select("j.url", F.lit(crawl).alias("crawl"), F.struct(F.col("j.filename").alias("filename"), F.col("j.offset").cast("long").alias("offset"), F.col("j.length").cast("long").alias("length"), F.coalesce("j.mime", F.lit("UNKNOWN")).alias("mime")).alias("location"))


def wat_locations(wat: DataFrame, crawl: str) -> DataFrame:
    """Locations of read_wat() pages: url, crawl, location."""
    c = F.col("container")
    return wat.select(F.col("uri").alias("url"), F.lit(crawl).alias("crawl"), F.struct(c["Filename"].alias("filename"), c["Offset"].cast("long").alias("offset"), c["Gzip-Metadata"]["Deflate-Length"].cast("long").alias("length"), F.lit("UNKNOWN").alias("mime")).alias("location"))


def parse_arc_metadata(lines: DataFrame, crawl: str) -> DataFrame:
    """Old metadata (url TAB json): entries with result 200, archive info and a text type."""
    kind = "http_result int, mime_type string, archiveInfo struct<arcFileDate:string,arcFileParition:string,arcSourceSegmentId:string,arcFileOffset:string,compressedSize:string>"
    rows = lines.select(F.substring_index("value", "\t", 1).alias("url"), F.from_json(F.regexp_extract("value", r"\t(.*)$", 1), kind).alias("j"))
    rows = rows.where("j.http_result = 200 AND j.archiveInfo IS NOT NULL AND j.mime_type LIKE 'text/%'")
    a = F.col("j.archiveInfo")
    name = F.concat_ws("_", F.concat_ws("/", a["arcSourceSegmentId"], a["arcFileDate"]), F.concat(a["arcFileParition"], F.lit(".arc.gz")))
    return rows.select("url", F.lit(crawl).alias("crawl"), F.struct(name.alias("filename"), a["arcFileOffset"].cast("long").alias("offset"), a["compressedSize"].cast("long").alias("length"), F.col("j.mime_type").alias("mime")).alias("location"))


def record_body(record: Column) -> Column:
    """What comes after the second blank line: WARC header, HTTP header, body."""
    return F.get(F.split(record, BLANK_LINE, 3), F.lit(2))


def record_bodies(records: DataFrame, column: str = "record") -> DataFrame:
    return records.withColumn("body", record_body(F.col(column)))


def retried(fetch: Callable[[str, int, int], bytes], tries: int = 5, pause: float = 1.0) -> Callable[[str, int, int], bytes]:
    """fetch with repeats after errors; empty bytes if all fail."""

    def run(name: str, offset: int, length: int) -> bytes:
        for k in range(tries):
            try:
                return fetch(name, offset, length)
            except OSError:
                if k + 1 < tries:
                    time.sleep(pause)
        return b""

    return run


def fetched(located: DataFrame, fetch: Callable[[str, int, int], bytes], html_only: bool = False) -> DataFrame:
    """Rows (url, location) with the gunzipped record of each location; what can't be had is empty. fetch gives bytes offset..offset+length-1."""
    get = retried(fetch)

    def one(name: str, offset: int, length: int) -> bytes:
        try:
            return gzip.decompress(get(name, offset, length))
        except (OSError, EOFError):
            return b""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"url": pdf["url"], "record": [one(n, o, k) for n, o, k in zip(pdf["filename"], pdf["offset"], pdf["length"], strict=True)]})

    rows = located.where("location.mime IN ('text/html', 'UNKNOWN')") if html_only else located
    return rows.select("url", "location.filename", "location.offset", "location.length").mapInPandas(run, "url string, record binary")


def range_reader(root: str) -> Callable[[str, int, int], bytes]:
    """A fetch of byte ranges under a mounted folder."""

    def fetch(name: str, offset: int, length: int) -> bytes:
        with open(f"{root}/{name}", "rb") as f:
            f.seek(offset)
            return f.read(length)

    return fetch


def read_magic(spark: SparkSession, path: str) -> DataFrame:
    """Records of a magic-header stream: uri, language, offset, bytes, text."""
    raw = spark.read.text(path, lineSep=MAGIC).where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    number = lambda n: F.floor(field(head, n).try_cast("double")).cast("long")
    return raw.select(field(head, "uri").alias("uri"), field(head, "language").alias("language"), number("offset").alias("offset"), number("bytes").alias("bytes"), F.regexp_replace("value", "^[^\n]*\n", "").alias("text"))


def read_percent_stream(spark: SparkSession, path: str) -> DataFrame:
    """Records of a percent stream: uri, encoding, tld, domain, bytes, langs."""
    raw = spark.read.text(path, lineSep=MAGIC).where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    rows = F.filter(F.split(F.regexp_replace("value", "^[^\n]*\n?", ""), "\n"), lambda x: F.trim(x) != "")
    langs = F.transform(rows, lambda x: F.struct(F.split(x, r"\s+")[0].alias("lang"), F.split(x, r"\s+")[1].cast("double").alias("percent"), F.split(x, r"\s+")[2].cast("double").alias("score")))
    return raw.select(*(field(head, n).alias(n) for n in ("uri", "encoding", "tld", "domain")), field(head, "bytes").cast("long").alias("bytes"), langs.alias("langs"))


def read_tar(spark: SparkSession, path: str, mime: tuple[str, ...] = ("text/html", "text/plain", "application/xml")) -> DataFrame:
    """Files of gzipped tar archives of web sites: archive, name, mime, data."""
    return tar_files(spark.read.format("binaryFile").load(path).select("path", "content"), mime)


def tar_files(archives: DataFrame, mime: tuple[str, ...] = ("text/html", "text/plain", "application/xml")) -> DataFrame:
    """Files of tar archives (path, content): archive, name, mime, data."""
    import mimetypes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for member in tar:
                        kind = mimetypes.guess_type(member.name)[0] or "text/html"
                        if member.isfile() and kind in mime:
                            yield pd.DataFrame({"archive": [archive], "name": [member.name], "mime": [kind], "data": [tar.extractfile(member).read()]})

    return archives.select("path", "content").mapInPandas(run, "archive string, name string, mime string, data binary")
