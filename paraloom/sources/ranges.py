"""Byte ranges of archive files: located records, read with few requests, as a Spark data source.

Neighbouring records of a file are read as one range. Ranges are planned by Spark:
locations are made distinct, merged inside spans of a file's bytes (so a range and a
group of the plan are bounded, whatever the size of a file) and written in order, a
partition of about TASK_BYTES a file. The data source `archive_ranges` makes a task of each row
group of that plan; what the driver lists are these row groups, not the locations. The plan
and the archives must lie where Arrow's file systems reach (archives also over HTTP).

A reader's session is kept for a task. After an error it is opened anew and the range asked for
again, the last time without a session; what can't be had, isn't a gzip member or
has another status than 200 to 299 is an empty record, never a failed task.
"""

from __future__ import annotations

import time
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from http.client import HTTPConnection, HTTPException, HTTPResponse, HTTPSConnection

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators.lineage import cut, new_path

#: Unwanted bytes that are rather read than asked around, and the span of a file in which ranges are merged.
GAP, SPAN = 64 << 10, 16 << 20
TRIES, PAUSE, TIMEOUT = 5, 1.0, 5.0
#: Bytes that one task reads, about; a request counts as GAP bytes.
TASK_BYTES = 256 << 20
RECORDS = "url string, filename string, offset long, length long, record binary, range_start long"
RECORD_SHAPE = pa.schema([("url", pa.string()), ("filename", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record", pa.binary()), ("range_start", pa.int64())])
PLACE_SHAPE = pa.struct([("filename", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("mime", pa.string())])


def planned(located: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """Rows (url, location) to ranges: filename, start, length, members. A url and place named twice is read once."""
    places = located.select("url", "location.filename", F.col("location.offset").cast("long").alias("offset"), F.col("location.length").cast("long").alias("length"))
    places = places.where("filename IS NOT NULL AND offset >= 0 AND length > 0").distinct().withColumn("part", F.floor(F.col("offset") / span))
    w = Window.partitionBy("filename", "part").orderBy("offset", "length", "url")
    end = F.max(F.col("offset") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = places.withColumn("new", F.coalesce(F.col("offset") > end + gap, F.lit(False)).cast("int")).withColumn("run", F.sum("new").over(w))
    members = F.sort_array(F.collect_list(F.struct("offset", "length", "url")))
    ranges = runs.groupBy("filename", "part", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), members.alias("members"))
    return ranges.select("filename", "start", (F.col("end") - F.col("start")).alias("length"), "members")


class Session:
    """Ranges of files under a root: over HTTP with a connection that is kept, else by the file system of the root's scheme."""

    def __init__(self, root: str, timeout: float = TIMEOUT) -> None:
        self.root, self.timeout, self.connection = root.rstrip("/"), timeout, None
        self.url = urllib.parse.urlsplit(self.root) if self.root.startswith(("http://", "https://")) else None
        self.files = None if self.url else fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))

    def close(self) -> None:
        if self.connection:
            self.connection.close()
        self.connection = None

    def _connect(self) -> HTTPConnection:
        return (HTTPSConnection if self.url.scheme == "https" else HTTPConnection)(self.url.netloc, timeout=self.timeout)

    def fetch(self, name: str, start: int, length: int, keep: bool = True) -> bytes | None:
        """The bytes of a range; None for a status that is no success. Errors are raised."""
        if not self.url:
            system, folder = self.files
            with system.open_input_file(f"{folder}/{name}") as f:
                return f.read_at(min(length, max(0, f.size() - start)), start)
        if not keep:
            self.close()
        self.connection = self.connection or self._connect()
        headers = {"Range": f"bytes={start}-{start + length - 1}"} | ({} if keep else {"Connection": "close"})
        self.connection.request("GET", urllib.parse.quote(f"{self.url.path}/{name}"), headers=headers)
        answer: HTTPResponse = self.connection.getresponse()
        body = answer.read()
        if not 200 <= answer.status <= 299:
            return None
        return body if answer.status == 206 else body[start : start + length]


def patient(session: Session, tries: int = TRIES, pause: float = PAUSE) -> Callable[[str, int, int], bytes]:
    """session.fetch with repeats: after an error the session is opened anew, the last try goes without it; empty if none succeeds."""

    def run(name: str, start: int, length: int) -> bytes:
        for k in range(tries + 1):
            try:
                return session.fetch(name, start, length, keep=k < tries) or b""
            except (OSError, HTTPException, pa.ArrowException):
                session.close()
                if k < tries:
                    time.sleep(pause)
        return b""

    return run


def unpacked(member: bytes) -> bytes:
    """The first gzip member; empty if it is none or is cut."""
    inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
    try:
        found = inflate.decompress(member)
    except zlib.error:
        return b""
    return found if inflate.eof else b""


class RowGroup(InputPartition):
    """One row group of a file of the plan; of an empty plan one without path."""

    def __init__(self, path: str = "", number: int = 0) -> None:
        super().__init__((path, number))


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.plan, self.root = options["path"], options["root"]
        self.tries, self.pause, self.timeout = int(options.get("tries", TRIES)), float(options.get("pause", PAUSE)), float(options.get("timeout", TIMEOUT))

    def partitions(self) -> list[RowGroup]:
        system, folder = _system(self.plan)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet"))
        groups = []
        for path in files:
            with system.open_input_file(path) as f:
                groups += [RowGroup(path, i) for i in range(pq.ParquetFile(f).num_row_groups)]
        return groups or [RowGroup()]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        path, number = partition.value
        if not path:
            return
        system, _ = _system(self.plan)
        session = Session(self.root, self.timeout)
        fetch = patient(session, self.tries, self.pause)
        with system.open_input_file(path) as f:
            for r in pq.ParquetFile(f).read_row_group(number).to_pylist():
                data = fetch(r["filename"], r["start"], r["length"])
                members = ((m, m["offset"] - r["start"]) for m in r["members"])
                rows = [{"url": m["url"], "filename": r["filename"], "offset": m["offset"], "length": m["length"], "record": unpacked(data[at : at + m["length"]]), "range_start": r["start"]} for m, at in members]
                yield pa.RecordBatch.from_pylist(rows, RECORD_SHAPE)
        session.close()


class ArchiveRanges(DataSource):
    """`archive_ranges`: the records of a written plan (path) in the files under root; options tries, pause, timeout."""

    @classmethod
    def name(cls) -> str:
        return "archive_ranges"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(dict(self.options))


def read_ranges(located: DataFrame, root: str, gap: int = GAP, span: int = SPAN, **options: str) -> DataFrame:
    """The gunzipped records of rows (url, location): url, filename, offset, length, record (empty if it can't be had) and the start of the range it was read with."""
    spark: SparkSession = located.sparkSession
    path, ranges = new_path(spark, "ranges"), cut(planned(located, gap, span))
    tasks = ranges.agg(F.ceil(F.coalesce(F.sum(F.col("length") + GAP), F.lit(1)) / TASK_BYTES)).first()[0]
    ranges.repartitionByRange(tasks, "filename", "start").sortWithinPartitions("filename", "start").write.parquet(path)
    spark.dataSource.register(ArchiveRanges)
    return spark.read.format("archive_ranges").options(root=root, **options).load(path)


def stored_archives(records: DataFrame, root: str) -> DataFrame:
    """Records (url, record) as gzip members of one archive file a partition, under root; returns (url, location)."""
    kind = "url string, location struct<filename:string,offset:long,length:long,mime:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _system(root)
        system.create_dir(folder, recursive=True)
        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in batches:
                places = []
                for record in batch.column("record").to_pylist():
                    pack = zlib.compressobj(wbits=zlib.MAX_WBITS | 16)
                    member = pack.compress(record or b"") + pack.flush()
                    out.write(member)
                    places.append({"filename": name, "offset": at, "length": len(member), "mime": "text/html"})
                    at += len(member)
                yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(places, PLACE_SHAPE)], names=["url", "location"])

    return records.select("url", F.col("record").cast("binary").alias("record")).mapInArrow(run, kind)


def dumped(records: DataFrame, magic: str, html_only: bool = False) -> DataFrame:
    """Lines of a dump (value): a header of the magic number and the url, then the record or its body; records that are empty go."""
    from .archives import record_body

    text = F.decode("record", "UTF-8")
    body = record_body(text) if html_only else text
    full = records.where(F.octet_length("record") > 0)
    return full.select(F.concat(F.lit(f"{magic} "), "url", F.lit("\n"), body, F.lit("\n")).alias("value"))
