"""Bytes of unknown encoding as text, with a hint of their language: the decoding that reads most like that language.

The hint names the encodings that its texts come in. Bytes that are UTF-8 with characters of several bytes are that: other
encodings hardly make such sequences, while a foreign word can make its misreading score higher. Else, of those that decode without an error, the text whose trigrams speak
most for the language on the mean is taken (the table of operators.languages, joined); of equal ones the first. Without a
hint all encodings are tried and the language found with the text is told. Bytes that no encoding of the hint decodes
are read by the first one, without what can't be read. Null bytes have null text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import TrigramTable, line_trigrams
from .lineage import cut

#: Encodings of web pages by language code; the others have those of OTHER.
ENCODINGS = {
    **dict.fromkeys(("en", "fr", "de", "es", "it", "pt", "nl", "fi"), ["utf-8", "windows-1252", "iso-8859-15", "utf-16"]),
    **dict.fromkeys(("cs", "pl", "hu", "ro"), ["utf-8", "windows-1250", "iso-8859-2", "utf-16"]),
    **dict.fromkeys(("ru", "bg"), ["utf-8", "windows-1251", "koi8-r", "iso-8859-5", "utf-16"]),
    "el": ["utf-8", "windows-1253", "iso-8859-7", "utf-16"],
    "tr": ["utf-8", "windows-1254", "iso-8859-9", "utf-16"],
    "ar": ["utf-8", "windows-1256", "iso-8859-6", "utf-16"],
    "ja": ["utf-8", "shift_jis", "euc-jp", "iso-2022-jp"],
    "zh": ["utf-8", "gb18030", "big5"],
}
OTHER = ["utf-8", "iso-8859-1", "windows-1252"]
TRIED = "encoding string, rank int, text string"


def _all(hints: list[str]) -> list[str]:
    return list(dict.fromkeys(e for h in hints for e in ENCODINGS.get(h, OTHER)))


def _decodings(languages: list[str]):
    """Each row's bytes in all encodings of its hint that decode them; else in the first one as far as it goes."""

    def names_of(hint: str | None, data: bytes) -> list[str]:
        names = ENCODINGS.get(hint, OTHER) if hint else _all(languages)
        if not data.isascii() and b"\0" not in data and "utf-8" in names:
            try:
                data.decode("utf-8")
                return ["utf-8"]
            except UnicodeDecodeError:
                pass
        return names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for number, hint, data in zip(*(batch.column(c).to_pylist() for c in ("__id", "hint", "data")), strict=True):
                names, found = names_of(hint, data), []
                for rank, name in enumerate(names):
                    try:
                        text = data.decode(name)
                    except (UnicodeDecodeError, UnicodeError):
                        continue
                    if text not in (f["text"] for f in found):
                        found.append({"__id": number, "encoding": name, "rank": rank, "text": text})
                rows += found or [{"__id": number, "encoding": names[0], "rank": 0, "text": data.decode(names[0], "ignore")}]
            shape = pa.schema([("__id", pa.int64()), ("encoding", pa.string()), ("rank", pa.int32()), ("text", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, shape)

    return run


def to_unicode(docs: DataFrame, model: TrigramTable, key: list[str], data: str = "data", hint: str | None = None) -> DataFrame:
    """Per row of docs: key, text, encoding and language (the hint, else the language that the text speaks most for; null without any)."""
    given = F.col(hint) if hint else F.lit(None).cast("string")
    held = cut(docs.select(*key, F.col(data).alias("data"), given.alias("hint")).withColumn("__id", F.monotonically_increasing_id()))
    tried = cut(held.where("data IS NOT NULL").select("__id", "hint", "data").mapInArrow(_decodings(model.languages), f"__id long, {TRIED}"))
    several = tried.groupBy("__id").agg(F.count(F.lit(1)).alias("n"))
    # evidence is asked for only where there is a choice, or a language is to be found
    asked = tried.join(several, "__id").join(held.select("__id", "hint"), "__id").where("n > 1 OR hint IS NULL")
    grams = asked.select("__id", "rank", "hint", F.explode(F.split("text", "\n")).alias("line")).select("__id", "rank", "hint", F.explode(line_trigrams(F.col("line"))).alias("gram"))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("language"), F.get("evidence", F.lit(i)).alias("w")) for i, x in enumerate(model.languages)))).alias("s")
    # of all trigrams of a reading the mean: one that the table lacks counts as 0
    none = F.array(*[F.lit(0.0)] * len(model.languages))
    told = grams.join(model.joined(), "gram", "left").withColumn("evidence", F.coalesce("evidence", none)).select("__id", "rank", "hint", each).where("hint IS NULL OR s.language = hint")
    sums = told.groupBy("__id", "rank", "s.language").agg(F.avg("s.w").alias("evidence"))
    best = sums.groupBy("__id", "rank").agg(F.max(F.struct("evidence", "language")).alias("b")).select("__id", "rank", "b.evidence", "b.language")
    order = F.struct(F.coalesce("evidence", F.lit(0.0)), -F.col("rank"))
    chosen = tried.join(best, ["__id", "rank"], "left").groupBy("__id").agg(F.max_by(F.struct("text", "encoding", F.when(F.col("evidence") > 0, F.col("language")).alias("language")), order).alias("c"))
    return held.select(*key, "hint", "__id").join(chosen, "__id", "left").select(*key, "c.text", "c.encoding", F.coalesce("hint", "c.language").alias("language"))
