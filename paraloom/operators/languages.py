"""Languages inside a text: spans of lines by dynamic programming, up to three languages with percent.

The model is a table: a trigram and, for each language, how much it speaks for it (the logarithm of its share
there over FLOOR, 0 where it isn't among the language's most frequent). Lines' trigrams are counted and looked up
in batches of lines, as numbers, so no trigram becomes a row; only a model that is too large for every task is joined. Over the lines
of a text the most likely sequence of languages is found, where each change of language costs SWITCH; neighbours
of one language are a span. Lines without any evidence are unknown, end a span and belong to none.

Blank lines go first, so offsets and bytes are those of the text without them. A null or blank text has no
spans. Of each text the two numbers a line and language meet in one row, not its trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ngrams import strict_ngrams
from .lineage import cut

PER_LANGUAGE, FLOOR, SWITCH = 2000, 1e-6, 12.0
#: Evidence a trigram by which the languages of a text must be ahead of the next ones to be reliable.
MARGIN = 0.3
#: Characters whose trigrams are worked on at once.
SLICE = 1 << 20
#: Numbers of a model up to which it goes to every task; a larger one is joined by shuffle.
SMALL_MODEL = 1 << 21
UNKNOWN = "un"


@dataclass(frozen=True)
class TrigramTable:
    """Languages in order, and the table (gram, evidence: a number for each of them)."""

    languages: list[str]
    table: DataFrame

    def small(self) -> bool:
        return self.table.count() * len(self.languages) <= SMALL_MODEL

    def joined(self) -> DataFrame:
        return F.broadcast(self.table) if self.small() else self.table


def fit(docs: DataFrame, text: str = "text", language: str = "lang", per_language: int = PER_LANGUAGE) -> TrigramTable:
    """The table of the per_language most frequent trigrams of each language, counted over all texts."""
    lines = docs.where(F.col(language).isNotNull()).select(F.col(language).cast("string").alias("l"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    seen = cut(lines.select("l", letters(F.col("line")).alias("x")).mapInArrow(_counted, "l string, gram string, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")))
    totals = seen.groupBy("l").agg(F.sum("n").alias("total"))
    names = sorted(r.l for r in totals.select("l").collect())
    top = seen.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= per_language)
    speaks = top.join(F.broadcast(totals), "l").select("l", "gram", F.greatest(F.log(F.col("n") / F.col("total")) - F.log(F.lit(FLOOR)), F.lit(0.0)).alias("w"))
    table = speaks.groupBy("gram").agg(F.array(*(F.coalesce(F.max(F.when(F.col("l") == x, F.col("w"))), F.lit(0.0)) for x in names)).alias("evidence"))
    return TrigramTable(names, cut(table))


def best_path(evidence: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each line (rows of evidence): largest sum, less `switch` a change; of equal ones no change, then the first."""
    back, best = np.zeros(evidence.shape, int), np.zeros(evidence.shape[1])
    own = np.arange(evidence.shape[1])
    for t, line in enumerate(evidence):
        top = best.argmax()
        stays = best >= best[top] - switch
        back[t] = np.where(stays, own, top)
        best = line + np.where(stays, best, best[top] - switch)
    path, at = np.zeros(len(evidence), int), int(best.argmax()) if len(best) else 0
    for t in range(len(evidence) - 1, -1, -1):
        path[t] = at
        at = back[t, at]
    return path


def letters(line: Column) -> Column:
    """A line's letters in lower case between blanks, all else being one blank."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "), F.lit(" "))


def line_trigrams(line: Column) -> Column:
    """Trigrams of letters(line); linear in the line."""
    return strict_ngrams(F.split(letters(line), ""), 3, "")


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of some texts in order, as numbers of 21 bits a character, and how many each text has."""
    sizes = np.array([len(x) for x in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    codes = c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
    row = np.repeat(np.arange(len(texts)), sizes)
    return codes[row[:-2] == row[2:]], np.maximum(sizes - 2, 0)


def code_of(gram: str) -> int:
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


def gram_of(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _sliced(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about SLICE characters."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (l, x) to counts of their trigrams, summed a batch."""
    for batch in batches:
        of: dict[str, list[str]] = {}
        for language, x in zip(batch.column("l").to_pylist(), batch.column("x").to_pylist(), strict=True):
            of.setdefault(language, []).append(x or "")
        for language, texts in of.items():
            for part in _sliced(texts):
                codes, n = np.unique(gram_codes(part)[0], return_counts=True)
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes), pa.string()), pa.array([gram_of(c) for c in codes.tolist()], pa.string()), pa.array(n, pa.int64())], names=["l", "gram", "n"])


def _evidence(model: TrigramTable):
    """letters(line) to its number of trigrams and their evidence for each language, by a model that every task has."""
    rows = sorted((code_of(r.gram), r.evidence) for r in model.table.toLocalIterator())
    none = [0.0] * len(model.languages)
    shared = model.table.sparkSession.sparkContext.broadcast((np.array([c for c, _ in rows], np.uint64), np.array([*(e for _, e in rows), none], np.float64).reshape(len(rows) + 1, -1)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, evidence = shared.value
        for batch in batches:
            sums, sizes = [np.zeros((0, evidence.shape[1]))], [np.zeros(0, np.int64)]
            for part in _sliced(batch.tolist()):
                codes, n = gram_codes(part)
                at = np.searchsorted(known, codes)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == codes[hit]
                at[~hit] = len(known)  # the row of zeros
                row = np.repeat(np.arange(len(part)), n)
                sums.append(np.column_stack([np.bincount(row, evidence[at, i], len(part)) for i in range(evidence.shape[1])]) if evidence.shape[1] else np.zeros((len(part), 0)))
                sizes.append(n)
            yield pd.DataFrame({"n": np.concatenate(sizes), "evidence": list(np.concatenate(sums))})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "n long, evidence array<double>")


SPAN = "array<struct<language:string,line:int,lines:int,offset:long,bytes:long,ahead:double>>"


def _spans(languages: list[str], switch: float) -> Column:
    """Lines of a text (struct<pos, size, evidence>, sorted) to spans; ahead is their evidence over that of the next language."""

    def one(lines) -> list[dict]:
        if not len(lines):
            return []
        evidence = np.array([x["evidence"] for x in lines]).reshape(len(lines), -1)
        path, size = best_path(evidence, switch), np.array([x["size"] for x in lines])
        rows = np.arange(len(lines))
        rest = evidence.copy()
        rest[rows, path] = -np.inf
        ahead = evidence[rows, path] - (rest.max(1) if len(languages) > 1 else 0)
        path[(evidence <= 0).all(1)] = -1
        offset = np.cumsum(size) - size
        starts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        ends = np.append(starts[1:], len(lines))
        return [{"language": languages[path[s]], "line": int(s), "lines": int(e - s), "offset": int(offset[s]), "bytes": int(size[s:e].sum()), "ahead": float(ahead[s:e].sum())} for s, e in zip(starts, ends, strict=True) if path[s] >= 0]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(one)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, SPAN)


def language_spans(docs: DataFrame, model: TrigramTable, key: list[str], text: str = "text", switch: float = SWITCH) -> DataFrame:
    """Per row of docs: the key, kept (its lines that are not blank), grams (their trigrams) and spans."""
    kept = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    held = cut(docs.select(*key, kept.alias("kept")).withColumn("__id", F.monotonically_increasing_id()))
    lines = held.select("__id", F.posexplode("kept").alias("pos", "line"))
    zero = F.array(*[F.lit(0.0)] * len(model.languages))
    size = (F.octet_length("line") + 1).cast("long").alias("size")
    if model.small():
        sized = lines.select("__id", "pos", size, _evidence(model)(letters(F.col("line"))).alias("s")).select("__id", "pos", "size", "s.n", "s.evidence")
    else:
        grams = lines.select("__id", "pos", F.explode(line_trigrams(F.col("line"))).alias("gram"))
        sums = [F.sum(F.coalesce(F.get("evidence", F.lit(i)), F.lit(0.0))) for i in range(len(model.languages))]
        scored = grams.join(model.table, "gram", "left").groupBy("__id", "pos").agg(F.array(*sums).alias("evidence"), F.count(F.lit(1)).alias("n"))
        sized = lines.select("__id", "pos", size).join(scored, ["__id", "pos"], "left")
    line = F.struct("pos", "size", F.coalesce("evidence", zero).alias("evidence"))
    texts = sized.groupBy("__id").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("grams"))
    found = texts.select("__id", "grams", _spans(model.languages, switch)("lines").alias("spans"))
    none = F.expr(f"cast(array() as {SPAN})")
    return held.join(found, "__id", "left").select(*key, "kept", F.coalesce("grams", F.lit(0)).alias("grams"), F.coalesce("spans", none).alias("spans"))


def span_rows(found: DataFrame, key: list[str]) -> DataFrame:
    """One row a span: key, language, line (of those that are not blank), lines, offset, bytes, text."""
    rows = found.select(*key, "kept", F.explode("spans").alias("s"))
    text = F.array_join(F.slice("kept", F.col("s.line") + 1, F.col("s.lines")), "\n")
    return rows.select(*key, "s.language", "s.line", "s.lines", "s.offset", "s.bytes", text.alias("text"))


def text_languages(found: DataFrame, key: list[str], most: int = 3, margin: float = MARGIN) -> DataFrame:
    """key, languages (the `most` largest, with whole percent of the bytes of all spans, from the largest on) and reliable."""
    each = found.select(*key, "grams", "spans", F.monotonically_increasing_id().alias("__id"))
    names = F.array_distinct(F.transform("spans", lambda s: s["language"]))
    add = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)
    all_bytes = F.col("all_bytes")
    each = each.withColumn("all_bytes", add(F.transform("spans", lambda s: s["bytes"])))
    share = lambda name: add(F.transform(F.filter("spans", lambda s: s["language"] == name), lambda s: s["bytes"]))
    ordered = F.array_sort(F.transform(names, lambda n: F.struct((-share(n)).alias("less"), n.alias("language"))))
    languages = F.transform(F.slice(ordered, 1, most), lambda x: F.struct(x["language"].alias("language"), F.floor(-100 * x["less"] / all_bytes).cast("int").alias("percent")))
    ahead = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["ahead"])
    return each.select(*key, languages.alias("languages"), ((F.col("grams") > 0) & (ahead / F.col("grams") > margin)).alias("reliable"))


def accepts(languages: Column, reliable: Column, expected: Column | str, least: int = 10) -> Column:
    """Whether a text counts as in the expected language: it has `least` percent of it, or the finding isn't reliable."""
    expected = F.lit(expected) if isinstance(expected, str) else expected
    return ~reliable | F.exists(languages, lambda x: (x["language"] == expected) & (x["percent"] >= least))
