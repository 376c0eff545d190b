"""Language identification of texts that may mix languages: shares of each learned language by expectation-maximisation.

A text is the multiset of the letter trigrams of its lower-cased words (with a space
before and after each), hashed to SLOTS numbers. Each language is the distribution of these
over all its training texts, mixed with a little of the distribution over all
languages and of an even one, so what no language has seen speaks for none. A text's
shares are those under which a mixture of the languages is most likely, by ROUNDS
steps of expectation-maximisation; the set of languages grows from the single most likely one,
the next candidate being that of the largest share among all, as long as the
likelihood gains more than PENALTY times the logarithm of the number of trigrams.

Counts are summed over all training texts, none is left out; what the driver gets and
broadcasts is SLOTS numbers a language, for MAX_LANGUAGES at most (more are an error: that
is no column of languages). Texts are worked on in pieces of PIECE characters, cut between words, so
a long text needs no more memory than its distinct trigrams, SLOTS at most.

Defined cases: a null text, one without letters and any text if nothing could be learned are
`und` with score 0 and no languages; rows without lang and held-out rows (crc32 of the
key as text, null as empty, divided by FOLDS leaves 0) teach nothing; ties go to the
language first in byte order; repeated rows teach as often as they occur; a word of
over PIECE letters is cut every PIECE letters; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, mixed, small_batches, written

SLOTS, ROUNDS, PENALTY, FOLDS, MAX_LANGUAGES = 1 << 16, 20, 3.0, 5, 128
#: Of each language's distribution: the share of that over all languages, and of the even one.
SHARED, EVEN = 0.004, 0.004
#: Characters worked on at once, and numbers of an array of trigrams times languages.
PIECE, CELLS = 1 << 20, 1 << 21
NO_LANGUAGE = "und"
NON_LETTER = re.compile(r"[\W\d_]")


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `most` characters, cut where no word is."""
    start = 0
    while len(text) - start > most:
        found = NON_LETTER.search(text, start + most, start + 2 * most)
        stop = found.start() if found else min(len(text), start + 2 * most)
        yield text[start:stop]
        start = stop
    yield text[start:]


def trigram_slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all trigrams of the texts, as they come, and the n+1 offsets of the texts."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([0, *map(len, lowered)])
    letter = letters()[codes]
    before = np.concatenate(([False], letter[:-1]))
    before[ends[:-1]] = True  # the space that opens a text
    kept = letter | before
    # of what no letter is, only the place next to a word counts; a word starts after one
    at = np.flatnonzero(kept)
    code = np.where(letter[at], codes[at], 32).astype(np.uint64)
    middle = np.flatnonzero(letter[at])
    gram = code[middle - 1] | (code[middle] << np.uint64(21)) | (code[middle + 1] << np.uint64(42))
    slots = (mixed(gram) >> np.uint64(48)).astype(np.uint16)
    return slots, np.searchsorted(at[middle], ends)


def _blocks(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts, about PIECE characters together, with the place of each one's text."""
    places, held, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text or ""):
            places.append(i)
            held.append(piece)
            size += len(piece)
            if size >= PIECE:
                yield places, held
                places, held, size = [], [], 0
    if held:
        yield places, held


def learned_from(key: Column) -> Column:
    """Whether a row may teach."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS != 0


def trigram_counts(rows: DataFrame) -> DataFrame:
    """(lang, text) to (lang, slot, n): how often each language has each slot, over all rows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                slots = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(slots), np.int32))), pa.array(slots.astype(np.int32)), pa.array(counts[slots])], names=["lang", "slot", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for places, texts in _blocks(batch.column("text").to_pylist()):
                slots, ends = trigram_slots(texts)
                for place, s, e in zip(places, ends[:-1], ends[1:], strict=True):
                    if langs[place] not in held:
                        if len(held) >= 64:
                            yield from given()
                        held[langs[place]] = np.zeros(SLOTS, np.int64)
                    if e - s < 4096:
                        np.add.at(held[langs[place]], slots[s:e], 1)
                    else:
                        held[langs[place]] += np.bincount(slots[s:e], minlength=SLOTS)
        yield from given()

    return rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Names in byte order, and the probability of each slot (rows) in each language."""

    languages: list[str]
    probabilities: np.ndarray


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows that may teach."""
    rows = docs.where(learned_from(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)
    counts = written(trigram_counts(rows), "trigrams")
    names = sorted((r.lang for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()), key=str.encode)
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((SLOTS, len(names)))
    number = {n: i for i, n in enumerate(names)}
    found = counts.toArrow()
    if found.num_rows:
        table[found.column("slot").to_numpy(), [number[n] for n in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    own, shared = table / np.maximum(table.sum(0), 1), table.sum(1, keepdims=True) / max(table.sum(), 1)
    return Model(names, ((1 - SHARED - EVEN) * own + SHARED * shared + EVEN / SLOTS).astype(np.float32))


class Texts:
    """The distinct trigrams of some texts, their counts and their probabilities in each language."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], probabilities: np.ndarray) -> None:
        self.p = probabilities[np.concatenate([g[0] for g in grams])].astype(np.float64)
        self._held([g[1] for g in grams])

    def _held(self, counts: list[np.ndarray]) -> None:
        self.counts = counts
        self.n = np.concatenate(counts).astype(np.float64)
        sizes = np.array([len(c) for c in counts])
        self.starts, self.owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(counts)), sizes)
        self.total = np.add.reduceat(self.n, self.starts)

    def only(self, which: np.ndarray) -> Texts:
        """Those of the texts."""
        part = object.__new__(Texts)
        part.p = self.p[np.isin(self.owner, which)]
        part._held([self.counts[i] for i in which])
        return part

    def single(self) -> np.ndarray:
        """The logarithm of each text's likelihood in each single language."""
        return np.add.reduceat(self.n[:, None] * np.log(self.p), self.starts)

    def shares(self, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shares of the allowed languages (texts, languages) and the logarithm of the likelihood."""
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            weight = self.n / np.einsum("ij,ij->i", self.p, share[self.owner])
            share = share * np.add.reduceat(self.p * weight[:, None], self.starts) / self.total[:, None]
            share /= share.sum(1, keepdims=True)
        return share, np.add.reduceat(self.n * np.log(np.einsum("ij,ij->i", self.p, share[self.owner])), self.starts)


def chosen_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each text the shares of the chosen languages, and the shares among all."""
    single = texts.single()
    m, k = single.shape
    first = single.argmax(1)
    chosen, everywhere = np.zeros((m, k)), texts.shares(np.ones((m, k)))[0]
    chosen[np.arange(m), first] = 1
    likelihood, allowed = single.max(1), chosen > 0
    active = np.arange(m)
    for _ in range(k - 1):
        more = allowed[active].copy()
        more[np.arange(len(active)), np.where(more, -1, everywhere[active]).argmax(1)] = True
        share, found = texts.only(active).shares(more.astype(float))
        better = found - likelihood[active] > PENALTY * np.log(texts.total[active] + 1)
        active, share, found, more = active[better], share[better], found[better], more[better]
        if not len(active):
            break
        chosen[active], likelihood[active], allowed[active] = share, found, more
    return chosen, everywhere


def _distinct(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The place of each text with trigrams, and these with their counts. Of a text's pieces only the sum of their counts is held."""
    place, counts, slots = -1, None, None

    def one() -> tuple[int, np.ndarray, np.ndarray]:
        if counts is not None:
            found = np.flatnonzero(counts)
            return place, found, counts[found]
        ordered = np.sort(slots, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        return place, ordered[first], np.diff(np.append(first, len(ordered)))

    for places, texts in _blocks(batch.column("text").to_pylist()):
        found, ends = trigram_slots(texts)
        for i, s, e in zip(places, ends[:-1], ends[1:], strict=True):
            if s == e:
                continue
            if i == place:
                counts = np.bincount(slots, minlength=SLOTS) if counts is None else counts
                counts += np.bincount(found[s:e], minlength=SLOTS)
                continue
            if place >= 0:
                yield one()
            place, counts, slots = i, None, found[s:e].copy()
    if place >= 0:
        yield one()


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (its share among all languages), languages (`name:share` of the chosen ones, largest first, three decimals) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    if not model.languages:
        return docs.select(key, F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit("").alias("languages"))
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probabilities = sent.value.languages, sent.value.probabilities
        for batch in batches:
            n = batch.num_rows
            lang, score, languages = [NO_LANGUAGE] * n, [0.0] * n, [""] * n
            held, size = [], 0

            def judged(held: list) -> None:
                chosen, everywhere = chosen_sets(Texts([h[1:] for h in held], probabilities))
                best = chosen.argmax(1)
                for row, (i, _, _) in enumerate(held):
                    lang[i], score[i] = names[best[row]], float(everywhere[row, best[row]])
                    languages[i] = ",".join(f"{names[j]}:{chosen[row, j]:.3f}" for j in np.argsort(-chosen[row], kind="stable") if chosen[row, j] > 0)

            for found in _distinct(batch):
                held.append(found)
                size += len(found[1])
                if size * len(names) >= CELLS:
                    judged(held)
                    held, size = [], 0
            if held:
                judged(held)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lang), pa.array(np.clip(score, 0, 1)), pa.array(languages)], names=[key, "lang_pred", "score", "languages"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, languages string")


def identify_languages(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, held_out, lang_pred, score, languages; learned from the rows of docs that are not held out."""
    found = identify(docs, fit(docs, key), key)
    return found.select(key, (~learned_from(F.col(key))).alias("held_out"), "lang_pred", "score", "languages")
