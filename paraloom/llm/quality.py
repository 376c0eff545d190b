"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams trained on trusted text.

Trusted text is labelled good and not toxic; all of it that is not held out trains the model. Training counts go to shards by the
two bytes before the last one, so all orders from 3 up that score an n-gram lie in
one shard; orders 1 and 2 are one table of at most 65,536 counts, known to all.
Documents are handled in blocks of some MB: a block asks each shard for the
log-probabilities of its distinct n-grams (the sharded count join; what is asked
grows with the corpus), and what comes back meets the block's texts again.

A document's score is its mean negative log-probability a byte, drawn toward its
language's mean for short texts. It is rejected when the score is above a quantile
of its language's held-out trusted documents, raised by a margin. Repeated words are too
likely for that, so the share of different words, over all windows of WINDOW words, is
held against the low quantile of the same documents, lowered by the margin.

Defined cases: null or empty text has its language's means and is kept; a
language without held-out documents is judged by the quantile of all; repeated
rows are rows of their own; without any trusted document nothing is rejected
(score null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mixed, pack_arrays, small_batches, text_blocks, text_digest, unpack_arrays, utf8_column, written

ORDER, SHARDS = 5, 32
#: Bits of the filter by which texts that can't be trusted ones stay where they are when the trusted ones are joined.
FILTER_BITS = 1 << 26
#: One trusted document in HELD_OUT, by hash, sets thresholds instead of training.
HELD_OUT = 4
QUANTILE, MARGIN, SHRINK_BYTES = 0.99, 0.04, 200.0
#: Words among which repeats count, and how many words of its language's mean variety a text is given.
WINDOW, SHRINK_WORDS = 64, 40.0
WORD = re.compile(rb"\S+")
#: Input partitions whose requests to a shard meet in one task.
PER_SALT = 16
PAD = 0x0A
#: Text bytes whose codes are worked on at once.
SLICE_BYTES = 1 << 19


def gram_codes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each byte of each text, as a number; texts start with line feeds."""
    n, lead = len(ends) - 1, ORDER - 1
    at = np.arange(len(data))
    at += np.repeat(lead * (np.arange(n) + 1), np.diff(ends))
    spaced = np.full(len(data) + lead * n, PAD, np.uint8)
    spaced[at] = data
    codes = np.zeros(len(data), np.uint64)
    for k in range(ORDER):
        one = spaced[at].astype(np.uint64)
        one <<= np.uint64(8 * k)
        codes |= one
        at -= 1
    return codes


def slices(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A block in slices of some texts each: number of the first text, bytes, offsets. They bound the memory of the codes."""
    start = 0
    while start < len(ends) - 1:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1)
        yield start, data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        start = stop


def block_grams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The different ORDER-grams of a block, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(gram_codes(d, e)) for _, d, e in slices(data, ends))]))


def word_variety(text: bytes) -> tuple[int, int]:
    """The number of words, and of different words summed over windows of WINDOW words."""
    words, total, different = (m.group() for m in WORD.finditer(text)), 0, 0
    while window := list(islice(words, WINDOW)):
        total += len(window)
        different += len(set(window))
    return total, different


def shard_of(codes: np.ndarray) -> np.ndarray:
    return (mixed((codes >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(SHARDS)).astype(np.int64)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first)


@lean
def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    merged = 0

    def merge() -> None:
        nonlocal merged
        held[:] = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
        merged = len(held[0][0])

    def out() -> pa.RecordBatch:
        keys, counts = held.pop()
        shards = shard_of(keys)
        rows = [(s, pack_arrays(keys[shards == s], counts[shards == s])) for s in range(SHARDS)]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "counts"])

    for block in text_blocks(batches):
        for _, data, ends in slices(*utf8_column(block.column("text"))):
            held.append(np.unique(gram_codes(data, ends), return_counts=True))
            if sum(len(k) for k, _ in held) > merged + 1_000_000:
                merge()
        if merged > 1_000_000:
            merge()
            yield out()
            merged = 0
    if held:
        merge()
        yield out()


class Level:
    """Counts of one order: the n-grams, and of each context the total and how many n-grams have count 1, 2 and more."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams, self.counts = grams, counts
        heads = grams >> np.uint64(8)
        first = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1]))) if len(heads) else np.zeros(0, np.int64)
        self.contexts = heads[first]
        tally = lambda x: np.add.reduceat(x.astype(np.float64), first) if len(first) else np.zeros(0)
        self.total, self.ones, self.twos, self.more = tally(counts), tally(counts == 1), tally(counts == 2), tally(counts > 2)

    def of_counts(self) -> np.ndarray:
        return np.array([np.count_nonzero(self.counts == k) for k in (1, 2, 3, 4)], np.int64)

    def interpolate(self, codes: np.ndarray, lower: np.ndarray, discounts: np.ndarray) -> np.ndarray:
        """Probabilities of codes (of this order) given those of the order below."""
        if not len(self.grams):
            return lower
        i = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        count = np.where(self.grams[i] == codes, self.counts[i], 0)
        heads = codes >> np.uint64(8)
        j = np.minimum(np.searchsorted(self.contexts, heads), len(self.contexts) - 1)
        known = self.contexts[j] == heads
        total = np.where(known, self.total[j], 1.0)
        rest = discounts[1] * self.ones[j] + discounts[2] * self.twos[j] + discounts[3] * self.more[j]
        own = np.maximum(count - discounts[np.minimum(count, 3)], 0.0)
        return np.where(known, (own + rest * lower) / total, lower)


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of n-grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in of_counts)
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip(np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def _lower(grams: np.ndarray, order: int) -> Level:
    """The level below: each n-gram counts the different bytes seen before it."""
    keys, counts = _summed(np.sort(grams & np.uint64((1 << 8 * order) - 1)), np.ones(len(grams), np.int64))
    return Level(keys, counts)


def levels(grams: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Orders ORDER down to 3."""
    out = [Level(grams, counts)]
    for order in range(ORDER - 1, 2, -1):
        out.append(_lower(out[-1].grams, order))
    return out


@lean
def _shard_model(table: pa.Table) -> pa.Table:
    parts = [unpack_arrays(b.as_py()) for b in table.column("counts")]
    grams, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    made = levels(grams, counts)
    pairs = _lower(made[-1].grams, 2)
    stats = pack_arrays(pairs.grams, pairs.counts, *(x.of_counts() for x in made))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "model": pa.array([pack_arrays(grams, counts)], pa.binary()), "stats": pa.array([stats], pa.binary())})


def _block_rows():
    """Blocks of documents as rows; each has an id made of its place and the lengths of its texts."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
        pid = TaskContext.get().partitionId()
        for seq, block in enumerate(text_blocks(batches)):
            mark = zlib.crc32(np.ascontiguousarray(utf8_column(block.column("text"))[1]).tobytes())
            yield f"{pid}-{seq}-{mark}-{block.num_rows}", pid, block

    @lean
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, block in blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(block.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])

    @lean
    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, pid, block in blocks(batches):
            codes = block_grams(*utf8_column(block.column("text")))
            shards = shard_of(codes)
            for s in range(SHARDS):
                if len(own := codes[shards == s]):  # differences are small numbers, which the shuffle's compression likes
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pid // PER_SALT], pa.int32()), pa.array([name]), pa.array([np.diff(own, prepend=np.uint64(0)).tobytes()], pa.binary())], names=["shard", "salt", "block", "grams"])

    return texts, requests


def plain_scan(docs: DataFrame) -> bool:
    """Whether docs are rows of files, perhaps some of their columns and with functions of them: each read splits them the same way."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project" and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def trusted_keys(labels: DataFrame, key: str) -> DataFrame:
    """key and held_out of the documents labelled good and not toxic."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(key).where(F.col(key).isNotNull()).distinct()
    return good.withColumn("held_out", F.pmod(F.xxhash64(key, F.lit("held out")), F.lit(HELD_OUT)) == 0)


def _only_with(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """key and text of the rows of docs whose key is among keys. Both meet by key; a filter of FILTER_BITS bits keeps most other texts from being shuffled."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    words = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("w")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros((FILTER_BITS >> 15, 1 << 12), np.uint8)
    for row in words.toLocalIterator():  # at most FILTER_BITS / 8 bytes, whatever the number of keys
        bits[row["w"] - 1] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.ravel())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("p").to_numpy() - 1
            batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            if batch.num_rows:
                yield batch.select([key, "text"])

    kind = docs.schema[key].dataType.simpleString()
    near = docs.select(key, "text", place.alias("p")).mapInArrow(run, f"`{key}` {kind}, text string")
    return near.join(keys.select(key), key, "left_semi")


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, lang, the columns carry, n_bytes, n_words and n_different (word_variety) and nll, the negative log-probability of the text.

    Without a model the last three are null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs if plain_scan(docs) else written(docs.select(*dict.fromkeys((key, "lang", "text", *carry))), "documents")
    kind = docs.schema[key].dataType.simpleString()
    trusted = trusted_keys(labels, key)
    counts = _only_with(docs, trusted.where("NOT held_out"), key).select("text").mapInArrow(_training_counts, "shard int, counts binary")
    model = written(counts.groupBy("shard").applyInArrow(_shard_model, "shard int, model binary, stats binary"), "model")
    pairs, of_counts = np.zeros(65536, np.int64), np.zeros((ORDER - 2, 4), np.int64)
    for row in model.select("stats").toLocalIterator():  # SHARDS rows of at most 65,536 pairs
        grams, seen, *rest = unpack_arrays(row["stats"])
        pairs[grams.astype(np.int64)] += seen
        of_counts += np.array(rest)
    if not pairs.any():
        return docs.select(key, "lang", *carry, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), *(F.lit(None).cast(t).alias(c) for c, t in (("n_words", "long"), ("n_different", "long"), ("nll", "double"))))
    two = Level(np.flatnonzero(pairs).astype(np.uint64), pairs[pairs > 0])
    one = np.bincount((two.grams & np.uint64(0xFF)).astype(np.int64), minlength=256)
    cut = [discounts(c) for c in of_counts]
    cut_two = discounts(two.of_counts())
    singles = (np.maximum(one - 0.5, 0) + 0.5 * np.count_nonzero(one) / 256) / one.sum()
    shared = spark.sparkContext.broadcast((two, singles, cut, cut_two))

    @lean
    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        two, singles, cut, cut_two = shared.value
        made = levels(*unpack_arrays(held.column("model")[0].as_py())) if held.num_rows else []
        out = []
        for grams in asked.column("grams"):
            codes = np.cumsum(np.frombuffer(grams.as_py(), np.uint64), dtype=np.uint64)
            p = two.interpolate(codes & np.uint64(0xFFFF), singles[(codes & np.uint64(0xFF)).astype(np.int64)], cut_two)
            for i in range(len(made) - 1, -1, -1):
                p = made[i].interpolate(codes & np.uint64((1 << 8 * (ORDER - i)) - 1), p, cut[i])
            out.append(np.log(p).astype(np.float32).tobytes())
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "logs": pa.array(out, pa.binary())})

    @lean
    def meet(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            raise RuntimeError("a block of documents was read in another split than before; give the operator a table that was written")
        block = pa.ipc.open_stream(texts.column("texts")[0].as_py()).read_all()
        data, ends = utf8_column(block.column("text"))
        grams = block_grams(data, ends)
        logs, shards = np.full(len(grams), np.nan), shard_of(grams)
        for s, values in zip(answers.column("shard").to_pylist(), answers.column("logs"), strict=True):
            logs[shards == s] = np.frombuffer(values.as_py(), np.float32)
        nll = np.zeros(len(ends) - 1)
        for first, part, upto in slices(data, ends):
            total = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(grams, gram_codes(part, upto))])))
            nll[first : first + len(upto) - 1] = total[upto[:-1]] - total[upto[1:]]
        variety = [word_variety(data[s:e].tobytes()) for s, e in zip(ends[:-1], ends[1:], strict=True)]
        words = {c: pa.array([v[i] for v in variety], pa.int64()) for i, c in enumerate(("n_words", "n_different"))}
        return pa.table({key: block.column(key), "lang": block.column("lang"), **{c: block.column(c) for c in carry}, "n_bytes": pa.array(np.diff(ends)), **words, "nll": pa.array(nll)})

    rows = docs.select(key, "lang", *carry, "text")
    salts = -(-docs._jdf.rdd().getNumPartitions() // PER_SALT)
    texts, requests = _block_rows()
    held = model.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "model") if salts else model.select("shard", F.lit(0).alias("salt"), "model")
    asked = rows.select(key, "text").mapInArrow(requests, "shard int, salt int, block string, grams binary")
    answers = held.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInArrow(answer, "block string, shard int, logs binary")
    stored = rows.mapInArrow(texts, "block string, texts binary")
    return stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, ", ".join([f"{key} {kind}", "lang string", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry), "n_bytes long", "n_words long", "n_different long", "nll double"]))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, lang, the columns carry, perplexity (a byte), score, threshold and kept.

    Not kept: score above threshold, or too few different words.
    """
    scores = written(score_documents(docs, labels, key, carry=carry), "scores")
    held_out = scores.join(trusted_keys(labels, key).where("held_out"), key, "left_semi").where("n_bytes > 0 AND nll IS NOT NULL")
    mean_of, variety_of = (F.sum("nll") / F.sum("n_bytes")).alias, (F.sum("n_different") / F.sum("n_words")).alias
    means = held_out.groupBy(F.col("lang").alias("of")).agg(mean_of("mean"), variety_of("variety_mean"))
    shrunk = lambda n, total, mean: (total + SHRINK_BYTES * mean) / (n + SHRINK_BYTES)
    various = lambda mean: (F.col("n_different") + SHRINK_WORDS * mean) / (F.col("n_words") + SHRINK_WORDS)
    scored = held_out.join(means, F.col("lang").eqNullSafe(F.col("of"))).select("of", "mean", "variety_mean", shrunk(F.col("n_bytes"), F.col("nll"), F.col("mean")).alias("score"), various(F.col("variety_mean")).alias("variety"))
    quantile, low = F.percentile_approx("score", QUANTILE, 10_000), F.percentile_approx("variety", 1 - QUANTILE, 10_000)
    limits = scored.groupBy("of", "mean", "variety_mean").agg(quantile.alias("limit"), low.alias("low"))
    overall = F.broadcast(held_out.agg(mean_of("mean_all"), variety_of("variety_all")).join(scored.agg(quantile.alias("limit_all"), low.alias("low_all"))))  # one row
    judged = scores.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").join(overall)
    mean, limit = F.coalesce("mean", "mean_all"), F.coalesce("limit", "limit_all") * (1 + MARGIN)
    judged = judged.withColumn("score", shrunk(F.col("n_bytes"), F.col("nll"), mean)).withColumn("threshold", limit)
    plain = F.coalesce(various(F.coalesce("variety_mean", "variety_all")) < F.coalesce("low", "low_all") * (1 - MARGIN), F.lit(False))
    return judged.select(key, "lang", *carry, F.when(F.col("n_bytes") > 0, F.exp(F.col("nll") / F.col("n_bytes"))).alias("perplexity"), "score", "threshold", (F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)) & ~plain).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rejected ones; all columns as before. Each row is judged by its own text and language."""
    judged = classify(docs.select(key, "lang", "text", text_digest().alias("digest")), labels, key, ("digest",))
    rejected = judged.where("NOT kept").select(F.col(key).alias("__key"), F.col("lang").alias("__lang"), F.col("digest").alias("__digest")).distinct()
    marked = docs.withColumn("__text", text_digest())
    same = marked[key].eqNullSafe(rejected["__key"]) & marked["lang"].eqNullSafe(rejected["__lang"]) & (marked["__text"] == rejected["__digest"])
    return marked.join(rejected, same, "left_anti").drop("__text")
