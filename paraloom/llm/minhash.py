"""Near-duplicate groups by SuperMinHash, banding, verification on full shingle sets and union-find.

SuperMinHash ranks m slots in a random order for every element; the j-th slot of
an element gets the value j + a random fraction. Taken level by level for all
elements at once, a document is done at the first level at which all its slots
are filled (no later value can be smaller), which is the early stop.

Documents with the same set are one class. Classes that agree in a band meet in its
bucket. Pairs whose signatures agree in LIKELY slots are likely.
1. Within its buckets each class goes to one star of likely pairs, the most alike one.
   These pairs, one a class, are confirmed on the full sets, and union-find makes groups.
2. Buckets whose members lie in different groups show which groups may be linked yet: each
   member outside the bucket's main group names the most alike likely partner in another
   group. So that a pair can be linked, both must have enough shingles that some other class
   of such buckets has (the others are counted and can't be common ones). Groups with such
   pairs form a family, until no bucket has likely pairs across families.
3. A family's members outside its main group are held against all others on their full sets,
   by the postings of their shingles; only links come out, one for each member and group.
No row is made for a pair that isn't linked but for one a class and round. The chance to miss
a pair of similarity 0.75 is below 1e-9 for 42 bands of 3 rows and below 1e-8 for LIKELY
of 126 slots. Buckets of more than HOT_BUCKET members and families of more than HOT_CODES
shingles are dealt in blocks, where the members outside the main group (in blocks too) meet
every block, so no task takes more than two blocks.

Defined cases: null or empty text, and text without words, has an empty set and is
linked with nothing; fewer than `words` words make one shingle; repeated rows and
equal sets are linked; an empty table gives an empty result; columns of docs other
than key and text are ignored. Keys are integers; a null key comes after every other, and
rows without a key that only have each other are all kept. A key may have several texts:
each row is judged by its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_once, lean, mixed, removed, small_batches, spread_join, text_blocks, text_digest, utf8_column, written

BANDS, ROWS = 42, 3
SLOTS = BANDS * ROWS
WORDS, PERCENT = 5, 75
LIKELY, HOT_BUCKET, HOT_CODES = 67, 4096, 2_000_000
#: Parts in which the partners of one class are confirmed.
SALTS = 32
#: Text bytes worked on at once.
BLOCK = 2 << 20
#: Stands for a null key when the row that represents a class is chosen.
NO_KEY = (1 << 63) - 1
UNFILLED = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE, BASE_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_numbers = lambda n, seed: mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
_lower = np.arange(256)
_lower[0x41:0x5B] += 32
LOWER = _lower.astype(np.uint64)
WORD_CODES = _numbers(64, 11) | np.uint64(1)
LEVEL_CODES = _numbers(256, 13)
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


#: Bytes whose numbers are drawn at once.
WINDOW = 1 << 18


def word_codes(spaced: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word spaced[first:last], lower-cased: the sum of a number drawn for each byte and its place in the word.

    The numbers are those of tabulation hashing, so no rule of arithmetic makes two words collide, whatever their
    length and letters. Windows bound the memory, for long words too.
    """
    sums = np.zeros(len(first), np.uint64)
    low = 0
    for start in range(0, int(last[-1]) if len(last) else 0, WINDOW):
        stop = min(start + WINDOW, int(last[-1]))
        low += int(np.searchsorted(last[low:], start, side="right"))
        high = low + int(np.searchsorted(first[low:], stop, side="left"))
        if low == high:
            continue
        begins, stops = np.maximum(first[low:high], start), np.minimum(last[low:high], stop)
        sizes = stops - begins
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - begins, sizes)
        place = (at - np.repeat(first[low:high], sizes)).astype(np.uint64)
        drawn = mixed((LOWER[spaced[at]] | (place << np.uint64(8))) + WORD_CODES[63])
        sums[low:high] += np.add.reduceat(drawn, np.cumsum(sizes) - sizes)
    return mixed(sums + (last - first).astype(np.uint64))


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the distinct word shingles of each text, sorted within it, and the n+1 offsets of the texts."""
    n = len(ends) - 1
    spaced = np.full(len(data) + n + 1, 0x20, np.uint8)
    begins = ends[:-1] + np.arange(n) + 1
    for i, b in enumerate(begins):
        spaced[b : b + ends[i + 1] - ends[i]] = data[ends[i] : ends[i + 1]]
    space = IS_SPACE[spaced]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, last = edge[0::2], edge[1::2]
    word = word_codes(spaced, first, last)
    at = np.searchsorted(first, np.append(begins, len(spaced)))
    count = np.diff(at)
    whole = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        whole += word[k : k + len(whole)] * WORD_CODES[k]
    whole = mixed(whole)
    parts, sizes = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        s, c = at[i], count[i]
        if c >= words:
            x = np.sort(whole[s : s + c - words + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif c:
            x = mixed((word[s : s + c] * WORD_CODES[:c]).sum(keepdims=True) + np.uint64(c))
        else:
            continue
        parts.append(x)
        sizes[i + 1] = len(x)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(sizes)


def super_minhash(codes: np.ndarray, ends: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures, one row a text: the level in the high and the fraction in the low 32 bits. Texts without elements stay UNFILLED."""
    n = len(ends) - 1
    out = np.full(n * slots, UNFILLED, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(ends))
    order = None
    for j in range(slots):
        if not len(codes):
            break
        draw = mixed(codes + LEVEL_CODES[j])
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(codes))
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            order[:, j] = slot
        np.minimum.at(out, owner * slots + slot, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
        alive = (out.reshape(n, slots) == UNFILLED).any(1)[owner]
        if j == 0:
            codes, owner, k = codes[alive], owner[alive], k[alive]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(codes), 1))
            rows = np.arange(len(codes))
            order[rows, k] = 0
            order[:, 0] = k
        elif not alive.all():
            codes, owner, order = codes[alive], owner[alive], order[alive]
    return out.reshape(n, slots)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows) * WORD_CODES[:rows]
    return mixed(parts.sum(2) + np.arange(1, bands + 1, dtype=np.uint64) * BASE).view(np.int64)


def signature_rows(docs: DataFrame, key: str) -> DataFrame:
    """Per row: key, digest of the text, n_shingles, set_a and set_b (128 bits of the whole set), bands, marks (a byte of each slot), pid."""
    kind = docs.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, BLOCK):
            codes, ends = shingle_sets(*utf8_column(block.column("text")))
            sizes, filled = np.diff(ends), np.flatnonzero(np.diff(ends))
            sums = [np.zeros(len(sizes), np.uint64) for _ in range(2)]
            if len(filled):
                for i, total in enumerate(sums):
                    total[filled] = np.add.reduceat(mixed(codes + WORD_CODES[i + 32]), ends[filled])
            signed = super_minhash(codes, ends)
            bands, marks = band_keys(signed), (mixed(signed) & np.uint64(0xFF)).astype(np.uint8).tobytes()
            marks = [marks[i : i + SLOTS] for i in range(0, len(marks), SLOTS)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([block.column(key).combine_chunks(), block.column("digest").combine_chunks(), pa.array(sizes), *(pa.array(s.view(np.int64)) for s in sums), bands, pa.array(marks, pa.binary())], names=[key, "digest", "n_shingles", "set_a", "set_b", "bands", "marks"])

    rows = docs.select(key, text_digest().alias("digest"), "text").mapInArrow(run, f"{key} {kind}, digest binary, n_shingles long, set_a long, set_b long, bands array<long>, marks binary")
    return rows.withColumn("pid", F.spark_partition_id())


class Members:
    """The members of one bucket or block of it: id, marks, n_shingles and, after the first round, label, common shingles and role."""

    def __init__(self, t: pa.Table) -> None:
        self.id, self.size = t.column("id").to_numpy(), t.column("n_shingles").to_numpy()
        self.marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(-1, SLOTS)
        if "label" in t.column_names:
            self.label, self.common, self.role = (t.column(c).to_numpy() for c in ("label", "common", "role"))

    def alike(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """In how many slots rows agree with others, a tile at a time; 0 where they don't in LIKELY ones, or are too different in size to be linked at all."""
        out = np.zeros((len(rows), len(others)), np.uint8)
        step = max(1, (1 << 24) // (max(1, len(others)) * SLOTS))
        marks = self.marks[others]
        for i in range(0, len(rows), step):
            out[i : i + step] = (self.marks[rows[i : i + step], None, :] == marks[None]).sum(2, dtype=np.uint8)
        a, b = self.size[rows, None], self.size[None, others]
        out[(out < LIKELY) | (100 * np.minimum(a, b) < PERCENT * np.maximum(a, b))] = 0
        return out


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def star_pairs(m: Members) -> list[Pairs]:
    """Each member with the first member before it that is the centre of a star and a likely pair, and how alike they are; else it is a centre itself."""
    out, free = [], np.arange(len(m.id))
    while len(free) > 1:
        alike = m.alike(free[:1], free[1:])[0]
        hit = alike > 0
        out.append((np.full(hit.sum(), m.id[free[0]]), m.id[free[1:][hit]], alike[hit]))
        free = free[1:][~hit]
    return out


def cross_pairs(m: Members) -> list[Pairs]:
    """Each member outside the main group with the most alike likely partner of another group that has enough in common."""
    out, targets, probes = [], np.flatnonzero(m.role == TARGET), np.flatnonzero(m.role == PROBE)
    for start in range(0, len(probes) if len(targets) else 0, 256):
        rows = probes[start : start + 256]
        alike = m.alike(rows, targets)
        enough = (100 + PERCENT) * np.minimum(m.common[rows, None], m.common[None, targets]) >= PERCENT * (m.size[rows, None] + m.size[None, targets])
        alike[(m.label[rows, None] == m.label[None, targets]) | ~enough] = 0
        best = alike.argmax(1)
        i = np.flatnonzero(alike[np.arange(len(rows)), best])
        out.append((m.id[rows[i]], m.id[targets[best[i]]], alike[i, best[i]]))
    return out


def _in_buckets(find):
    """find() over each bucket of rows sorted by bucket (as a table): pairs (a, b) and how alike they are."""

    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        bucket = t.column("bucket").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
        found = [x for s, e in zip(cut[:-1], cut[1:], strict=True) if e - s > 1 for x in find(t.slice(s, e - s))]
        a, b, alike = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(alike.astype(np.int32))], names=["a", "b", "alike"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if whole or held and held[-1].column("bucket")[0].as_py() != bucket[0]:
                if whole:
                    held.append(batch.slice(0, whole))
                yield pairs(held)
                held = []
            held.append(batch.slice(whole))
        if held:
            yield pairs(held)

    return run


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists and the n+1 offsets of its rows."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(p.offsets.to_numpy()) for p in parts)])
    return np.concatenate([np.zeros(0, np.int64), *(p.flatten().to_numpy() for p in parts)]), np.cumsum(sizes)


def family_links(t: pa.Table, percent: int) -> list[Pairs]:
    """Links of the probes of one block to targets in other groups, by their full sets: one for each probe and group.

    Shingles of many targets are counted by a product of bit rows, the others by their postings.
    """
    codes, ends = _lists(t.column("codes"))
    ids, labels, role, size = t.column("id").to_numpy(), t.column("label").to_numpy(), t.column("role").to_numpy(), np.diff(ends)
    targets, probes = np.flatnonzero(role == TARGET), np.flatnonzero(role == PROBE)
    if not len(targets) or not len(probes):
        return []
    owner = np.repeat(np.arange(len(targets)), size[targets])
    pool = np.concatenate([codes[ends[i] : ends[i + 1]] for i in targets])
    order = np.argsort(pool, kind="stable")
    pool, owner = pool[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], pool[1:] != pool[:-1])))
    words, many = pool[first], np.diff(np.append(first, len(pool)))
    often = np.flatnonzero(many > max(8, len(targets) // 16))  # at most 16 times the mean set's size
    column = np.full(len(words), -1, np.int64)
    column[often] = np.arange(len(often))
    rows = np.zeros((len(targets), len(often)), np.float32)
    of_word = np.repeat(column, many)
    rows[owner[of_word >= 0], of_word[of_word >= 0]] = 1
    out = []
    for p in probes:
        own = codes[ends[p] : ends[p + 1]]
        at = np.minimum(np.searchsorted(words, own), len(words) - 1)
        at = at[words[at] == own]
        bits = np.zeros(len(often), np.float32)
        bits[column[at[column[at] >= 0]]] = 1
        common = (rows @ bits).astype(np.int64)
        rare = at[column[at] < 0]
        places = np.repeat(first[rare] - (np.cumsum(many[rare]) - many[rare]), many[rare]) + np.arange(many[rare].sum())
        common += np.bincount(owner[places], minlength=len(targets))
        hit = np.flatnonzero((100 * common >= percent * (size[p] + size[targets] - common)) & (labels[targets] != labels[p]))
        hit = hit[np.unique(labels[targets[hit]], return_index=True)[1]]
        out.append((np.full(len(hit), ids[p]), ids[targets[hit]], common[hit]))
    return out


def _confirm(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            (codes_a, ends_a), (codes_b, ends_b) = _lists(rows.column("codes_a")), _lists(rows.column("codes_b"))
            linked = np.zeros(rows.num_rows, bool)
            for i in range(rows.num_rows):
                x, y = codes_a[ends_a[i] : ends_a[i + 1]], codes_b[ends_b[i] : ends_b[i + 1]]
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs (a, b) of keys of sets (id, codes), with linked: whether their full sets are similar enough.

    The partners of one a are dealt to SALTS parts, each with a set of a.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    with_a = salted.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), F.col("codes").alias("codes_a")), "a")
    with_b = salted.join(sets.select(F.col("id").alias("b"), F.col("codes").alias("codes_b")), "b")
    return with_b.join(with_a, ["a", "salt"]).select("a", "b", "codes_a", "codes_b").mapInArrow(_confirm(percent), "a long, b long, linked boolean")


def full_sets(texts: DataFrame) -> DataFrame:
    """texts (id, text) to (id, codes): the sorted codes of the shingles."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, BLOCK):
            codes, ends = shingle_sets(*utf8_column(block.column("text")))
            signed = codes.view(np.int64)
            sets = [np.sort(signed[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("id").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(sets)))], names=["id", "codes"])

    return texts.mapInArrow(run, "id long, codes array<long>")


def private_shingles(sets: DataFrame) -> DataFrame:
    """sets (id, codes) to (id, private): how many shingles no other one has."""
    single = sets.select("id", F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    return single.groupBy("id").agg(F.count(F.lit(1)).alias("private"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (id, label): the smallest id that each reaches. Union-find by alternating large and small stars."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, mark = written(edges.distinct(), "edges", edges.count()), (0,)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = large.where("a > b").distinct()
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = lower.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        # a step makes no edges but at most two for each
        then = written(small.where("a <> b").distinct(), "edges", 2 * mark[0] or None)
        removed(now)
        now = then
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("a").alias("id"), F.col("b").alias("label"))
        mark = seen


#: Roles of a member in a block: held against those outside the main group, or one of these.
TARGET, PROBE = 0, 1


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "id")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit("block")), blocks)


def _star_blocks(members: DataFrame) -> DataFrame:
    """members (bucket, id, n, least) dealt in blocks of about HOT_BUCKET; the bucket's first member is in each."""
    blocks = F.ceil(F.col("n") / HOT_BUCKET)
    own = F.when(F.col("id") == F.col("least"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(_block(blocks)))
    dealt = members.select("bucket", "id", blocks.alias("blocks"), F.explode(own).alias("block"))
    return dealt.select(F.when(F.col("blocks") > 1, F.xxhash64("bucket", "block")).otherwise(F.col("bucket")).alias("bucket"), "id")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (with id) with their label; who has none is a group alone."""
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _apart(members: DataFrame, limit: int, most: int) -> DataFrame:
    """The members (bucket, id, weight, label) of buckets with several labels, with main (the label that weighs most), targets and probes.

    These are the numbers of blocks of about limit that the members make and those with another label than main.
    most: how many rows members has at most.
    """
    counts = members.groupBy("bucket", "label").agg(F.sum("weight").alias("part"))
    whole = counts.groupBy("bucket").agg(F.max_by("label", F.struct("part", "label")).alias("main"), F.sum("part").alias("all"), F.max("part").alias("most")).where("all > most")
    blocks = whole.select("bucket", "main", F.ceil(F.col("all") / limit).alias("targets"), F.ceil((F.col("all") - F.col("most")) / limit).alias("probes"))
    return written(members.join(written(blocks, "mixed", most), "bucket"), "apart", most)


def _cross_blocks(apart: DataFrame) -> DataFrame:
    """Blocks of targets, each with every block of probes (members outside the main group): bucket, id, label, role."""
    targets, probes = F.col("targets"), F.col("probes")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_target = F.transform(upto(probes), lambda p: F.struct(_block(targets).alias("t"), p.alias("p"), F.lit(TARGET).alias("role")))
    as_probe = F.transform(upto(targets), lambda t: F.struct(t.alias("t"), _block(probes).alias("p"), F.lit(PROBE).alias("role")))
    dealt = apart.select("bucket", "id", "label", (targets + probes).alias("blocks"), F.explode(F.when(F.col("label") == F.col("main"), as_target).otherwise(F.concat(as_target, as_probe))).alias("at"))
    return dealt.select(F.when(F.col("blocks") > 2, F.xxhash64("bucket", "at.t", "at.p")).otherwise(F.col("bucket")).alias("bucket"), "id", "label", "at.role")


def _with_own(labels: DataFrame) -> DataFrame:
    """labels (id, label) of components() with those of the ids that are labels themselves."""
    return labels.union(labels.select(F.col("label").alias("id"), "label").distinct())


def near_groups(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links), kept."""
    return _judged(docs, key, percent).drop("digest")


def _judged(docs: DataFrame, key: str, percent: int) -> DataFrame:
    """near_groups() with the digest of each row's text.

    Equal sets are one class with a number of its own, as a key may be null or have
    several texts; each class is compared by one of its rows, told by key and digest.
    """
    small_batches(docs.sparkSession)
    first = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("first")
    rows = written(signature_rows(docs, key), "signatures")
    whole = ["n_shingles", "set_a", "set_b"]
    classes = rows.where("n_shingles > 0").groupBy(*whole).agg(F.min(F.col(key).cast("long")).alias("smallest"))
    classes = written(classes.withColumn("first", F.coalesce("smallest", F.lit(NO_KEY))).withColumn("id", F.monotonically_increasing_id()), "classes")
    heads = rows.select("digest", *whole, "bands", "marks", first).join(classes, [*whole, "first"]).dropDuplicates(["id"])
    members = heads.select("id", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1")
    members = written(members.join(written(buckets, "buckets"), "bucket"), "members")
    marks = heads.select("id", "marks", "n_shingles")
    pairs_of = lambda rows, find: _sorted(rows).mapInArrow(_in_buckets(find), "a long, b long, alike int")
    most_alike = lambda found, of, by: found.groupBy(of).agg(F.max_by(by, F.struct("alike", -F.col(by))).alias(by)).select("a", "b")
    stars = most_alike(pairs_of(_star_blocks(members).join(marks, "id"), lambda t: star_pairs(Members(t))), "b", "a")
    wanted = heads.select("id", "first", "digest").join(members.select("id").distinct(), "id", "left_semi")
    texts = docs.select(first, text_digest().alias("digest"), "text").join(wanted, ["first", "digest"]).select("id", "text").dropDuplicates(["id"])
    sets = written(full_sets(texts), "sets")
    links = written(confirmed(stars, sets, percent).where("linked").select("a", "b"), "links")
    labels = components(links)
    # families: groups that likely pairs join
    slim, families, near, many = members.select("bucket", "id", F.lit(1).alias("weight")), labels, links, members.count()
    apart = _apart(_labelled(slim, families), HOT_BUCKET, many)
    private = private_shingles(sets.join(apart.select("id").distinct(), "id", "left_semi"))
    marks = written(marks.join(private, "id", "left").withColumn("common", F.col("n_shingles") - F.coalesce("private", F.lit(0))), "marks")
    most = sets.count()
    while (found := written(most_alike(pairs_of(_cross_blocks(apart).join(marks, "id"), lambda t: cross_pairs(Members(t))), "a", "b"), "near", most)).head(1):
        near = near.union(found)
        families = components(near)
        apart = _apart(_labelled(slim, families), HOT_BUCKET, many)
    relatives = _with_own(families).withColumnRenamed("label", "bucket").join(marks.select("id", F.col("n_shingles").alias("weight")), "id")
    mixed_families = _cross_blocks(_apart(_labelled(relatives, labels).select("bucket", "id", "weight", "label"), HOT_CODES, most))
    more = written(pairs_of(mixed_families.join(sets, "id"), lambda t: family_links(t, percent)).select("a", "b"), "links")
    if more.head(1):
        labels = components(links.union(more))
    linked = _with_own(labels)
    least = linked.join(classes, "id").groupBy("label").agg(F.min("smallest").alias("least"))
    least = linked.join(least, "label").select("id", "least")
    labelled = written(classes.join(least, "id", "left").select(*whole, F.coalesce("least", "smallest").alias("component_id")), "labelled", classes.count())
    grouped = spread_join(rows.where("n_shingles > 0").select(key, "digest", *whole, "pid"), labelled, whole)
    out = grouped.select(key, "digest", "n_shingles", "component_id").union(rows.where("n_shingles = 0").select(key, "digest", "n_shingles", (F.col(key) + F.lit(0)).cast("long").alias("component_id")))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """docs without near copies: of each group the document with the smallest key stays, once; all columns as before."""
    return kept_once(docs, key, _judged(docs, key, percent).select(key, "digest", "kept"))
