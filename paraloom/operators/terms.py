"""Term statistics and similarity joins over an exploded term table.

Pairs are never formed by a cross join: a similarity that is 0 without a common
term is an equi-join on the term, after terms outside a document-frequency window
are dropped, and a sum by pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ngrams
from .lineage import cut


def one_row_each(docs: DataFrame, keys: list[str]) -> bool:
    """Whether no two rows have the same keys; only these are shuffled."""
    return not docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)


def exploded(docs: DataFrame, tokens: Column, keys: list[str]) -> DataFrame:
    """(keys, term, count) of each document; where each is one row, counted in it, and with its largest count and total (most, total)."""
    if one_row_each(docs, keys):
        rows = docs.select(*keys, ngrams.counted(tokens).alias("__counts"))
        whole = F.array_max("__counts.count").alias("most"), F.aggregate("__counts.count", F.lit(0).cast("long"), lambda a, n: a + n).alias("total")
        rows = rows.select(*keys, "__counts", *whole)  # before the rows are exploded, not once a term
        return rows.select(*keys, "most", "total", F.explode("__counts").alias("__x")).select(*keys, "__x.term", "__x.count", "most", "total")
    return docs.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("count"))


def word_counts(docs: DataFrame, tokens: Column, language: str = "lang", key: str = "doc_id", once: bool = False, most: int = -1) -> DataFrame:
    """Counts by language and word, or document frequencies (once); with a maximum, more frequent words go."""
    words = docs.select(F.col(language).alias("lang"), key, F.explode(F.array_distinct(tokens) if once else tokens).alias("word"))
    out = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("cnt"))
    return out.where(F.col("cnt") <= most) if most > 0 else out


def document_frequency(terms: DataFrame, least: int = 1, most: int = 1000) -> DataFrame:
    """(term, df) within the window."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(least, most))


def merged_frequencies(counts: DataFrame, sizes: DataFrame, least: int = 2, lower: bool = False) -> DataFrame:
    """Sum of frequency files (ngram, df) and of their numbers of documents (n): ngram, df, idf = ln N - ln df."""
    gram = F.lower("ngram") if lower else F.col("ngram")
    total = sizes.agg(F.sum("n").alias("n"))  # one row
    return counts.groupBy(gram.alias("ngram")).agg(F.sum("df").alias("df")).where(F.col("df") >= least).join(F.broadcast(total)).select("ngram", "df", (F.log("n") - F.log("df")).alias("idf"))


def tf(count: Column, most: Column, total: Column, variant: int) -> Column:
    """Term weight 0 to 6: 1, c, 1+ln c, .4+.6c/max, c/max, c/sum, sqrt c."""
    return [F.lit(1.0), count.cast("double"), 1 + F.log(count), 0.4 + 0.6 * count / most, count / most, count / total, F.sqrt(count)][variant]


def idf(df: Column, n: Column, most: Column, variant: int) -> Column:
    """Document weight 0 to 5: 1, ln(N/df), ln(1+N/df), ln(1+max/df), ln((N-df)/df) or 0, 1+ln(N/(df+1))."""
    return [F.lit(1.0), F.log(n / df), F.log(1 + n / df), F.log(1 + most / df), F.when(n > df, F.log((n - df) / df)).otherwise(0.0), 1 + F.log(n / (df + 1))][variant]


#: Terms that are broadcast at most.
BROADCAST_TERMS = 65_536


def _without_frequent(terms: DataFrame, df: DataFrame, most: int) -> DataFrame:
    """terms without those above the window: most rows are of few such terms, which needn't meet by term to go. At most BROADCAST_TERMS go here."""
    frequent = df.where(F.col("df") > most).orderBy(F.desc("df")).limit(BROADCAST_TERMS).select("term")
    return terms.join(F.broadcast(frequent), "term", "left_anti")


def _with_df(terms: DataFrame, df: DataFrame) -> DataFrame:
    """terms with their df; rows of the BROADCAST_TERMS most frequent terms, which most rows are of, meet it where they are, all others by term."""
    frequent = cut(df.orderBy(F.desc("df")).limit(BROADCAST_TERMS))
    seldom = terms.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(df, "term")
    return terms.join(F.broadcast(frequent), "term").unionByName(seldom)


def _numbered(terms: DataFrame, keys: list[str], least: int, most: int | None, of_doc: bool) -> DataFrame:
    """terms (keys, term, count) in the window (most None: all from least on) with df, n_docs, max_df and, of_doc, their document's most and total. N and the largest df are of all terms."""
    n = terms.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    df = cut(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    top = df.agg(F.max("df").alias("max_df"))
    x = terms if most is None else _without_frequent(terms, df, most)
    if of_doc and not {"most", "total"} <= set(terms.columns):
        whole = terms.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max("count").alias("most"), F.sum("count").alias("total"))
        x = x.join(whole, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)))
    found = _with_df(x, df.where(F.col("df") >= least)) if most is None else x.join(df.where(F.col("df").between(least, most)), "term")
    return found.join(F.broadcast(n.join(top)))  # one row


def _weight(variant: int, of_doc: bool) -> Column:
    most, total = (F.col("most"), F.col("total")) if of_doc else (F.lit(1), F.lit(1))
    return tf(F.col("count"), most, total, variant // 6) * idf(F.col("df"), F.col("n_docs"), F.col("max_df"), variant % 6)


def tfidf(terms: DataFrame, keys: list[str], variant: int = 0, least: int = 1, most: int | None = 1000) -> DataFrame:
    """(keys, term, weight); variant is 6 * tf + idf; with most None no term is too frequent. Documents' largest counts and totals are made only for the variants that ask for them."""
    of_doc = variant // 6 in (3, 4, 5)
    return _numbered(terms, keys, least, most, of_doc).select(*keys, "term", _weight(variant, of_doc).alias("weight"))


def tfidf_of(docs: DataFrame, tokens: Column, keys: list[str], wanted: str, variant: int = 0, least: int = 1, most: int = 1000) -> DataFrame:
    """tfidf() of the documents that are wanted (a condition on keys), with the frequencies of all, without a table of all their terms.

    Terms are numbered first; then only those in the window are counted, where they meet their number. Empty terms are none.
    """
    if variant // 6 in (3, 4, 5) or not one_row_each(docs, keys):
        return tfidf(cut(exploded(docs, F.array_remove(tokens, ""), keys)), keys, variant, least, most).where(wanted)
    # an inner explode would make the tokens of each row twice, first to see whether there are any
    df = cut(docs.select(F.explode_outer(F.array_distinct(tokens)).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    whole = docs.where(F.size(F.array_remove(tokens, "")) > 0).agg(F.count(F.lit(1)).alias("n_docs")).join(df.agg(F.max("df").alias("max_df")))  # one row
    rows = _without_frequent(docs.where(wanted).select(*keys, F.explode_outer(tokens).alias("term")).where("term <> ''"), df, most)
    x = rows.join(df.where(F.col("df").between(least, most)), "term").groupBy(*keys, "term", "df").agg(F.count(F.lit(1)).alias("count"))
    return x.join(F.broadcast(whole)).select(*keys, "term", _weight(variant, False).alias("weight"))


#: How many variants there are.
VARIANTS = 42


def tfidf_totals(terms: DataFrame, keys: list[str], least: int = 1, most: int = 1000) -> DataFrame:
    """(keys, v0 .. v41): each document's sum of each variant's weights, in one pass."""
    # what the weights are made of goes to the documents, not 42 sums of each part of one
    rows = _numbered(terms, keys, least, most, True).select(*keys, "count", "df", "most", "total", "n_docs", "max_df").repartition(*keys)
    return rows.groupBy(*keys).agg(*(F.sum(_weight(v, True)).alias(f"v{v}") for v in range(VARIANTS)))


def sides(terms: DataFrame, language: str, source: str, target: str, group: str, key: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    s = terms.where(F.col(language) == source).select(group, F.col(key).alias("src_id"), "term", *(F.col(c).alias(f"s_{c}") for c in keep))
    t = terms.where(F.col(language) == target).select(group, F.col(key).alias("tgt_id"), "term", *(F.col(c).alias(f"t_{c}") for c in keep))
    return s, t


def _totals(side: DataFrame, key: str, group: str, aggs: dict[str, Column]) -> DataFrame:
    return side.groupBy(group, key).agg(*(v.alias(k) for k, v in aggs.items()))


def count_similarities(s: DataFrame, t: DataFrame, group: str, frequent: DataFrame | None = None) -> DataFrame:
    """Jaccard, Dice, weighted Jaccard, the legacy cosine of counts, for pairs of one group with a common term.

    frequent: the terms (df window) that may pair documents; totals are over the same terms.
    """
    if frequent is not None:
        s, t = s.join(frequent, "term", "left_semi"), t.join(frequent, "term", "left_semi")
    both = s.join(t, [group, "term"]).groupBy(group, "src_id", "tgt_id").agg(
        F.count(F.lit(1)).alias("common"), F.sum(F.least("s_count", "t_count")).alias("low"), F.sum(F.greatest("s_count", "t_count")).alias("high"), F.sum(F.col("s_count") * F.col("t_count")).alias("dot"), F.sum(F.col("s_count") + F.col("t_count")).alias("shared")
    )
    size = lambda side, k: _totals(side, f"{k}_id", group, {f"{k}_n": F.count(F.lit(1)), f"{k}_sum": F.sum(F.col(f"{k[0]}_count")), f"{k}_sq": F.sum(F.col(f"{k[0]}_count") * F.col(f"{k[0]}_count"))})
    x = both.join(size(s, "src"), [group, "src_id"]).join(size(t, "tgt"), [group, "tgt_id"])
    rest = F.col("src_sum") + F.col("tgt_sum") - F.col("shared")  # counts of terms that only one side has
    return x.select(
        group, "src_id", "tgt_id", "common",
        (F.col("common") / (F.col("src_n") + F.col("tgt_n") - F.col("common"))).alias("jaccard"),
        (2 * F.col("common") / (F.col("src_n") + F.col("tgt_n"))).alias("dice"),
        (F.col("low") / (F.col("high") + rest)).alias("weighted_jaccard"),
        (F.col("dot") / (F.col("src_sq") + F.col("tgt_sq"))).alias("legacy_cosine"),
    )


def cosine_pairs(s: DataFrame, t: DataFrame, group: str) -> DataFrame:
    """True cosine of weights for pairs of one group with a common term."""
    dot = s.join(t, [group, "term"]).groupBy(group, "src_id", "tgt_id").agg(F.sum(F.col("s_weight") * F.col("t_weight")).alias("dot"))
    norm = lambda side, k: _totals(side, f"{k}_id", group, {f"{k}_norm": F.sqrt(F.sum(F.col(f"{k[0]}_weight") * F.col(f"{k[0]}_weight")))})
    x = dot.join(norm(s, "src"), [group, "src_id"]).join(norm(t, "tgt"), [group, "tgt_id"])
    return x.select(group, "src_id", "tgt_id", F.when((F.col("src_norm") > 0) & (F.col("tgt_norm") > 0), F.col("dot") / (F.col("src_norm") * F.col("tgt_norm"))).otherwise(0.0).alias("score"))


def translated_bags(words: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Target words (tgt_id, term) to distinct translations, and for each document the numbers of its words and of those translated."""
    hits = words.join(dictionary.select(F.col("w2").alias("term"), "w1").distinct(), "term", "left")
    counts = hits.groupBy("tgt_id").agg(F.count_distinct("term").alias("n_original"), F.count_distinct(F.when(F.col("w1").isNotNull(), F.col("term"))).alias("n_translated"))
    return hits.where("w1 IS NOT NULL").select("tgt_id", F.col("w1").alias("term")).distinct(), counts


def bag_similarity(source: DataFrame, target: DataFrame, dictionary: DataFrame, group: str) -> DataFrame:
    """min(S, T) / max(S, T) * common translations / translated words, for pairs of one group; source and target are (group, id, term) sets."""
    bags, counts = translated_bags(target.select("tgt_id", "term"), dictionary)
    of = target.select(group, "tgt_id").distinct()
    sizes = source.groupBy(group, "src_id").agg(F.count(F.lit(1)).alias("n_source"))
    both = source.join(bags.join(of, "tgt_id"), [group, "term"]).groupBy(group, "src_id", "tgt_id").agg(F.count(F.lit(1)).alias("common"))
    x = both.join(sizes, [group, "src_id"]).join(counts, "tgt_id").where("n_translated > 0")
    return x.select(group, "src_id", "tgt_id", "common", (F.least("n_source", "n_original") / F.greatest("n_source", "n_original") * F.col("common") / F.col("n_translated")).alias("score"))


def extended_dictionary(dictionary: DataFrame, source_words: DataFrame, target_words: DataFrame) -> DataFrame:
    """The dictionary and each word that both vocabularies (term) have, as its own translation."""
    same = source_words.select("term").intersect(target_words.select("term"))
    return dictionary.select("w1", "w2").unionByName(same.select(F.col("term").alias("w1"), F.col("term").alias("w2"))).distinct()


def ranked(pairs: DataFrame, score: str = "score", source: str = "src_id", target: str = "tgt_id") -> DataFrame:
    """rank from 1 of each source's targets: by score, ties by target."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(source).orderBy(F.desc(score), target)))


def top_k(pairs: DataFrame, k: int = 10, score: str = "score", source: str = "src_id", target: str = "tgt_id") -> DataFrame:
    return ranked(pairs, score, source, target).where(F.col("rank") <= k)


def candidate_lists(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Ranked candidates of each source as one row: src_id, cands."""
    return top_k(pairs, k).groupBy("src_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tgt_id", "score"))), lambda c: F.struct(c["tgt_id"].alias("tgt_id"), c["score"].alias("score"))).alias("cands"))


def nearest(pairs: DataFrame) -> DataFrame:
    """The target at the smallest cosine distance under 1 of each source."""
    return pairs.withColumn("distance", 1 - F.col("score")).where("distance < 1").groupBy("src_id").agg(F.min(F.struct("distance", "tgt_id")).alias("m")).select("src_id", "m.tgt_id", "m.distance")


def index_counts(docs: DataFrame, grams: Column, key: str) -> DataFrame:
    """(term, n, first): of each n-gram of inverted_index() the number of documents and the smallest, without any list of them."""
    rows = docs.select(key, F.explode(F.array_distinct(grams)).alias("term")).where(F.col(key).isNotNull())
    rows = rows if one_row_each(docs, [key]) else rows.distinct()
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))


def inverted_index(docs: DataFrame, grams: Column, key: str) -> DataFrame:
    """(term, docs): the documents of each n-gram."""
    return docs.select(key, F.explode(F.array_distinct(grams)).alias("term")).groupBy("term").agg(F.sort_array(F.collect_set(key)).alias("docs"))
