"""From documents to sentences of one language, and pair files made anew from their HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as T
from . import languages, matching, search

Step = Callable[[Column], Column]


def text_in(found: DataFrame, language: str, key: list[str]) -> DataFrame:
    """key and text: of languages.language_spans() the spans of one language, in order, a line each; rows without any go."""
    mine = F.filter("spans", lambda s: s["language"] == language)
    lines = F.transform(mine, lambda s: F.array_join(F.slice("kept", s["line"] + 1, s["lines"]), "\n"))
    return found.select(*key, F.array_join(lines, "\n").alias("text")).where("text <> ''")


def foreign_sentences(docs: DataFrame, model: languages.TrigramTable, language: str, key: list[str], from_html: bool = False, split: Step = T.sentences, normalize: Step | None = None, tokenize: Step | None = None) -> DataFrame:
    """key, pos and sentence: the sentences of docs (key, text or html) in one language.

    The text, or that of the html, is cut to the spans of the language, cleaned and split; each sentence is
    normalised and tokenised by the functions given, and goes if nothing is left. Blank texts have no sentences.
    """
    text = T.html_to_text(F.col("html")) if from_html else F.col("text")
    found = languages.language_spans(docs.select(*key, text.alias("text")), model, key)
    cleaned = text_in(found, language, key).select(*key, T.clean_text(F.col("text")).alias("text"))
    each = cleaned.select(*key, F.posexplode(split(F.col("text"))).alias("pos", "sentence"))
    for step in (normalize, tokenize):
        each = each.withColumn("sentence", step(F.col("sentence"))) if step else each
    return each.withColumn("sentence", F.trim("sentence")).where("sentence <> ''")


def spaced_tokens(text: Column) -> Column:
    """Words and runs of other marks with one blank between them."""
    return F.array_join(T.wordpunct_tokens(text), " ")


def reextracted(pairs: DataFrame, extract: Step = T.html_to_text, model: languages.TrigramTable | None = None, source: str = "", target: str = "") -> DataFrame:
    """Pair rows (src_html, tgt_html) with src_text and tgt_text taken from the html; with a model only what is in the language of the side. Pairs with an empty side go."""
    both = pairs.withColumn("src_text", extract(F.col("src_html"))).withColumn("tgt_text", extract(F.col("tgt_html")))
    if model:
        both = languages.cut(both.withColumn("__pair", F.monotonically_increasing_id()))
        for side, language in (("src_text", source), ("tgt_text", target)):
            found = languages.language_spans(both.select("__pair", F.col(side).alias("text")), model, ["__pair"])
            both = both.drop(side).join(text_in(found, language, ["__pair"]).withColumnRenamed("text", side), "__pair")
        both = both.drop("__pair")
    return both.where("length(trim(src_text)) > 0 AND length(trim(tgt_text)) > 0")


def lett_words(docs: DataFrame, lang: str | None = None, as_set: bool = False) -> DataFrame:
    """Documents (row, lang, text) with their words, or the set of them; only one language if given, without text they go."""
    kept = docs.where((F.col("lang") == lang) if lang else F.lit(True)).where("text <> ''")
    words = T.bag_words(F.col("text"))
    return kept.select("row", "lang", (F.array_sort(F.array_distinct(words)) if as_set else words).alias("words"))


def link_similarity(pairs: DataFrame, pages: DataFrame, tag: str = "a", attribute: str = "href") -> DataFrame:
    """pairs (src, tgt, of pages' key `page`) with jaccard, of the sets of the two pages' links, and quick, the bound of the sequences' ratio."""
    found = pages.select("page", T.links(F.col("html"), tag, attribute).alias("links"))
    side = lambda n: found.select(F.col("page").alias(n), F.col("links").alias(f"{n}_links"))
    both = pairs.join(side("src"), "src").join(side("tgt"), "tgt")
    return _compared_links(both).select(*pairs.columns, "jaccard", "quick")


def _compared_links(both: DataFrame) -> DataFrame:
    a, b = F.col("src_links"), F.col("tgt_links")
    return both.withColumn("jaccard", similarity.jaccard(a, b)).withColumn("quick", similarity.quick_ratio(a, b))


def link_search(pages: DataFrame, group: str = "host", tag: str = "a", attribute: str = "href") -> DataFrame:
    """(src, tgt, jaccard, quick) as link_similarity() has them, of the pages (page, group, html) that are asked for and all other pages of their group."""
    found = pages.select(group, "page", T.links(F.col("html"), tag, attribute).alias("links"))
    side = lambda n, df: df.select(group, F.col("page").alias(n), F.col("links").alias(f"{n}_links"))
    both = search.paired(side("src", found.where(search.asked(F.col("page")))), side("tgt", found), group, "tgt").where("src <> tgt")
    return _compared_links(both).select("src", "tgt", "jaccard", "quick")


def evaluated(found: DataFrame, truth: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row correct, wrong, total: true pairs (src, tgt, order) that are among the found ones (src, tgt, order).

    Names of files (file, url) are replaced by urls where known; both lists are made one-to-one in their order first.
    """

    def named(rows: DataFrame, side: str) -> DataFrame:
        known = names.select(F.col("file").alias(side), F.col("url").alias("__url"))
        return rows.join(known, side, "left").withColumn(side, F.coalesce("__url", side)).drop("__url")

    found = named(named(found, "src"), "tgt") if names else found
    hit = matching.first_wins(found, ["order"]).select("src", "tgt", F.lit(1).alias("hit"))
    mine = matching.first_wins(truth, ["order"]).join(hit, ["src", "tgt"], "left")
    return mine.agg(F.count("hit").alias("correct"), (F.count(F.lit(1)) - F.count("hit")).alias("wrong"), F.count(F.lit(1)).alias("total"))


def first_of_field(rows: DataFrame, value: str = "value") -> DataFrame:
    """Placed lines (see sources.ordered) made distinct by what stands before their first blank: of lines with one such field the first stays, so different lines can collapse."""
    order = F.struct("load", "file", "block", "place")
    return rows.groupBy(F.substring_index(value, " ", 1).alias("field")).agg(F.min_by(value, order).alias(value)).select(value)


def column_of(lines: DataFrame, number: int, separator: str = "\t", value: str = "value") -> DataFrame:
    """One column (from 0) of separated lines; lines that are too short go. Compressed files are read like others."""
    parts = F.split(F.col(value), separator)
    return lines.where(F.size(parts) > number).select(parts[number].alias(value))
