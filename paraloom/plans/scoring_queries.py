"""Registered queries of extractors and ratios over pairs, posting blocks, and one-to-one pairs of real scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import assignment, postings, scorer, terms, topics
from .queries import WORDS, blank_words, query, table, weights

#: Pairs of documents of one source and language that follow one another there.
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS nth FROM documents), pairs AS (SELECT a.doc_id AS src_id, b.doc_id AS tgt_id FROM ranked a JOIN ranked b ON a.source = b.source AND a.lang = b.lang AND a.nth + 1 = b.nth)"
_TOKENS = {
    "words": "w",
    "bigrams": "CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END",
    "lines": "list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '')",
}
_RATIOS = {
    "jaccard": "coalesce(common / nullif(ka + kb - common, 0), 0)",
    "dice": "coalesce(2 * common / nullif(ka + kb, 0), 1)",
    "weighted_jaccard": "coalesce(smaller / nullif(sa + sb - smaller, 0), 0)",
    "legacy_cosine": "coalesce(product / nullif(qa + qb, 0), 0)",
    "cosine": "coalesce(product / nullif(sqrt(qa) * sqrt(qb), 0), 0)",
    "quick": "coalesce(2 * smaller / nullif(sa + sb, 0), 1)",
    "size": "coalesce(least(sa, sb) / nullif(greatest(sa, sb), 0), 0)",
}


def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("doc_id").over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src_id"), after.alias("tgt_id")).where("tgt_id IS NOT NULL")


@query(f"""WITH {RANKED}, tokenised AS MATERIALIZED (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents), t AS ({' UNION ALL '.join(f"SELECT doc_id, '{e}' AS ex, unnest({x}) AS token FROM tokenised" for e, x in _TOKENS.items())}), c AS (SELECT doc_id, ex, token, count(*) AS n FROM t WHERE trim(token, ' ') <> '' GROUP BY ALL),
alone AS (SELECT doc_id, ex, count(*) AS k, sum(n) AS s, sum(n * n) AS q FROM c GROUP BY ALL), meet AS (SELECT src_id, tgt_id, a.ex, count(*) AS common, sum(least(a.n, b.n)) AS smaller, sum(a.n * b.n) AS product FROM pairs JOIN c a ON a.doc_id = src_id JOIN c b ON b.doc_id = tgt_id AND b.ex = a.ex AND b.token = a.token GROUP BY ALL),
rows AS (SELECT pairs.src_id, pairs.tgt_id, e.ex, coalesce(a.k, 0) AS ka, coalesce(b.k, 0) AS kb, coalesce(a.s, 0) AS sa, coalesce(b.s, 0) AS sb, coalesce(a.q, 0) AS qa, coalesce(b.q, 0) AS qb, coalesce(common, 0) AS common, coalesce(smaller, 0) AS smaller, coalesce(product, 0) AS product
    FROM pairs CROSS JOIN (SELECT unnest([{", ".join(f"'{e}'" for e in _TOKENS)}]) AS ex) e LEFT JOIN alone a ON a.doc_id = pairs.src_id AND a.ex = e.ex LEFT JOIN alone b ON b.doc_id = pairs.tgt_id AND b.ex = e.ex LEFT JOIN meet x ON x.src_id = pairs.src_id AND x.tgt_id = pairs.tgt_id AND x.ex = e.ex)
SELECT src_id, tgt_id, {", ".join(f"round(max(CASE WHEN ex = '{e}' THEN {r} END), 9) AS {e}_{name}" for e in _TOKENS for name, r in _RATIOS.items())} FROM rows GROUP BY src_id, tgt_id""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ratios of three extractors for each pair, in one plan."""
    asked = [(e, r) for e in _TOKENS for r in _RATIOS]
    found = scorer.Registry().scored(ranked_pairs(spark, sf_dir), table(spark, sf_dir, "documents"), asked)
    return found.select("src_id", "tgt_id", *(F.round(f"{e}_{r}", 9).alias(f"{e}_{r}") for e, r in asked))


@query(f"SELECT DISTINCT unnest({WORDS.format('lower(text)')}) AS term, doc_id AS id FROM documents")
def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of all words, out of delta-coded blocks of a bounded number of ids."""
    return postings.postings(postings.posting_blocks(table(spark, sf_dir, "documents"), blank_words(F.lower("text")), "doc_id"))


def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, tgt, score: the cosines of all English and French documents of a source that have a word in common."""
    pairs = terms.cosine_pairs(*terms.sides(weights(spark, sf_dir), "lang", "en", "fr", "source", "doc_id", ["weight"]), "source")
    return pairs.select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt"), F.round("score", 6).alias("score")).where("score > 0")


@query()
def assigned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-to-one pairs of the largest sum of cosines."""
    return assignment.best_assignment(cosine_scores(spark, sf_dir))


@query()
def topic_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of the topic vectors of documents that follow one another in their source and language."""
    d = table(spark, sf_dir, "documents")
    model = topics.fit_topics(d, blank_words(F.lower("text")), topics=8, rounds=10)
    return topics.vector_cosines(ranked_pairs(spark, sf_dir), model.vectors(d, blank_words(F.lower("text")), "doc_id"), "doc_id")
