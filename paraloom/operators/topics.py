"""Topic vectors: each document as its mixture of topics, a further vector for cosines (latent Dirichlet allocation).

The vocabulary is the most frequent terms, a bounded number, so the model (topics times terms) is bounded, whatever the
corpus; counting, fitting and applying are Spark's own and run over all documents. A document without
any of the terms has no vector.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

VOCABULARY, TOPICS = 1 << 14, 50


@dataclass(frozen=True)
class TopicModel:
    counter: CountVectorizerModel
    topics: LDAModel

    def words(self, most: int = 10) -> list[list[str]]:
        """The heaviest terms of each topic."""
        names = self.counter.vocabulary
        return [[names[i] for i in r.termIndices] for r in self.topics.describeTopics(most).orderBy("topic").collect()]

    def vectors(self, docs: DataFrame, terms: Column, key: str) -> DataFrame:
        """key and vector (shares of the topics) of each row of docs with a known term."""
        counted = self.counter.transform(docs.select(F.col(key), F.coalesce(terms, F.array().cast("array<string>")).alias("__terms")))
        found = self.topics.transform(counted).select(key, vector_to_array("__topics").alias("vector"))
        return found.where(F.exists("vector", lambda x: x > 0))


def fit_topics(docs: DataFrame, terms: Column, topics: int = TOPICS, vocabulary: int = VOCABULARY, least_documents: int = 2, rounds: int = 20, seed: int = 1) -> TopicModel:
    """Topics of all docs by their terms (an array of strings)."""
    rows = cut(docs.select(terms.alias("__terms")).where("size(__terms) > 0"))
    counter = CountVectorizer(inputCol="__terms", outputCol="__counts", vocabSize=vocabulary, minDF=float(least_documents)).fit(rows)
    model = LDA(k=topics, maxIter=rounds, seed=seed, featuresCol="__counts", topicDistributionCol="__topics").fit(counter.transform(rows))
    return TopicModel(counter, model)


def vector_cosines(pairs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """pairs (src_id, tgt_id) with score, the cosine of their vectors; 0 where one has none."""
    side = lambda n: vectors.select(F.col(key).alias(f"{n}_id"), F.col("vector").alias(n))
    x = pairs.join(side("src"), "src_id", "left").join(side("tgt"), "tgt_id", "left")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("src", "tgt") / (F.sqrt(dot("src", "src")) * F.sqrt(dot("tgt", "tgt")))
    return x.withColumn("score", F.coalesce(cosine, F.lit(0.0))).drop("src", "tgt")
