"""One-to-one matching of scored pairs, link features, classifiers and evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def first_wins(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Greedy one-to-one in list order: the first pair takes both of its urls (src, tgt)."""
    return greedy(pairs.withColumn("__order", F.struct(*order)), [F.col("__order").asc()], ascending=True).drop("__order")


def greedy(pairs: DataFrame, order: list | None = None, group: str | None = None, score: str = "score", seeds: DataFrame | None = None, ascending: bool = False) -> DataFrame:
    """Greedy one-to-one by descending score; on ties the larger (src, tgt) first. Rounds of pairs that are best for both sides.

    Equal to the sequential scan under a total order. seeds (src, tgt) are taken first.
    """
    keys = [group] if group else []
    rank = F.struct("__order", "src", "tgt") if ascending else F.struct(score, "src", "tgt")
    best_of = F.min if ascending else F.max
    left, taken = pairs.dropDuplicates([*keys, "src", "tgt"]), None
    if seeds is not None:
        taken = left.join(seeds, ["src", "tgt"], "left_semi")
        left = left.join(seeds.select("src"), "src", "left_anti").join(seeds.select("tgt"), "tgt", "left_anti")
    left = cut(left)
    while left.head(1):
        r = left.withColumn("__rank", rank)
        s, t = r.groupBy(*keys, "src").agg(best_of("__rank").alias("__s")), r.groupBy(*keys, "tgt").agg(best_of("__rank").alias("__t"))
        won = cut(r.join(s, [*keys, "src"]).join(t, [*keys, "tgt"]).where("__rank = __s AND __rank = __t").select(*left.columns))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(won.select(*keys, "src"), [*keys, "src"], "left_anti").join(won.select(*keys, "tgt"), [*keys, "tgt"], "left_anti"))
    return left if taken is None else taken


def mutual_best(pairs: DataFrame, score: str = "score") -> DataFrame:
    """Pairs that are each other's best: the first round of greedy()."""
    rank = F.struct(score, "src", "tgt")
    r = pairs.withColumn("__rank", rank)
    both = r.withColumn("__s", F.max("__rank").over(Window.partitionBy("src"))).withColumn("__t", F.max("__rank").over(Window.partitionBy("tgt")))
    return both.where("__rank = __s AND __rank = __t").drop("__rank", "__s", "__t")


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, row_of, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0, free = row_of[j0], ~used[1:]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if not row_of[j0]:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def incoming(edges: DataFrame) -> DataFrame:
    """Links (src, dst) that lead to each page, duplicates counted."""
    return edges.groupBy(F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("n"))


def linkage(edges: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(src, tgt, score): half of 1/in(src) if the target links to the source, and of 1/in(tgt) if the source links to the target."""
    n = incoming(edges)
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    back = one.join(source.select(F.col("url").alias("b")), "b").join(target.select(F.col("url").alias("a")), "a").select(F.col("b").alias("src"), F.col("a").alias("tgt"), F.col("b").alias("to"))
    forth = one.join(source.select(F.col("url").alias("a")), "a").join(target.select(F.col("url").alias("b")), "b").select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.col("b").alias("to"))
    both = back.unionByName(forth).join(n, F.col("to") == F.col("url"))
    return both.groupBy("src", "tgt").agg((F.sum(1 / F.col("n")) / 2).alias("score"))


def ranks_of_true(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Rank from 0 of the true target in its source's descending scores; ties give the smallest."""
    w = Window.partitionBy("src").orderBy(F.desc("score"))
    return scores.withColumn("rank", F.rank().over(w) - 1).join(truth, ["src", "tgt"], "left_semi")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """found, size and recall of true pairs (src, tgt)."""
    hit = truth.select("src", "tgt").distinct().join(found.select("src", "tgt").distinct().withColumn("hit", F.lit(1)), ["src", "tgt"], "left")
    return hit.agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("size")).withColumn("recall", F.col("found") / F.col("size"))


def group_recall(found: DataFrame, truth: DataFrame, order: str = "score") -> DataFrame:
    """n:m truth (group_id, src, tgt): a hit on one member uses up its group; found pairs go by order."""
    hits = found.join(truth, ["src", "tgt"])
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc(order), "src", "tgt"))).where("n = 1")
    return first.agg(F.count(F.lit(1)).alias("found")).join(truth.agg(F.count_distinct("group_id").alias("size")))


def ground_truth(source: DataFrame, target: DataFrame) -> DataFrame:
    """First target (by idx; of equal ones the smallest url) of each source (url, stripped) with the same stripped url."""
    t = target.groupBy("stripped").agg(F.min_by("url", F.struct("idx", "url")).alias("tgt"))
    return source.join(t, "stripped").select(F.col("url").alias("src"), "tgt")


def labelled_scores(scores: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Every scored pair with is_pair: whether both strip to one url."""
    s, t = source.select(F.col("url").alias("src"), F.col("stripped").alias("s")), target.select(F.col("url").alias("tgt"), F.col("stripped").alias("t"))
    return scores.join(s, "src").join(t, "tgt").withColumn("is_pair", F.col("s") == F.col("t")).drop("s", "t")


def zscores(cells: DataFrame, column: str, value: str) -> DataFrame:
    """Column-wise standard scores (population); a constant column gives 0."""
    stats = cells.groupBy(F.col(column).alias("__of")).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    joined = cells.join(stats, F.col(column).eqNullSafe(F.col("__of")))
    return joined.withColumn("z", F.when(F.col("__sd") > 0, (F.col(value) - F.col("__mean")) / F.col("__sd")).otherwise(0.0)).drop("__of", "__mean", "__sd")


def matrix_stats(cells: DataFrame, value: str) -> DataFrame:
    return cells.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("sd"))


def without_nan(scores: DataFrame, value: str) -> DataFrame:
    return scores.withColumn(value, F.coalesce(F.nanvl(F.col(value), F.lit(0.0)), F.lit(0.0)))


def feature_rows(scores: DataFrame, truth: DataFrame, features: list[str]) -> DataFrame:
    """Training rows: all pairs of the sources in the truth, one column a feature (long scores: src, tgt, feature, score), label 1 for true pairs."""
    mine = scores.join(truth.select("src").distinct(), "src", "left_semi")
    wide = mine.groupBy("src", "tgt").pivot("feature", features).agg(F.max("score")).fillna(0.0, features)
    return wide.join(truth.select("src", "tgt").distinct().withColumn("label", F.lit(1.0)), ["src", "tgt"], "left").fillna(0.0, ["label"])


def balanced(rows: DataFrame) -> DataFrame:
    """Weights by class: total / (classes * count)."""
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return rows.join(F.broadcast(n.join(total).select("label", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))), "label")  # one row a class


def fit_classifier(rows: DataFrame, features: list[str], c: float = 10_000.0, folds: int | None = None):
    """Logistic regression with balanced class weights; with folds, the regularisation is chosen by cross validation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = balanced(rows)
    regression = LogisticRegression(weightCol="weight", regParam=1.0 / (c * max(1, rows.count())), maxIter=100)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), regression])
    if not folds:
        return pipeline.fit(data)
    grid = ParamGridBuilder().addGrid(regression.regParam, [1e-6, 1e-4, 1e-2]).build()
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, seed=1).fit(data)


def predict(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def cross_predicted(rows: DataFrame, features: list[str], fold: str) -> DataFrame:
    """rows with the score of a model that was fitted on all rows of the other folds. Folds are few; a model of one class alone scores its share."""
    rows = cut(rows)
    out = []
    for (k,) in sorted(rows.select(fold).distinct().collect()):
        seen, held = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
        share = seen.agg(F.avg("label")).first()[0]
        out.append(held.withColumn("score", F.lit(share or 0.0)) if share in (None, 0.0, 1.0) else predict(fit_classifier(seen, features), held))
    return reduce(DataFrame.unionByName, out) if out else rows.withColumn("score", F.lit(0.0))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(value, name): the average rank from 1 of each different value among rows. Values are ranged over all partitions, whose counts give each its start; nulls have none."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", ahead(Window.orderBy("part")).alias("start"))  # a row a partition
    placed = ranged.withColumn("before", ahead(Window.partitionBy("part").orderBy(value))).join(F.broadcast(starts), "part")
    return placed.select(value, (F.col("start") + F.col("before") + (F.col("n") + 1) / 2).alias(name))


def correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson, and Spearman over average ranks."""
    x = rows.join(average_ranks(rows, a, "ra"), a).join(average_ranks(rows, b, "rb"), b)
    return x.agg(F.corr(a, b).alias("pearson"), F.corr("ra", "rb").alias("spearman"))
