"""Rows of pages go to Python workers in batches of bounded size, and trigrams as numbers are those of the columns."""

import pandas as pd
from pyspark.sql import functions as F

from paraloom.operators import languages, lineage


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    lineage.small_batches(spark)
    size = F.pandas_udf(lambda s: pd.Series([int(s.str.len().sum())] * len(s)), "long")
    pages = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("html"))
    assert pages.select(size("html").alias("n")).agg(F.max("n")).first()[0] <= 2 * lineage.BATCH_BYTES
    spark.conf.set(name, before)


def test_trigrams_as_numbers_are_those_of_the_columns(spark, monkeypatch):
    lines = ["", "a", "ab", "Abc  d1e", "ÉÀ é́ ß", "日本語テキスト", "𝒳𝒴𝒵 𐐀𐐁𐐂", "...", "one two three " * 40, None]
    docs = spark.createDataFrame([("x" if i % 2 else "y", t, i) for i, t in enumerate(lines)], "lang string, text string, id int")
    wanted = docs.select("lang", F.explode(languages.line_trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").count()
    found = docs.select(F.col("lang").alias("l"), languages.letters(F.col("text")).alias("x")).mapInArrow(languages._counted, "l string, gram string, n long").groupBy("l", "gram").agg(F.sum("n"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in wanted.collect()}
    model = languages.fit(docs)
    key = lambda: sorted(map(repr, languages.language_spans(docs, model, ["id"]).collect()))
    local = key()
    monkeypatch.setattr(languages, "SMALL_MODEL", 0)
    assert key() == local
