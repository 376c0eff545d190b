"""Language identification: a character-trigram model fitted on labelled text, behind a small interface.

The model is a table (trigram, language, weight) of at most `per_language` trigrams
for each language, so its size is bounded and it may be broadcast. Text is scored
inside Spark by looking its trigrams up in one map literal per language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import padded_ngrams


def trigrams(text: Column) -> Column:
    """Of letters in lower case, other characters being blanks."""
    x = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))
    return padded_ngrams(F.split(x, ""), 3, "")  # of an array, as each substring would walk the text from its start


@dataclass(frozen=True)
class LanguageModel:
    weights: dict[str, dict[str, float]]
    floor: dict[str, float]

    def identify(self) -> Callable[[Column], Column]:
        """text to struct<language, percent, reliable>: the best language, its share of the trigrams, whether the margin is clear."""
        weights, floor = self.weights, self.floor

        def one(text: str | None) -> tuple[str, float, bool]:
            x = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in (text or '').lower()).split())} "  # as trigrams() has it
            n = max(0, len(x) - 2)
            if not n or not weights:
                return "un", 0.0, False
            grams = Counter(map("".join, zip(x, x[1:], x[2:])))
            scores = {k: math.fsum(w.get(g, floor[k]) * c for g, c in grams.items()) / n for k, w in weights.items()}
            best, *rest = sorted(scores, key=lambda k: (-scores[k], k))
            won = sum(c for g, c in grams.items() if g in weights[best]) / n
            return best, round(100 * won, 2), not rest or scores[best] - scores[rest[0]] > 0.1

        return F.pandas_udf(lambda s: pd.DataFrame([one(x) for x in s], columns=["language", "percent", "reliable"]), "struct<language:string,percent:double,reliable:boolean>")


def fit(docs: DataFrame, text: str = "text", language: str = "lang", per_language: int = 2000) -> LanguageModel:
    """Log shares of the most frequent trigrams of each language; only these, at most per_language each, reach the driver."""
    from pyspark.sql import Window

    seen = docs.select(F.col(language).alias("l"), F.explode(trigrams(F.col(text))).alias("g")).groupBy("l", "g").count()
    share = seen.withColumn("p", F.log(F.col("count") / F.sum("count").over(Window.partitionBy("l"))))
    top = share.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("count"), "g"))).where(F.col("r") <= per_language)
    weights: dict[str, dict[str, float]] = {}
    for row in top.select("l", "g", "p").toLocalIterator():
        weights.setdefault(row["l"], {})[row["g"]] = row["p"]
    return LanguageModel(weights, {k: min(v.values()) - 1 for k, v in weights.items()})


def accepts(found: Column, expected: str, strict: bool = True) -> Column:
    """strict: reliable texts must be in the expected language with 10 percent at least; else only a confident other language is refused."""
    if strict:
        return ~found["reliable"] | ((found["language"] == expected) & (found["percent"] >= 10))
    return ~((found["language"] != expected) & found["reliable"] & (found["percent"] > 90))
