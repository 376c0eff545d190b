"""Registered queries of languages inside texts; their SQL twin counts, joins and runs the lines itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import encodings, languages
from .queries import query, table

KEY = ["source", "nth"]
_CLEAN = "' ' || regexp_replace(lower({}), '[^\\p{{L}}]+', ' ', 'g') || ' '"
_GRAMS = "list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3))"

#: Documents of one source and one rank in their languages, one after the other: texts of up to as many languages as there are.
MIXED = "mixed AS (SELECT source, nth, string_agg(text, chr(10) ORDER BY lang) AS text, list(lang ORDER BY lang) AS langs FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS nth FROM documents WHERE lang IS NOT NULL) GROUP BY source, nth)"
SPANS = f"""WITH RECURSIVE {MIXED},
seen AS (SELECT lang AS l, gram, count(*) AS n FROM (SELECT lang, unnest({_GRAMS}) AS gram FROM (SELECT lang, {_CLEAN.format('line')} AS x FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang IS NOT NULL))) GROUP BY ALL),
names AS (SELECT list(l ORDER BY l) AS names FROM (SELECT DISTINCT l FROM seen)),
speaks AS (SELECT l, gram, greatest(ln(n / sum(n) OVER (PARTITION BY l)) - ln({languages.FLOOR}), 0) AS w, row_number() OVER (PARTITION BY l ORDER BY n DESC, gram) AS r FROM seen),
lines AS MATERIALIZED (SELECT source, nth, row_number() OVER (PARTITION BY source, nth ORDER BY i) - 1 AS pos, line FROM (SELECT source, nth, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM mixed) WHERE trim(line, ' ') <> ''),
grams AS (SELECT source, nth, pos, unnest({_GRAMS}) AS gram FROM (SELECT source, nth, pos, {_CLEAN.format('line')} AS x FROM lines)),
scores AS (SELECT source, nth, pos, l, sum(w) AS w FROM grams JOIN (SELECT * FROM speaks WHERE r <= {languages.PER_LANGUAGE}) USING (gram) GROUP BY ALL),
scored AS MATERIALIZED (SELECT source, nth, pos, strlen(line) + 1 AS size, list_transform(names, lambda l: coalesce(m[l], 0.0)) AS e
    FROM lines LEFT JOIN (SELECT source, nth, pos, map_from_entries(list({{'k': l, 'v': w}})) AS m FROM scores GROUP BY ALL) USING (source, nth, pos), names),
walk AS (SELECT source, nth, -1::BIGINT AS pos, list_transform(names, lambda l: 0.0::DOUBLE) AS best, list_transform(names, lambda l: 1::BIGINT) AS back FROM (SELECT DISTINCT source, nth FROM scored), names
    UNION ALL SELECT w.source, w.nth, w.pos + 1, list_transform(range(1, len(e) + 1), lambda i: (e[i] + greatest(best[i], list_max(best) - {languages.SWITCH}))::DOUBLE),
        list_transform(range(1, len(e) + 1), lambda i: CASE WHEN best[i] >= list_max(best) - {languages.SWITCH} THEN i ELSE list_position(best, list_max(best)) END)
    FROM walk w JOIN scored r ON r.source = w.source AND r.nth = w.nth AND r.pos = w.pos + 1),
ends AS (SELECT source, nth, max(pos) AS pos, arg_max(list_position(best, list_max(best)), pos) AS best FROM walk GROUP BY source, nth),
path AS (SELECT source, nth, pos, best::BIGINT AS spot FROM ends UNION ALL SELECT p.source, p.nth, p.pos - 1, w.back[p.spot] FROM path p JOIN walk w ON w.source = p.source AND w.nth = p.nth AND w.pos = p.pos WHERE p.pos > 0),
told AS (SELECT source, nth, pos, size, spot, e, CASE WHEN list_max(e) > 0 THEN names[spot] END AS language, sum(size) OVER (PARTITION BY source, nth ORDER BY pos) - size AS o FROM path JOIN scored USING (source, nth, pos), names),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY source, nth ORDER BY pos) AS run FROM (SELECT *, (language IS DISTINCT FROM lag(language) OVER (PARTITION BY source, nth ORDER BY pos) OR pos = 0)::INT AS fresh FROM told)),
spans AS (SELECT source, nth, language, min(pos) AS line, count(*) AS lines, min(o) AS "offset", sum(size) AS bytes FROM runs WHERE language IS NOT NULL GROUP BY source, nth, run, language)"""


def mixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct("lang", "text")))
    return d.groupBy(*KEY).agg(parts.alias("p")).select(*KEY, F.array_join(F.col("p.text"), "\n").alias("text"), F.col("p.lang").alias("langs"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_spans(mixed_texts(spark, sf_dir), languages.fit(table(spark, sf_dir, "documents")), KEY)


@query(f'{SPANS} SELECT source, nth, language, line::BIGINT AS line, lines::BIGINT AS lines, "offset"::BIGINT AS "offset", bytes::BIGINT AS bytes FROM spans')
def mixed_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = languages.span_rows(_found(spark, sf_dir), KEY)
    return rows.select(*KEY, "language", F.col("line").cast("long").alias("line"), F.col("lines").cast("long").alias("lines"), "offset", "bytes")


@query(f"""{SPANS}, shares AS (SELECT source, nth, language, sum(bytes) AS b FROM spans GROUP BY ALL), placed AS (SELECT *, sum(b) OVER (PARTITION BY source, nth) AS whole, row_number() OVER (PARTITION BY source, nth ORDER BY b DESC, language) AS r FROM shares),
ahead AS (SELECT source, nth, sum(e[spot] - list_max(list_transform(range(1, len(e) + 1), lambda i: CASE WHEN i = spot THEN -1e300 ELSE e[i] END))) FILTER (language IS NOT NULL) AS a FROM told GROUP BY source, nth),
sized AS (SELECT source, nth, count(*) AS n FROM grams GROUP BY source, nth)
SELECT source, nth, coalesce(l, '') AS languages, coalesce(a / n > {languages.MARGIN}, false) AS reliable, NOT coalesce(a / n > {languages.MARGIN}, false) OR coalesce(fr, false) AS accepted FROM mixed
LEFT JOIN (SELECT source, nth, string_agg(language || ':' || floor(100 * b / whole)::INT, ',' ORDER BY r) FILTER (r <= 3) AS l, bool_or(language = 'fr' AND r <= 3 AND floor(100 * b / whole) >= 10) AS fr FROM placed GROUP BY source, nth) USING (source, nth)
LEFT JOIN ahead USING (source, nth) LEFT JOIN sized USING (source, nth)""")
def text_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three languages of each text with percent, whether they are reliable, and whether it is accepted as French."""
    x = languages.text_languages(_found(spark, sf_dir), KEY)
    shown = F.array_join(F.transform("languages", lambda s: F.concat_ws(":", s["language"], s["percent"])), ",")
    return x.select(*KEY, shown.alias("languages"), "reliable", languages.accepts(F.col("languages"), F.col("reliable"), "fr").alias("accepted"))


@query("SELECT doc_id, lang, text, lang AS language FROM documents WHERE lang IS NOT NULL")
def hinted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as bytes of several encodings, read again by the hint of their language."""
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    narrow = F.col("text").rlike(r"^[\x00-\x7f\xa0-\xff]*$") & F.col("lang").isin("fr", "de")
    data = F.when(narrow, F.encode(F.when(narrow, F.col("text")), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    found = encodings.to_unicode(d.select("doc_id", "lang", data.alias("data")), languages.fit(d), ["doc_id", "lang"], hint="lang")
    return found.select("doc_id", "lang", "text", "language")
