"""Registered queries of readers, writers and record operators: files are written from the driver's tables and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ngrams
from ..functions import text as T
from ..functions import url as U
from ..operators import candidates, cleaning, evaluation, matching, terms
from ..operators.lineage import new_path
from ..sources import archives, records
from .queries import INDEX, ORACLES, SCORED, SQL_STRIPPED, WORDS, _locations, blank_words, both_sides, query, scored_pairs, sql_host, sql_language, sql_part, sql_registered, table

HTTP = "http://"


def stored_text(lines: DataFrame, separator: str = "\n") -> str:
    """The path of text files with the column value of lines."""
    path = new_path(lines.sparkSession, "lines")
    lines.select("value").write.option("lineSep", separator).text(path)
    return path


def site(df: DataFrame) -> Column:
    return F.concat(F.lit(HTTP), df["source"], F.lit(".example.com/"), df["doc_id"])


SITE = "'http://' || source || '.example.com/' || doc_id"


# --- archives -----------------------------------------------------------------------------------


@query(f"""SELECT {SITE} AS uri, regexp_replace(regexp_replace(coalesce(text, ''), '[\\r\\n]+', chr(10), 'g'), '^\\n|\\n$', '', 'g') AS text FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 10 <> 0""")
def wet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion records; those of another type, or not complete, go."""
    d = table(spark, sf_dir, "documents")
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", "\n"), r"^\n|\n$", "")
    kind, end = F.when(F.col("doc_id") % 7 == 0, "warcinfo").otherwise("conversion"), F.when(F.col("doc_id") % 10 == 0, "").otherwise("\r\n\r\n")
    value = F.concat(F.lit("\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Target-URI: "), site(d), F.lit("\r\n\r\n"), text, end)
    return archives.read_wet(spark, stored_text(d.select(value.alias("value")), "WARC/1.0"))


def _wat(spark: SparkSession, sf_dir: str) -> str:
    p = table(spark, sf_dir, "pages")
    even = F.col("page_id") % 2 == 0
    link = lambda path, url, text: F.struct(F.lit(path).alias("path"), url.alias("url"), text.alias("text"))
    links = F.array(
        link("A@/href", F.when(even, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url")), F.when(F.col("page_id") % 3 == 0, "a Pdf file").otherwise("x")),
        link("IMG@/src", F.concat("url", F.lit(".pdf")), F.lit("pdf")),
    )
    head = F.struct(F.when(F.col("page_id") % 5 != 0, "text/html").alias("Content-Type"))
    response = F.struct(head.alias("Headers"), F.struct(links.alias("Links")).alias("HTML-Metadata"))
    envelope = F.struct(F.struct(F.col("url").alias("WARC-Target-URI")).alias("WARC-Header-Metadata"), F.struct(response.alias("HTTP-Response-Metadata")).alias("Payload-Metadata"))
    size = F.struct(F.octet_length("html").cast("string").alias("Deflate-Length"))
    container = F.struct(F.col("page_id").cast("string").alias("Offset"), F.concat(F.lit("f"), F.col("page_id") % 5).alias("Filename"), size.alias("Gzip-Metadata"))
    lines = p.select(F.to_json(F.struct(container.alias("Container"), envelope.alias("Envelope"))).alias("value"))
    return stored_text(lines.union(p.select(F.lit("WARC/1.0"))))


@query("""SELECT url AS uri, link AS url, text FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN url || '.PDF' ELSE url END AS link, CASE WHEN page_id % 3 = 0 THEN 'a Pdf file' ELSE 'x' END AS text FROM pages)
WHERE page_id % 5 <> 0 AND (lower(link) LIKE '%.pdf' OR contains(lower(text), 'pdf'))""")
def wat_pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.read_wat(spark, _wat(spark, sf_dir), pdf_only=True)


@query("SELECT url, 'c' AS crawl, 'f' || page_id % 5 AS filename, page_id AS \"offset\", strlen(html) AS length, 'UNKNOWN' AS mime FROM pages WHERE page_id % 5 <> 0")
def wat_page_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.wat_locations(archives.read_wat(spark, _wat(spark, sf_dir), links=False), "c")
    return found.select("url", "crawl", "location.filename", "location.offset", "location.length", "location.mime")


@query("SELECT url, 'old' AS crawl, 'seg' || page_id % 3 || '/2010_7.arc.gz' AS filename, page_id AS \"offset\", strlen(html) AS length, 'text/html' AS mime FROM pages WHERE page_id % 4 <> 0 AND page_id % 3 <> 0")
def arc_metadata_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    info = F.struct(F.lit("2010").alias("arcFileDate"), F.lit("7").alias("arcFileParition"), F.concat(F.lit("seg"), F.col("page_id") % 3).alias("arcSourceSegmentId"), F.col("page_id").cast("string").alias("arcFileOffset"), F.octet_length("html").cast("string").alias("compressedSize"))
    entry = F.struct(F.when(F.col("page_id") % 4 == 0, 404).otherwise(200).alias("http_result"), F.when(F.col("page_id") % 3 == 0, "image/png").otherwise("text/html").alias("mime_type"), info.alias("archiveInfo"))
    lines = spark.read.text(stored_text(p.select(F.concat("url", F.lit("\t"), F.to_json(entry)).alias("value"))))
    found = archives.parse_arc_metadata(lines, "old")
    return found.select("url", "crawl", "location.filename", "location.offset", "location.length", "location.mime")


@query("SELECT page_id, html AS body FROM pages")
def archive_record_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("record", F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\nX: y\r\n\r\n"), "html"))
    return archives.record_bodies(p).select("page_id", "body")


@query(f"SELECT {SITE} AS uri, lang AS language, doc_id AS \"offset\", n_chars AS bytes, text FROM documents")
def magic_stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    head = F.concat(F.lit(" uri:"), site(d), F.lit(" language:"), "lang", F.lit(" offset:"), "doc_id", F.lit(" bytes:"), "n_chars", F.lit("\n"))
    return archives.read_magic(spark, stored_text(d.select(F.concat(head, F.coalesce("text", F.lit(""))).alias("value")), archives.MAGIC))


@query(f"SELECT {SITE} AS uri, 'utf-8' AS encoding, 'com' AS tld, source AS domain, n_chars AS bytes, 'ENGLISH ' || (doc_id % 90) || ' 719,' || upper(lang) || ' 7 254' AS langs FROM documents")
def percent_stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    value = F.concat(F.lit(" uri:"), site(d), F.lit(" encoding:utf-8 tld:com domain:"), "source", F.lit(" bytes:"), "n_chars", F.lit("\nENGLISH "), F.col("doc_id") % 90, F.lit(" 719\n"), F.upper("lang"), F.lit(" 7 254\n"))
    found = archives.read_percent_stream(spark, stored_text(d.select(value.alias("value")), archives.MAGIC))
    return found.withColumn("langs", F.array_join(F.transform("langs", lambda x: F.concat_ws(" ", x["lang"], x["percent"].cast("long"), x["score"].cast("long"))), ","))


# --- record files -------------------------------------------------------------------------------


@query(f"SELECT lang, 'text/html' AS mime, 'charset=utf-8' AS encoding, {SITE} AS url, '<p>' || doc_id AS html, coalesce(text, '') AS text FROM documents WHERE lang IN ('en', 'fr')")
def lett_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    docs = d.select("lang", F.lit("text/html").alias("mime"), F.lit("charset=utf-8").alias("encoding"), site(d).alias("url"), F.concat(F.lit("<p>"), "doc_id").alias("html"), F.coalesce("text", F.lit("")).alias("text"))
    return records.parse_lett(spark.read.text(stored_text(records.lett_lines(docs, "en", "fr")))).drop("serialized")


@query(f"SELECT DISTINCT word AS w1, source AS w2 FROM (SELECT source, unnest({WORDS.format('lower(text)')}) AS word FROM documents)")
def dictionary_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary whose header names the languages the other way round, then turned."""
    words = terms.exploded(table(spark, sf_dir, "documents"), blank_words(F.lower("text")), ["source"]).select("source", "term").distinct()
    lines = words.select(F.concat("term", F.lit("\t"), "source").alias("value")).union(spark.createDataFrame([("fr\ten",)], "value string"))
    return cleaning.reversed_dictionary(records.parse_dictionary(spark.read.text(stored_text(lines)), "en", "fr", "fr\ten", lower=True))


@query("SELECT DISTINCT upper(source) AS name, lang AS code FROM documents")
def language_name_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return records.read_language_names(spark, stored_text(d.select(F.concat_ws("  ", "source", "lang").alias("value")).union(d.select(F.lit("alone")))))


@query(f"SELECT string_split({sql_host()}, '.')[-1] AS tld, url, '2015_40' AS crawl, {sql_language(sql_part(3))} || ':' || strlen(html) AS languages FROM pages")
def kv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = both_sides(spark, sf_dir)[0]
    lines = records.kv_lines(kv).union(kv.select(F.concat("tld", F.lit("\tno json"))))
    return records.read_kv(spark, stored_text(lines)).withColumn("languages", F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["lang"], x["bytes"])), ","))


@query("SELECT 's' || (doc_id + i) AS src, 't' || (doc_id + j) AS tgt FROM documents, (VALUES (0), (1)) a(i), (VALUES (0), (5)) b(j)")
def gold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k, i: F.concat(F.lit(k), F.col("doc_id") + i)
    lines = table(spark, sf_dir, "documents").select(F.concat_ws("\t", n("s", 0), n("s", 1), F.lit("<->"), n("t", 0), n("t", 5)).alias("value"))
    return records.parse_groups(spark.read.text(stored_text(lines))).select("src", "tgt")


@query(f"SELECT {SITE} AS src, {SITE} || '/fr' AS tgt FROM documents")
def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return records.read_pairs(spark, stored_text(d.select(F.concat(site(d), F.lit("\t"), site(d), F.lit("/fr")).alias("value"))))


@query("SELECT 'S' || page_id % 4 AS lang, url FROM pages")
def url_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "pages").select(F.concat(F.lit("S"), F.col("page_id") % 4, F.lit("\t "), "url").alias("value"))
    return records.parse_url_listing(spark.read.text(stored_text(lines)))


@query("SELECT page_id, url FROM pages WHERE page_id % 3 <> 1")
def file_names_to_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("file", F.concat("page_id", F.lit(".xml")))
    return records.url_map(p.select("page_id", "file"), p.where("page_id % 3 <> 1").select("file", "url"))


@query("SELECT CASE WHEN page_id % 2 = 0 THEN 'S' ELSE 'D' END AS side, url, (page_id % 2)::INT AS rule1, 1 AS rule2 FROM pages")
def old_candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    lines = p.select(F.concat(F.when(F.col("page_id") % 2 == 0, "S#:").otherwise("D#:"), "url", F.lit("\t"), F.col("page_id") % 2, F.lit("\t1")).alias("value")).union(p.select(F.lit("----")))
    return records.parse_old_candidates(spark.read.text(stored_text(lines)))


@query(f"WITH {INDEX} SELECT url FROM idx")
def location_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.keys(_locations(spark, sf_dir))


@query(f"WITH {INDEX} SELECT domain, url, crawl FROM idx")
def location_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index saved by crawl and sorted, read from its files."""
    path = new_path(spark, "index")
    records.save_locations(_locations(spark, sf_dir), path)
    return spark.read.parquet(path).select("domain", "url", "crawl")


@query(f"SELECT {sql_registered(sql_host())} AS domain, coalesce(nullif({sql_language(sql_part(3))}, ''), 'xx') AS lang, count(*) AS n, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY ALL")
def downloads_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages saved by domain and language, read from their files."""
    path = new_path(spark, "downloads")
    lang = U.language_of(U.path(F.col("url")))
    records.save_downloads(table(spark, sf_dir, "pages").select("url", "html", U.registered(U.host(F.col("url"))).alias("domain"), F.when(lang != "", lang).otherwise("xx").alias("lang")), path)
    return spark.read.schema("url string, html string, domain string, lang string").json(path).groupBy("domain", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))


@query("SELECT source AS domain, doc_id, text AS source FROM documents")
def corpus_files_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "corpus")
    records.save_by_domain(table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), "doc_id", F.col("text").alias("source")), path)
    return spark.read.parquet(path).select("domain", "doc_id", "source")


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS col FROM embeddings")
def saved_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "matrix")
    records.save_table(table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("col", "v")), path)
    return spark.read.parquet(path).select("vec_id", F.col("col").cast("long").alias("col"), "v")


@query("SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 1 OFFSET 6")
def seventh_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.nth(table(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"], 7)


@query("SELECT doc_id, lang, source, text FROM documents WHERE trim(text, ' ') <> ''")
def non_empty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.non_empty(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "text")


@query("SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS translation FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) GROUP BY doc_id UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def documents_with_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("url", F.col("doc_id"))
    return records.with_translations(d.select("doc_id", "url"), d.select("url", F.posexplode(F.split("text", "\n")).alias("pos", "text")), "translation").select("doc_id", "translation")


# --- candidates and cleaning --------------------------------------------------------------------


@query("SELECT page_id, replace('CC-2015_40-' || (page_id % 2), '2015_40', '2015-40') AS crawl FROM pages")
def renamed_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("CC-2015_40-"), F.col("page_id") % 2).alias("crawl"))
    return candidates.renamed_crawl(p, "crawl", "2015_40", "2015-40")


@query(f"""WITH p AS (SELECT url, {sql_language(sql_part(3))} AS lang, regexp_replace(url, '/(en|de|fr|es)/', '//') AS k FROM pages UNION ALL SELECT regexp_replace(url, '/en/', '/fr/'), 'fr', regexp_replace(url, '/(en|de|fr|es)/', '//') FROM pages WHERE {sql_language(sql_part(3))} = 'en')
SELECT DISTINCT s.url AS src, t.url AS tgt FROM p s JOIN p t USING (k) WHERE s.lang = 'en' AND t.lang = 'fr'""")
def plain_url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", U.language_of(U.path(F.col("url"))).alias("lang"))
    derived = p.where("lang = 'en'").select(F.regexp_replace("url", "/en/", "/fr/").alias("url"), F.lit("fr").alias("lang"))
    return candidates.url_links(p.union(derived)).select("src", F.explode("cands.tgt").alias("tgt")).distinct()


@query("SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def one_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("key", F.concat_ws("|", "source", "lang"))
    return candidates.one_per_key(d, "key", ["doc_id"]).select("source", "lang", "doc_id")


@query("""WITH m AS (SELECT 'p' || page_id AS src, 'p' || (page_id + 1) AS tgt FROM pages), i AS (SELECT 'p' || page_id AS url, strlen(html) AS info FROM pages WHERE page_id % 3 <> 0)
SELECT src, tgt, a.info AS src_info, b.info AS tgt_info FROM m LEFT JOIN i a ON a.url = src LEFT JOIN i b ON b.url = tgt""")
def mappings_with_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    name = lambda k: F.concat(F.lit("p"), F.col("page_id") + k)
    info = p.where("page_id % 3 <> 0").select(name(0).alias("url"), F.octet_length("html").cast("long").alias("info"))
    return candidates.mapping_info(p.select(name(0).alias("src"), name(1).alias("tgt")), info).select("src", "tgt", "src_info", "tgt_info")


@query("SELECT doc_id, english_percent FROM (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 101 END AS english_percent FROM documents) WHERE coalesce(english_percent, 0) <= 40")
def limited_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.sampled_english(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") % 101).alias("english_percent")), 40)


@query(f"SELECT page_id, feature FROM ({ORACLES['url_components']}) WHERE feature LIKE 'path:%' OR feature LIKE 'tld:%'")
def features_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(cleaning.kept_features(U.components(F.col("url")), prefixes=["path:", "tld:"])).alias("feature")).distinct()


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END AS label FROM documents")
def valid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.replaced_labels(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label")), ["en", "fr"], "other")


@query(f"SELECT DISTINCT w[1] AS w1, w[2] AS w2 FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents) WHERE doc_id % 3 <> 0 AND len(w) > 1")
def single_word_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = blank_words(F.col("text"))
    entry = F.when(F.col("doc_id") % 3 == 0, F.concat(F.get("w", F.lit(0)), F.lit(" x@#@"), F.get("w", F.lit(1)))).otherwise(F.concat(F.get("w", F.lit(0)), F.lit("@#@"), F.get("w", F.lit(1))))
    return cleaning.single_words(table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select(entry.alias("value"))).distinct()


LEXICON = "lex AS (SELECT DISTINCT doc_id % 37 AS s, doc_id % 53 AS t FROM documents)"


@query(f"""WITH {LEXICON}, x AS (SELECT 's' || s AS w1, 't' || t AS w2, 2 / (8 / (1 + s % 7) + 6 / (1 + t % 5)) AS mean FROM lex) SELECT w1, w2, round(mean, 6) AS mean FROM x WHERE mean > 0.4""")
def harmonic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = table(spark, sf_dir, "documents").select((F.col("doc_id") % 37).alias("s"), (F.col("doc_id") % 53).alias("t")).distinct()
    words = lambda c: lex.select(F.col(c).alias("id"), F.concat(F.lit(c), c).alias("word")).distinct()
    found = cleaning.harmonic_dictionary(lex.withColumn("p", (1 + F.col("s") % 7) / 8), lex.withColumn("p", (1 + F.col("t") % 5) / 6), words("s"), words("t"), 0.4)
    return found.withColumn("mean", F.round("mean", 6))


# --- evaluation and matching --------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id AS src, doc_id + 1 AS tgt FROM documents)
SELECT 'missing' AS kind, count(*) AS n FROM t WHERE src % 3 <> 0 UNION ALL SELECT 'unreachable', count(*) FROM t WHERE src % 2 <> 0 UNION ALL SELECT 'in devset', count(*) FROM documents WHERE doc_id > (SELECT min(doc_id) FROM documents)""")
def devset_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    truth = d.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("tgt"))
    urls = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("url"))
    parts = (("missing", evaluation.missing(truth, truth.where("src % 3 = 0"))), ("unreachable", evaluation.unreachable(truth, urls, "src")), ("in devset", evaluation.in_devset(d.select(F.col("doc_id").alias("tgt")), truth, "tgt")))
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in parts]
    return counted[0].union(counted[1]).union(counted[2])


@query("WITH t AS (SELECT source, arg_min(doc_id, doc_id * 7919 % 1009) AS tgt FROM documents WHERE lang = 'fr' GROUP BY source) SELECT doc_id AS src, tgt FROM documents JOIN t USING (source) WHERE lang = 'en'")
def first_true_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("url"), F.col("source").alias("stripped"), (F.col("doc_id") * 7919 % 1009).alias("idx"))
    return matching.ground_truth(d.where("lang = 'en'").drop("lang"), d.where("lang = 'fr'").drop("lang"))


@query(f"WITH {SCORED} SELECT src, tgt, score, src % 10 = tgt % 10 AS is_pair FROM scored")
def scores_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), (F.col("doc_id") % 10).alias("stripped"))
    return matching.labelled_scores(scored_pairs(spark, sf_dir).select("src", "tgt", "score"), d, d)


@query(f"WITH {SCORED}, x AS (SELECT src, tgt, 1 - score / 1000 AS distance FROM scored) SELECT src AS src_id, min(struct_pack(d := round(distance, 9), t := tgt)).t AS tgt_id, round(min(distance), 6) AS distance FROM x WHERE distance < 1 GROUP BY src")
def nearest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scored_pairs(spark, sf_dir).select(F.col("src").alias("src_id"), F.col("tgt").alias("tgt_id"), (F.col("score") / 1000).alias("score"))
    return terms.nearest(p).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN 0 ELSE embedding[1]::DOUBLE END AS v FROM embeddings")
def scores_without_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 11 != 0, F.col("embedding")[0].cast("double"))
    return matching.without_nan(table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")), "v")


@query("SELECT count(*) AS n, count(*) FILTER (page_id % 3 < 2) AS named, count(*) FILTER (page_id % 3 = 0) AS agree FROM pages")
def mirrored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "")).when(F.col("page_id") % 3 == 1, F.lit("elsewhere.org/x"))
    html = F.when(made.isNotNull(), F.concat(F.lit("<!-- Mirrored from "), made, F.lit(" by HTTrack -->"), "html")).otherwise(F.col("html"))
    return evaluation.strip_agreement(table(spark, sf_dir, "pages").select("url", html.alias("html")))


# --- functions ----------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT page_id, {sql_host()} AS h, {sql_part(3)} AS path, {sql_part(4)} AS q FROM pages)
SELECT page_id, regexp_extract(h, '([^.]+)[.][^.]+$', 1) AS domain, string_split(h, '.')[-1] AS suffix, CASE WHEN q <> '' THEN path || '?' || q ELSE path END AS path FROM p""")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.split_uri(F.col("url")).alias("x")).select("page_id", "x.*")


@query("SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/x/' || page_id || '?a=b' AS link FROM pages")
def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.joined(F.col("url"), F.concat(F.lit("/x/y/../"), "page_id", F.lit("?a=b"))).alias("link"))


@query("SELECT doc_id, text FROM documents")
def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts once read as Latin-1, read right again."""
    return table(spark, sf_dir, "documents").select("doc_id", T.repaired_latin(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).alias("text"))


@query("SELECT doc_id, text FROM documents")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in UTF-8, and in Latin-1 where that has all characters, decoded by what is declared."""
    latin = F.col("text").rlike("^[\\x00-\\xff]*$")
    data = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    declared = T.declared_charset(F.when(latin, "<meta charset=\"ISO-8859-1\">").otherwise("<meta charset=utf-8>"))
    return table(spark, sf_dir, "documents").select("doc_id", T.decoded()(data, declared).alias("text"))


@query(f"WITH w AS (SELECT {WORDS.format('text')} AS w FROM documents), g AS (SELECT unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS gram FROM w WHERE w IS NOT NULL) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def padded_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = table(spark, sf_dir, "documents").select(F.explode(ngrams.padded_ngrams(blank_words(F.col("text")), 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT replace(text, ' ', '') AS t FROM documents WHERE text IS NOT NULL), g AS (SELECT unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) END) AS gram FROM c) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def character_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = table(spark, sf_dir, "documents").select(F.explode(ngrams.character_ngrams(F.col("text"), 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT list_concat(['<s>'], {WORDS.format('text')}, ['</s>']) AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '#' || w[i + 1]))) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def marked_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = table(spark, sf_dir, "documents").select(F.explode(ngrams.orders_ngrams(blank_words(F.col("text")), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s]+')) AS w FROM documents), b AS (SELECT regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS word FROM t)
SELECT word, count(*) AS n FROM b WHERE word <> '' GROUP BY word""")
def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(T.bag_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
