"""Registered queries of archives read by ranges, of the stored index and its domains, and of files in the order of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains
from ..functions import url as U
from ..operators import lookup
from ..operators.lineage import cut, new_path
from ..operators.stored_index import StoredIndex, with_html
from ..sources import archives, ordered, ranges
from .queries import query, sql_host, sql_registered, table

HEAD = "WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"


def _stored_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The pages as gzip members of archive files: (url, location) and the files' folder."""
    root = new_path(spark, "archives")
    pages = table(spark, sf_dir, "pages").select("url", F.concat(F.lit(HEAD), F.coalesce("html", F.lit(""))).alias("record"))
    return cut(ranges.stored_archives(pages, root)), root


@query("SELECT url, coalesce(html, '') AS body FROM pages")
def archive_range_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    located, root = _stored_pages(spark, sf_dir)
    return ranges.read_ranges(located, root).select("url", archives.record_body(F.decode("record", "UTF-8")).alias("body"))


@query(f"SELECT '{archives.MAGIC} ' || url || chr(10) || coalesce(html, '') || chr(10) AS value FROM pages WHERE {sql_registered(sql_host())} = 'example.org'")
def domain_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    located, root = _stored_pages(spark, sf_dir)
    wanted = located.where((U.domain_key(F.col("url")) == "example.org") & F.col("location.mime").isin("text/html", "UNKNOWN"))
    return ranges.dumped(ranges.read_ranges(wanted, root), archives.MAGIC, html_only=True)


RECRAWLED = "contains(url, '?')"


def _stored_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The pages as one load, those with a query in their url once more as a later one."""
    p = table(spark, sf_dir, "pages").select(U.domain_key(F.col("url")).alias("domain"), "url", F.lit("c1").alias("crawl"), F.struct(F.col("page_id").alias("offset"), F.octet_length("html").alias("length")).alias("location"))
    again = p.where(RECRAWLED).withColumn("location", F.struct((-F.col("location.offset")).alias("offset"), F.col("location.length").alias("length")))
    index = StoredIndex(spark, new_path(spark, "index"))
    index.add(p, 0)
    index.add(again, 1)
    return index


STORED = f"SELECT url, 'c1' AS crawl, CASE WHEN {RECRAWLED} THEN -page_id ELSE page_id END AS \"offset\" FROM pages"


@query(f"{STORED} WHERE starts_with(url, (SELECT regexp_extract(min(url), '^[^/]*//[^/]*', 0) FROM pages)) AND {sql_host()} = (SELECT {sql_host('min(url)')} FROM pages) ORDER BY url LIMIT 10000")
def stored_index_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of the host of the first url, from the files that can have them."""
    first = table(spark, sf_dir, "pages").agg(F.regexp_extract(F.min("url"), "^[^/]*//[^/]*", 0)).first()[0]
    return _stored_index(spark, sf_dir).prefix(first, "c1").where(U.host(F.col("url")) == U.host(F.lit(first))).select("url", "crawl", "location.offset")


@query(f"{STORED} WHERE {sql_registered(sql_host())} = 'example.net'")
def stored_index_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_index(spark, sf_dir).under("example.net", max_results=None).select("url", "crawl", "location.offset")


@query(f"SELECT url, coalesce(html, '') AS html FROM pages WHERE {sql_registered(sql_host())} = 'example.com'")
def stored_index_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain query with the pages' html, which is read from the archives by ranges."""
    located, root = _stored_pages(spark, sf_dir)
    index = StoredIndex(spark, new_path(spark, "index"))
    index.add(located.select(U.domain_key(F.col("url")).alias("domain"), "url", F.lit("c1").alias("crawl"), "location"), 0)
    return with_html(index.under("example.com", max_results=None), root).select("url", "html")


def _text_file(spark: SparkSession, rows: DataFrame, *order, files: int) -> str:
    """Lines (value) as so many text files, in an order."""
    path = new_path(spark, "ordered")
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("value").write.text(path)
    return path


@query(f"""WITH w AS (SELECT {sql_host()} AS key, url AS value, 0 AS load, page_id AS pos FROM pages UNION ALL SELECT {sql_host()}, url || '#again', 1, -page_id FROM pages WHERE {RECRAWLED})
SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY load DESC, pos DESC) AS nth FROM w) WHERE nth = 1""")
def last_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of key-value lines, keys repeated in each: the line that stands last wins."""
    p = table(spark, sf_dir, "pages").withColumn("value", F.concat_ws("\t", U.host(F.col("url")), "url"))
    again = p.where(RECRAWLED).withColumn("value", F.concat("value", F.lit("#again")))
    lines = ordered.read_lines(spark, _text_file(spark, p, "page_id", files=5), _text_file(spark, again, F.desc("page_id"), files=3))
    return ordered.last_written(ordered.key_values(lines), ["key"])


@query("""SELECT (row_number() OVER ()) - 1 AS row, document, page FROM (SELECT doc_id || ' ' || lang AS document FROM documents ORDER BY doc_id) POSITIONAL JOIN (SELECT url AS page FROM pages ORDER BY url DESC)
WHERE document IS NOT NULL AND page IS NOT NULL""")
def parallel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two files side by side, as far as the shorter one goes; the files have different parts."""
    d = table(spark, sf_dir, "documents").withColumn("value", F.concat_ws(" ", "doc_id", "lang"))
    p = table(spark, sf_dir, "pages").withColumn("value", F.col("url"))
    lines = [ordered.placed(spark.read.text(_text_file(spark, rows, by, files=n))) for rows, by, n in ((d, F.col("doc_id"), 7), (p, F.desc("url"), 3))]
    return ordered.zipped(document=lines[0], page=lines[1])


#: Letters with accents and without.
ACCENTS = ("éèêëçàâñíóúáîôûöäü", "eeeecaaniouaiouoau")
ASKED = {
    "spark": lambda: F.expr(f"CASE lang WHEN 'fr' THEN upper(line) WHEN 'es' THEN translate(lower(line), '{ACCENTS[0]}', '{ACCENTS[1]}') WHEN 'de' THEN line ELSE concat(line, '?') END"),
    "sql": f"CASE lang WHEN 'fr' THEN upper(line) WHEN 'es' THEN translate(lower(line), '{ACCENTS[0]}', '{ACCENTS[1]}') WHEN 'de' THEN line ELSE line || '?' END",
}


@query(f"""WITH lines AS (SELECT doc_id, lang, string_split(text, chr(10))[1] AS line FROM documents WHERE text IS NOT NULL),
known AS (SELECT line AS found, min(doc_id) AS value FROM lines GROUP BY line), asked AS (SELECT doc_id, lang, {ASKED['sql']} AS text FROM lines),
folded AS (SELECT lower(found) AS k, min(found) AS f FROM known GROUP BY k), bare AS (SELECT lower(strip_accents(found)) AS k, min(found) AS f FROM known GROUP BY k),
named AS (SELECT doc_id, coalesce(e.found, c.f, a.f) AS found FROM asked LEFT JOIN known e ON e.found = asked.text LEFT JOIN folded c ON c.k = lower(asked.text) LEFT JOIN bare a ON a.k = lower(strip_accents(asked.text)))
SELECT doc_id, found, value FROM named JOIN known USING (found)""")
def text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of all documents, looked up as they are, in capitals, or without accents; some with a mark more are not found."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    known = lines.groupBy(F.col("line").alias("text")).agg(F.min("doc_id").alias("value"))
    found, _ = lookup.looked_up(lines.select("doc_id", ASKED["spark"]().alias("text")), known)
    return found.select("doc_id", "found", "value")


# --- registered domains -------------------------------------------------------------------------

#: Ends of hosts: suffixes of 1 to 4 labels, wildcards, their exceptions, names in letters and in ASCII form.
ENDS = ["com", "co.uk", "uk", "kyoto.jp", "ide.kyoto.jp", "x.kawasaki.jp", "city.kawasaki.jp", "kawasaki.jp", "foo.ck", "www.ck", "ck", "us", "k12.ca.us", "pvt.k12.ma.us", "unlisted.zz", "公司.cn", "xn--55qx5d.cn", "bücher.de", "Straße.CO.UK"]
#: ASCII forms of the names with other letters.
ASCII_NAMES = {"bücher": "xn--bcher-kva", "Straße": "strasse"}


def _sql_rules(kind: str) -> str:
    rules = getattr(domains.RULES, kind)
    return ", ".join(f"('{r}', {k})" for k, names in sorted(rules.items()) for r in sorted(names))


@query(f"""WITH ends AS (SELECT unnest([{", ".join(f"'{e}'" for e in ENDS)}]) AS e), exact AS (SELECT * FROM (VALUES {_sql_rules("exact")}) t(rule, k)), wild AS (SELECT * FROM (VALUES {_sql_rules("wild")}) t(rule, k)), but AS (SELECT * FROM (VALUES {_sql_rules("but")}) t(rule, k)),
hosts AS (SELECT page_id, e, url, string_split({sql_host()}, '.example.')[1] || '.' || e AS host FROM pages, ends),
tails AS (SELECT page_id, e, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM hosts),
hits AS (SELECT page_id, e, k, list_contains((SELECT list(rule) FROM but), t) AS b, list_contains((SELECT list(rule) FROM exact), t) OR (k > 1 AND list_contains((SELECT list(rule) FROM wild), w)) AS h
    FROM (SELECT page_id, e, k, lower(array_to_string(l[-k:], '.')) AS t, CASE WHEN k > 1 THEN lower(array_to_string(l[-(k - 1):], '.')) END AS w FROM tails)),
found AS (SELECT page_id, e, coalesce(max(k) FILTER (b) - 1, max(k) FILTER (h), 1) AS n FROM hits GROUP BY page_id, e),
cut AS (SELECT page_id, url, host, n, string_split(host, '.') AS l FROM hosts JOIN found USING (page_id, e)),
named AS (SELECT *, CASE WHEN len(l) > n THEN l[-(n + 1)] ELSE '' END AS label FROM cut)
SELECT page_id, host, array_to_string(l[-n:], '.') AS suffix, label AS domain, array_to_string(l[-(n + 1):], '.') AS registered, array_to_string(l[: greatest(len(l) - n - 1, 0)], '.') AS subdomain,
CASE label {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ASCII_NAMES.items())} ELSE label END || ' ' || url || ' c' AS key FROM named""")
def registered_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts of all pages under each kind of suffix, taken apart."""
    ends = F.explode(F.array(*map(F.lit, ENDS)))
    p = table(spark, sf_dir, "pages").select("page_id", "url", ends.alias("e"))
    p = p.withColumn("host", F.concat(F.substring_index(U.host(F.col("url")), ".example.", 1), F.lit("."), "e"))
    x = F.col("host")
    return p.select("page_id", "host", domains.suffix(x).alias("suffix"), domains.domain_label(x).alias("domain"), domains.registered(x).alias("registered"), domains.subdomain(x).alias("subdomain"), domains.location_key(F.col("url"), x, F.lit("c")).alias("key"))
