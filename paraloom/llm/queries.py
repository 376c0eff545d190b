"""The queries of this subpackage, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, exact, licenses, media, minhash, mixture, packing, quality, repair, sharding, suffix
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.with_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read_media(media.store_texts(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "media_type",
        "n_embedded",
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), ["doc_id", "start"])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.identify_languages(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_media, op3_packing, op4_quality, op5_suffix_dedup, op6_exact_dedup, op7_license_scan, op8_minhash, op9_hash_tree_shards, op10_chat_perspectives, op11_repair, op12_languages, op13_vector_codes)
}


def _license_sql() -> str:
    def spelled(x: str) -> str:
        x = f"' ' || {x} || ' '"
        for old, new in licenses.EQUIVALENT_SPELLINGS:
            x = f"replace({x}, ' {old} ', ' {new} ')"
        return f"trim({x}, ' ')"

    line = f"CASE WHEN regexp_matches(x, '{licenses.COPYRIGHT_LINE}') THEN '' ELSE trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'), ' ') END"
    known = ", ".join(f"('{name}', '{digest}')" for digest, (name, _) in sorted(licenses.known_licenses().items()))
    return f"""
    WITH known AS (SELECT * FROM (VALUES {known}) v(license, digest)),
    parts AS (SELECT spot, doc_id, unnest(regexp_split_to_array(lowered, '{licenses.BLANK_LINES}')) AS part, generate_subscripts(regexp_split_to_array(lowered, '{licenses.BLANK_LINES}'), 1) AS nth
        FROM (SELECT row_number() OVER () AS spot, doc_id, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') AS lowered FROM documents)),
    lined AS (SELECT spot, doc_id, nth, list_filter(list_transform(string_split(part, chr(10)), lambda x: {line}), lambda x: x <> '') AS l FROM parts),
    whole AS (SELECT spot, doc_id, sha256({spelled("array_to_string(flatten(list(l ORDER BY nth)), ' ')")}) AS canonical_sha256 FROM lined GROUP BY spot, doc_id),
    lines AS (SELECT spot, sha256({spelled("y")}) AS digest FROM (SELECT spot, unnest(l) AS y FROM lined)),
    line_hits AS (SELECT spot, string_agg(DISTINCT license, '|' ORDER BY license) AS line_licenses, count(*) AS n_license_lines FROM lines JOIN known USING (digest) GROUP BY spot),
    part_hits AS (SELECT spot, string_agg(DISTINCT license, '|' ORDER BY license) AS paragraph_licenses FROM (SELECT spot, sha256({spelled("array_to_string(l, ' ')")}) AS digest FROM lined) JOIN known USING (digest) GROUP BY spot)
    SELECT doc_id, canonical_sha256, k.license AS document_license, coalesce(line_licenses, '') AS line_licenses, coalesce(paragraph_licenses, '') AS paragraph_licenses, coalesce(n_license_lines, 0)::BIGINT AS n_license_lines
    FROM whole LEFT JOIN known k ON k.digest = canonical_sha256 LEFT JOIN line_hits USING (spot) LEFT JOIN part_hits USING (spot)"""


def _codes_sql() -> str:
    """Lloyd's rounds on integers as a chain of joins of all parts with all entries."""
    near = lambda book: f"""SELECT r, p, e, d FROM (SELECT r, p, e, d, row_number() OVER (PARTITION BY r, p ORDER BY d, e) AS nth
        FROM (SELECT x.r, x.p, c.e, list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN {book} c USING (p))) WHERE nth = 1"""  # noqa: E731
    rounds = ""
    for i in range(codes.ROUNDS):
        rounds += f"""
    near{i} AS MATERIALIZED ({near(f"book{i}")}),
    sums{i} AS (SELECT p, e, list(s ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(v)::HUGEINT / count(*))::BIGINT AS s
        FROM (SELECT n.p, n.e, unnest(x.x) AS v, generate_subscripts(x.x, 1) AS i FROM near{i} n JOIN parts x USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
    book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.x, b.x) AS x FROM book{i} b LEFT JOIN sums{i} s USING (p, e)),"""
    return f"""
    WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT r, p, x[p * len(x) // {codes.PARTS} + 1 : (p + 1) * len(x) // {codes.PARTS}] AS x FROM kept, range({codes.PARTS}) t(p)),
    book0 AS MATERIALIZED (SELECT p, r AS e, x FROM parts WHERE r < {codes.ENTRIES}),{rounds}
    final AS ({near(f"book{codes.ROUNDS}")}),
    coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM final GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{codes.ROUNDS}) AS codebooks_sha256
    FROM kept JOIN coded USING (r)"""

def _crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a short text, bit by bit."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    turned = "list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), xor(crc, octet))"
    return f"xor(list_reduce({octets}, lambda crc, octet: {turned}, 4294967295), 4294967295)"


def _repair_sql() -> str:
    """The four states' least (cost, audit, text) from row to row of each dialogue."""
    least = lambda *ways: f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"
    after = lambda state, cost, edit, line: f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 't': {state}.t || '{edit}', 'r': {state}.r || {line}}} END"
    line = lambda role, text="''": f"chr(10) || {role} || ':' || {text}"
    gone = lambda state: after(state, repair.DELETE, "D", "''")
    user, assistant = (lambda state, role=role: after(state, repair.INSERT, "I", line(role)) for role in ("'user'", "'assistant'"))

    def taken(state: str, initial: str, role: str) -> str:
        keep, put = after(state, "extra", "K", line("role", "text")), after(state, f"extra + {repair.REROLE}", "R", line(role, "text"))
        return f"CASE WHEN free THEN CASE WHEN left(role, 1) = '{initial}' THEN {keep} ELSE {put} END END"

    base = f"""{gone("e")} AS e, {least(gone("s"), "CASE WHEN free AND left(role, 1) = 's' THEN " + after("e", "extra", "K", line("role", "text")) + " END")} AS s,
            {least(gone("u"), *(taken(x, "u", "'user'") for x in "esa"))} AS u, {least(gone("a"), taken("u", "a", "'assistant'"))} AS a"""
    entry = "STRUCT(c BIGINT, t VARCHAR, r VARCHAR)"
    close = lambda rows: f"SELECT * REPLACE ({least('a', assistant('u'))} AS a) FROM (SELECT * REPLACE ({least('u', *(user(x) for x in 'esa'))} AS u) FROM ({rows}))"
    return rf"""
    WITH RECURSIVE drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw FROM conversations),
    hurt AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE draw <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM hurt),
    judged AS MATERIALIZED (SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        i > 1 AND lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
    turns AS MATERIALIZED (SELECT conv_id, i, role, text, fault IN ('', 'truncated') AS free, CASE fault WHEN 'truncated' THEN {repair.TRUNCATED} ELSE 0 END AS extra FROM judged),
    layers AS (
        {close(f"SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 't': '', 'r': ''}}::{entry} AS e, NULL::{entry} AS s, NULL::{entry} AS u, NULL::{entry} AS a FROM conversations")}
        UNION ALL
        {close(f"SELECT l.conv_id, l.i + 1 AS i, {base} FROM layers l JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i + 1")}),
    ends AS (SELECT conv_id, arg_max({least("e", "a")}, i) AS w FROM layers GROUP BY conv_id),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM judged GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
        w.c AS cost, w.t AS audit, sha256(substr(w.r, 2)) AS repaired_sha256
    FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLES: dict[str, str] = {
    "op5_suffix_dedup": """
    WITH bytes AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
    parts AS (SELECT doc_id, c, substr(h, 2 * c + 1, 2 * (512 + 99)) AS part, length(h) // 2 AS n FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 512)) AS c FROM bytes)),
    starts AS (SELECT doc_id, c, part, n, unnest(range(0, least(512, n - c))) AS i FROM parts),
    cut AS (SELECT doc_id, c + i AS p, substr(part, 2 * i + 1, 2) AS b, CASE WHEN c + i + 100 <= n THEN md5_number(substr(part, 2 * i + 1, 200)) END AS w FROM starts),
    again AS (SELECT doc_id, p, b, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1 AS later FROM cut),
    gone AS (SELECT doc_id, p, b, max(CASE WHEN later THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS l FROM again),
    runs AS (SELECT doc_id, p, b, l IS NOT NULL AND l > p - 100 AS g FROM gone),
    opened AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM runs),
    sums AS (SELECT doc_id, count(*) FILTER (g) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT g), '') AS k FROM opened GROUP BY doc_id)
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
    FROM bytes LEFT JOIN sums USING (doc_id)""",
    "op6_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_minhash": r"""
    WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words),
    items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id""",
    "op7_license_scan": _license_sql(),
    "op11_repair": _repair_sql(),
    "op13_vector_codes": _codes_sql(),
    "op10_chat_perspectives": """
    WITH clean AS (SELECT conv_id, coalesce(turn, -1) AS turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
    n AS (SELECT conv_id, count(DISTINCT role) AS roles FROM clean GROUP BY conv_id),
    views AS (SELECT DISTINCT c.conv_id, c.role AS perspective FROM clean c JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id WHERE roles = 1 OR role <> 'system'),
    parts AS (SELECT c.conv_id, perspective, turn, role, text, role = perspective AS mine,
        CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head
        FROM clean c JOIN views v ON v.conv_id IS NOT DISTINCT FROM c.conv_id),
    placed AS (SELECT *, sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - length(text) - 1 AS spot,
        row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text) AS i FROM parts)
    SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (mine) AS n_masked, string_agg(head || text || chr(10), '' ORDER BY i) AS rendered,
        coalesce(string_agg(spot::BIGINT || ':' || (spot + length(text))::BIGINT, ',' ORDER BY i) FILTER (mine), '') AS mask
    FROM placed GROUP BY conv_id, perspective""",
}
