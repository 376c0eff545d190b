"""URL functions as Column expressions: parts, hosts, language codes, stripping, features.

A URL is taken apart by one regular expression (RFC 3986, appendix B), so that
malformed ones give empty parts instead of errors.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .domains import SUFFIXES, UNKNOWN, ascii_name, domain_label, registered, subdomain, suffix

#: Codes that name a language in a URL, by language; all lower case.
LANGUAGE_CODES: dict[str, list[str]] = {
    "ar": ["arabic", "ara", "ar"],
    "bg": ["bulgarian", "bul", "bg"],
    "cs": ["czech", "cze", "cz", "cs"],
    "de": ["deutsch", "german", "ger", "deu", "de", "tedesco", "de-de", "de-ch", "de-at", "de-li", "de-lu", "allemand"],
    "en": ["english", "eng", "en", "en-en", "en-us", "en-uk", "en-ca", "en-bz", "en-ab", "en-in", "en-ie", "en-jm", "en-nz", "en-ph", "en-za", "en-tt", "gb", "en-gb", "inglese", "englisch", "us", "e"],
    "es": ["espanol", "spanish", "spa", "esp", "es"],
    "fi": ["finnish", "finnisch", "fin", "suomi", "suomeksi", "suominen", "suomija", "fi-fi", "fi"],
    "fr": ["french", "francais", "fran", "fra", "fre", "fr", "fr-be", "fr-ca", "fr-fr", "fr-lu", "fr-ch", "f"],
    "it": ["italian", "italiano", "ital", "ita", "it-it", "it-ch", "it"],
    "nl": ["dutch", "nederlands", "nl-nl", "nld", "dut", "nl"],
    "pt": ["portuguese", "portugues", "pt-pt", "pt-br", "ptg", "ptb", "pt"],
    "ro": ["romanian", "romana", "romlang", "rom", "ro-ro", "ro"],
    "ru": ["russian", "russkiy", "ru-ru", "rus", "ru"],
    "so": ["soma", "som", "so", "somal", "somali", "so-so", "af-soomaali", "soomaali"],
    "tr": ["turkish", "tur", "turkic", "tr-tr", "tr"],
    "zh": ["chinese", "chi", "zh"],
}
#: The codes and names of the plain, case-sensitive stripper.
PLAIN_CODES: dict[str, list[str]] = {
    "ARABIC": ["arabic", "ara", "ar"],
    "BULGARIAN": ["bulgarian", "bul", "bg"],
    "CHINESE": ["chinese", "chi", "zh"],
    "CZECH": ["czech", "cze", "cz", "cs"],
    "ENGLISH": ["english", "eng", "en"],
    "FRENCH": ["french", "francais", "fra", "fre", "fr"],
    "GERMAN": ["deutsch", "german", "ger", "deu", "de"],
    "SPANISH": ["espanol", "spanish", "spa", "esp", "es"],
}
#: Names of query variables that only choose a language.
LANGUAGE_VARIABLES = ["lang", "clang", "language", "locale", "selectedLocale"]
#: Suffixes of two labels that no wildcard makes.
TWO_LABEL_SUFFIXES = [s for s in SUFFIXES if s.count(".") == 1 and s[0] not in "*!"]
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
ALNUM = "a-zA-Z0-9"


def code_pattern(codes: list[str], ignore_case: bool = True) -> str:
    """Longest alternative first; no ASCII letter or digit may touch a code."""
    forms = sorted({form for c in codes for form in (c, c.replace("-", "_"))}, key=lambda c: (-len(c), c))
    return f"{'(?i)' if ignore_case else ''}(?<![{ALNUM}])(?:{'|'.join(map(re.escape, forms))})(?![{ALNUM}])"


ALL_CODES = [c for codes in LANGUAGE_CODES.values() for c in codes]
CODE = code_pattern(ALL_CODES)
SHORT_CODE = f"(?i)[-_](?:{'|'.join(sorted((c for c in ALL_CODES if '-' not in c), key=lambda c: (-len(c), c)))})(?![{ALNUM}])"
PLAIN_CODE = code_pattern([c for codes in PLAIN_CODES.values() for c in codes], ignore_case=False)


def _name_of(code: Column, table: dict[str, list[str]]) -> Column:
    pairs = [F.lit(x) for name, codes in table.items() for c in codes for x in (c, name)]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), F.lit(""))


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 1)


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def host(url: Column) -> Column:
    """The network location without user information and port."""
    return F.regexp_replace(F.regexp_replace(netloc(url), "^[^@]*@", ""), ":.*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def last_label(url: Column) -> Column:
    return F.element_at(F.split(host(url), r"\."), -1)


def normalize(url: Column, legacy: bool = False) -> Column:
    """Without trailing question marks, with a scheme. legacy: https:// too gets http:// in front."""
    bare = F.regexp_replace(url, r"\?+$", "")
    has = bare.startswith("http://") if legacy else bare.startswith("http://") | bare.startswith("https://")
    return F.when(has, bare).otherwise(F.concat(F.lit("http://"), bare))


def split_uri(url: Column) -> Column:
    """(domain, suffix, path with query)."""
    tail = F.when(query(url) != "", F.concat(path(url), F.lit("?"), query(url))).otherwise(path(url))
    return F.struct(F.coalesce(ascii_name(domain_label(host(url))), F.lit("")).alias("domain"), suffix(host(url)).alias("suffix"), tail.alias("path"))


def domain_key(url: Column) -> Column:
    """The registered domain in ASCII form, which leads the keys of the location index."""
    return F.when(host(url) == "", F.lit(UNKNOWN)).otherwise(F.coalesce(ascii_name(registered(host(url))), F.lit(UNKNOWN)))


def language_of(part: Column) -> Column:
    """The language of the first code found in part, else ''."""
    return _name_of(F.replace(F.lower(F.regexp_extract(part, CODE, 0)), F.lit("_"), F.lit("-")), LANGUAGE_CODES)


def has_language(url: Column, language: Column | str) -> Column:
    """Whether the first code of the path or of the query names the language."""
    language = F.lit(language) if isinstance(language, str) else language
    return (language_of(path(url)) == language) | (language_of(query(url)) == language)


def strip_path(path: Column) -> Column:
    """Language codes go component by component; a component they leave empty vanishes."""

    def strip(c: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(c, SHORT_CODE, ""), CODE, "")
        bare = F.when(~c.rlike(f"^[^{ALNUM}]") & bare.rlike(f"^[^{ALNUM}]"), F.regexp_replace(bare, f"^[^{ALNUM}]+", "")).otherwise(bare)
        return F.when(~c.rlike(f"^[^{ALNUM}]+$") & bare.rlike(f"^[^{ALNUM}]+$"), F.lit("")).otherwise(bare)

    both = F.transform(F.split(path, "/"), lambda c: F.struct(c.alias("old"), strip(c).alias("new")))
    return F.array_join(F.transform(F.filter(both, lambda s: (s["old"] == "") | (s["new"] != "")), lambda s: s["new"]), "/")


def strip_query(query: Column, aggressive: bool = False) -> Column:
    """Pairs whose name or value is only a language code go; the others are encoded again as they were."""
    unescaped = lambda x: F.coalesce(F.try_url_decode(x), x)
    escaped = lambda x: F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A"))
    pairs = F.filter(F.split(query, "[&;]"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(unescaped(F.substring_index(p, "=", 1)).alias("k"), unescaped(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))

    def keep(p: Column) -> Column:
        bare = lambda x: F.regexp_replace(x, CODE, "")
        out = (bare(p["k"]) != "") & ((bare(p["v"]) == p["v"]) | (bare(p["v"]) != ""))
        if aggressive:
            k = F.lower(p["k"])
            for name in LANGUAGE_VARIABLES:
                out = out & ~(F.lit(name).endswith(k) | F.lit(name).startswith(k))
        return out

    return F.array_join(F.transform(F.filter(pairs, keep), lambda p: F.concat(escaped(p["k"]), F.lit("="), escaped(p["v"]))), "&")


def strip_uri(url: Column, expected: Column | str | None = None, remove_index: bool = False, aggressive: bool = False) -> Column:
    """(url, ok): the URL without language codes; not ok without a host or, if given, without the expected language."""
    old = F.regexp_replace(path(url), ";[^/]*$", "")
    new = strip_path(old)
    tidy = new
    for pattern, by in (("//+", "/"), ("__+", "_"), ("/_+", "/"), ("_/", "/"), ("--+", "-")):
        tidy = F.regexp_replace(tidy, pattern, by)
    tidy = F.when(tidy.endswith("/") & (old != "") & ~old.endswith("/"), F.regexp_replace(tidy, "/$", "")).otherwise(tidy)
    tidy = F.when(~tidy.endswith("/") & old.endswith("/"), F.concat(tidy, F.lit("/"))).otherwise(tidy)
    new = F.when(F.length(new) < F.length(old), tidy).otherwise(new)
    rest = strip_query(query(url), aggressive)
    if remove_index:
        new = F.when((rest == "") & new.rlike("(^|/)index[^/]*$"), F.regexp_replace(new, "(^|/)index[^/]*$", "/")).otherwise(new)
    new = F.when((new != "") & ~new.startswith("/"), F.concat(F.lit("/"), new)).otherwise(new)
    made = F.concat(F.lit("http://"), netloc(url), new, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(F.lit("")))
    ok = host(url) != ""
    if expected is not None:
        ok = ok & has_language(url, expected)
    return F.struct(F.when(ok, made).otherwise(F.lit("")).alias("url"), ok.alias("ok"))


def plain_language(part: Column) -> Column:
    """Language name by the plain table, else ''."""
    return _name_of(F.regexp_extract(part, PLAIN_CODE, 0), PLAIN_CODES)


def plain_strip(url: Column) -> Column:
    return F.regexp_replace(url, PLAIN_CODE, "")


def plain_count(url: Column) -> Column:
    return F.regexp_count(url, F.lit(PLAIN_CODE))


def plain_strip_uri(url: Column) -> Column:
    """(language, url): codes go from path and query; the language is the path's, else the query's; scheme and fragment stay."""
    tail = F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?(.*)$", 1)
    head = F.regexp_extract(url, r"^((?:[^:/?#]+:)?(?://[^/?#]*)?)", 1)
    language = F.when(plain_language(path(url)) != "", plain_language(path(url))).otherwise(plain_language(query(url)))
    return F.struct(language.alias("language"), F.concat(head, plain_strip(tail)).alias("url"))


def components(url: Column, max_length: int = 100, valid: list[str] | None = None) -> Column:
    """Distinct features of a URL's parts: sub, domain, tld, d_i, pN, path and query."""
    h = host(url)
    named = lambda kind, x: F.when(x != "", F.array(F.concat(F.lit(f"{kind}:"), x))).otherwise(F.array().cast("array<string>"))
    directories = F.split(path(url), "/")
    short = F.filter(F.transform(directories, lambda d, i: F.when((d != "") & (F.length(d) < 10), F.concat(F.lit("d_"), i.cast("string"), F.lit(":"), d))), lambda x: x.isNotNull())
    pieces = F.flatten(F.transform(directories, lambda d: F.transform(F.filter(F.split(d, "[^0-9A-Za-z=]+"), lambda p: p != ""), lambda p, n: F.array(F.concat(F.lit("p"), n.cast("string"), F.lit(":"), p), F.concat(F.lit("path:"), p)))))
    unescaped = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(query(url), "[&;]"), lambda p: p != ""), lambda p: F.struct(unescaped(F.substring_index(p, "=", 1)).alias("k"), unescaped(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    asked = F.transform(F.filter(pairs, lambda p: F.length(p["v"]) < 20), lambda p: F.concat(F.lit("query:"), p["k"], F.lit("="), p["v"]))
    found = F.concat(named("sub", subdomain(h)), named("domain", domain_label(h)), named("tld", suffix(h)), short, F.flatten(pieces), asked)
    found = F.filter(F.array_distinct(found), lambda c: F.length(F.regexp_replace(c, "^[^:]*:", "")) < max_length)
    return F.array_intersect(found, F.array(*map(F.lit, valid))) if valid else found


def file_rule(url: Column, language: str) -> Column:
    """Whether the file name ends in the language before .htm(l), or, if it is no HTML, has =language."""
    name = F.substring_index(bare(url), "/", -1)
    return F.when(name.rlike("(htm|html)$"), name.rlike(f"[^A-Za-z]{language}\\.html?$")).otherwise(name.contains(f"={language}"))


def path_rule(url: Column, language: str) -> Column:
    """Whether the directory part has the language between two characters that aren't letters (so not at its end)."""
    return F.regexp_replace(bare(url), "/?[^/]*$", "").rlike(f"[^A-Za-z]{language}[^A-Za-z]")


def bare(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/$", "")


def renamed_file(name: Column, from_language: str, to_language: str) -> Column:
    """File name of the other language by the file rule."""
    return F.when(name.rlike(r"\.html?$"), F.regexp_replace(name, f"{from_language}\\.htm(l?)$", f"{to_language}.htm$1")).otherwise(F.regexp_replace(name, f"={from_language}", f"={to_language}"))


def renamed_path(url: Column, from_language: str, to_language: str) -> Column:
    """Whole path of the other language by the path rule."""
    return F.regexp_replace(F.regexp_replace(url, f"{from_language}\\.htm(l?)$", f"{to_language}.htm$1"), f"([^A-Za-z]){from_language}([^A-Za-z])", f"$1{to_language}$2")


def mirrored_from(html: Column, last: bool = False) -> Column:
    """The address in the comment of a mirroring tool: the first, or the last."""
    found = F.regexp_extract_all(html, F.lit(r"Mirrored from (\S+) by HTTrack"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1 if last else 1)), F.lit(""))


def quoted_spaces(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit("%20"))


def archive_path(crawl: Column, folder: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("crawl-data"), F.concat(F.lit("CC-MAIN-"), F.replace(crawl, F.lit("_"), F.lit("-"))), F.lit("segments"), folder, name)


def index_query(base: str, crawl: Column, url: Column) -> Column:
    return F.concat(F.lit(f"{base}/CC-MAIN-"), F.replace(crawl, F.lit("_"), F.lit("-")), F.lit("-index?url="), F.url_encode(url), F.lit("&output=json"))


@F.pandas_udf(StringType())
def joined(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link made absolute; one that can't be joined stays as it is."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return urljoin(b or "", x or "")
        except ValueError:
            return x

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)])
