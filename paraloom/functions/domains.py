"""Registered domains: longest match of a host's last labels with public suffix rules, and its ASCII form.

Rules are those of the public suffix list: a suffix, `*.` before one for any label more, `!` for an exception
from such a rule. They are a parameter: the few below are the default, `read_rules` takes a whole list.
A match compares the last 1, 2, .. labels with the rules of that many labels, a hashed set each, so its cost
does not grow with the list, and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .ngrams import bound

#: Public suffix rules of more than one label, wildcards and exceptions; every other suffix is the last label.
SUFFIXES = [
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my",
    "com.pe", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "gov.au", "gov.uk", "ne.jp", "net.au", "net.br", "or.jp", "or.kr", "org.au", "org.br", "org.uk",
    "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.kh", "*.mm", "*.np", "*.pg", "kyoto.jp", "ide.kyoto.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp",
    "ca.us", "k12.ca.us", "ma.us", "k12.ma.us", "pvt.k12.ma.us", "公司.cn",
]
#: The lines around the part of a list that is of private owners, and other marks for a dot.
PRIVATE = ("===BEGIN PRIVATE DOMAINS===", "===END PRIVATE DOMAINS===")
DOTS = "。．｡"
UNKNOWN = "__UNKNOWN__"
ADDRESS = r"^\d{1,3}(\.\d{1,3}){3}$"


def punycode(name: str) -> str:
    try:
        return name.encode("idna").decode()
    except UnicodeError:
        return name


@dataclass(frozen=True)
class Rules:
    """Suffixes, what may have one label more before it, and exceptions, each by the number of labels.

    closed: a host under none of the rules has no suffix; else its last label is one.
    """

    exact: dict[int, frozenset[str]] = field(default_factory=dict)
    wild: dict[int, frozenset[str]] = field(default_factory=dict)
    but: dict[int, frozenset[str]] = field(default_factory=dict)
    closed: bool = False

    @classmethod
    def of(cls, lines: Iterable[str], private: bool = False, closed: bool = False) -> Rules:
        """Rules of a list's lines: one rule up to a blank, // begins a remark; names in letters count in ASCII form too."""
        kinds: tuple[dict[int, set[str]], ...] = ({}, {}, {})
        skipped = False
        for line in lines:
            if not private and any(mark in line for mark in PRIVATE):
                skipped = PRIVATE[0] in line
            rule = line.split("//")[0].split()[:1]
            if skipped or not rule or line.lstrip().startswith("//"):
                continue
            name = rule[0].lower().strip(".")
            kind, name = (1, name[2:]) if name.startswith("*.") else (2, name[1:]) if name.startswith("!") else (0, name)
            for form in {name, punycode(name)}:
                kinds[kind].setdefault(form.count(".") + 1, set()).add(form)
        return cls(*({k: frozenset(v) for k, v in kind.items()} for kind in kinds), closed=closed)


RULES = Rules.of(SUFFIXES)


def read_rules(spark: SparkSession, path: str, private: bool = False) -> Rules:
    """The rules of a list in a file; the list is one text, some ten thousand lines."""
    return Rules.of((r.value for r in spark.read.text(path).toLocalIterator()), private, closed=True)


def _last(host: Column, labels: int | Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), F.lit(-labels) if isinstance(labels, int) else -labels)


def undotted(host: Column) -> Column:
    """The host with dots for other marks, none at the end."""
    return F.regexp_replace(F.translate(host, DOTS, "..."), r"\.+$", "")


def suffix_labels(h: Column, rules: Rules = RULES) -> Column:
    """How many labels of a host (lower case, undotted) are its public suffix: the longest rule, an exception before all."""
    has = lambda k: F.lit(True) if k == 1 else _last(h, k) != _last(h, k - 1)
    cases = [F.when(_last(h, k).isin(sorted(rules.but[k])), k - 1) for k in sorted(rules.but, reverse=True)]
    for k in sorted({*rules.exact, *(w + 1 for w in rules.wild)}, reverse=True):
        hit = _last(h, k).isin(sorted(rules.exact[k])) if k in rules.exact else F.lit(False)
        if k - 1 in rules.wild:
            hit = hit | _last(h, k - 1).isin(sorted(rules.wild[k - 1]))
        cases.append(F.when(has(k) & hit, k))
    return F.when(h.rlike(ADDRESS), 0).otherwise(F.coalesce(*cases, F.lit(0 if rules.closed else 1)))


def split_host(host: Column, rules: Rules = RULES) -> Column:
    """struct<suffix, registered, domain, subdomain>; the pieces keep the host's letters.

    registered is the label before the suffix with it, the host itself if there is none before or it is an address;
    domain is that label alone, '' if there is none. Each part of the work is bound once, which keeps the generated code short.
    """
    counted = bound(undotted(host), lambda h: F.struct(h.alias("h"), suffix_labels(F.lower(h), rules).alias("n")))
    cut = bound(counted, lambda s: F.struct(s["h"].alias("h"), _last(s["h"], s["n"]).alias("suffix"), F.when(s["h"].rlike(ADDRESS), s["h"]).otherwise(_last(s["h"], s["n"] + 1)).alias("registered")))

    def parts(s: Column) -> Column:
        rest = F.length(s["h"]) - F.length(s["registered"]) - 1
        domain = F.when(s["suffix"] == "", s["registered"]).when(s["registered"] != s["suffix"], F.substring_index(s["registered"], ".", 1)).otherwise(F.lit(""))
        return F.struct(s["suffix"].alias("suffix"), s["registered"].alias("registered"), domain.alias("domain"), F.when(rest > 0, F.substring(s["h"], F.lit(1), rest)).otherwise(F.lit("")).alias("subdomain"))

    return bound(cut, parts)


def suffix(host: Column, rules: Rules = RULES) -> Column:
    return split_host(host, rules)["suffix"]


def registered(host: Column, rules: Rules = RULES) -> Column:
    return split_host(host, rules)["registered"]


def domain_label(host: Column, rules: Rules = RULES) -> Column:
    return split_host(host, rules)["domain"]


def subdomain(host: Column, rules: Rules = RULES) -> Column:
    return split_host(host, rules)["subdomain"]


def ascii_name(name: Column) -> Column:
    """A name's ASCII form (xn--...); null if it has none, as with labels of over 63 characters. The JVM's own conversion, only where it is needed."""
    other = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name)
    too_long = F.exists(F.split(name, r"\."), lambda x: F.length(x) > 63)
    return F.when(name.rlike(r"[^\x00-\x7F]"), other).when(~too_long, name)


def location_key(url: Column, host: Column, crawl: Column, rules: Rules = RULES) -> Column:
    """The key line of a location: the domain label in ASCII form, the url and the crawl; a name without such a form is unknown."""
    label = ascii_name(domain_label(host, rules))
    return F.concat_ws(" ", F.when((host == "") | label.isNull(), UNKNOWN).otherwise(label), url, crawl)
