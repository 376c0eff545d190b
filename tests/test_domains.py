"""Registered domains against the plain rule of the public suffix list, on random rules and hosts; names in letters, addresses, whole lists."""

import random

from pyspark.sql import functions as F

from paraloom.functions import domains
from paraloom.functions import url as U


def plain(host, lines, closed=False):
    """(suffix, registered, domain, subdomain)"""
    labels = host.translate(str.maketrans(domains.DOTS, "...")).rstrip(".").split(".")
    n = 0 if closed else 1
    matched, kept = [], None
    for rule in lines:
        parts = rule.lstrip("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", x.lower()) for p, x in zip(parts, labels[-len(parts) :], strict=True)):
            matched.append(len(parts))
            kept = len(parts) - 1 if rule[0] == "!" else kept
    n = kept if kept is not None else max([n, *matched])
    if len(labels) == 4 and all(x.isdigit() for x in labels):
        n = 0
        return "", ".".join(labels), ".".join(labels), ""
    cut = len(labels) - n
    suffix = ".".join(labels[cut:])
    domain = labels[cut - 1] if cut > 0 else ""
    return suffix, ".".join(labels[max(0, cut - 1) :]), domain, ".".join(labels[: max(0, cut - 1)])


def taken_apart(spark, hosts, rules):
    frame = spark.createDataFrame(list(enumerate(hosts)), "i int, host string").repartition(2)
    split = domains.split_host(F.col("host"), rules)
    return [tuple(r.s) for r in frame.select("i", split.alias("s")).orderBy("i").collect()]


def test_equals_the_plain_rule(spark):
    r = random.Random(1)
    labels = ["a", "b", "c", "com", "jp", "ck"]
    for closed in (False, True):
        suffixes = sorted({".".join(r.choices(labels, k=r.randint(1, 4))) for _ in range(40)})
        wild = sorted({"*." + s for s in r.sample(suffixes, 9)})
        lines = suffixes + wild + sorted({"!" + r.choice(labels) + w[1:] for w in wild})
        hosts = [".".join(r.choices([*labels, "www", "X", "B"], k=r.randint(1, 7))) for _ in range(600)] + ["1.2.3.4", "12.3.4", "a.b.com.", "a。b．com"]
        found = taken_apart(spark, hosts, domains.Rules.of(lines, closed=closed))
        for host, got in zip(hosts, found, strict=True):
            assert got == plain(host, lines, closed), (host, lines)


def test_default_rules(spark):
    hosts = ["www.bbc.co.uk", "co.uk", "a.b.foo.ck", "x.www.ck", "q.city.kawasaki.jp", "q.r.kawasaki.jp", "localhost", "w.pvt.k12.ma.us", "名.公司.cn", "q.xn--55qx5d.cn", ""]
    assert [(s, r) for s, r, _, _ in taken_apart(spark, hosts, domains.RULES)] == [
        ("co.uk", "bbc.co.uk"), ("co.uk", "co.uk"), ("foo.ck", "b.foo.ck"), ("ck", "www.ck"), ("kawasaki.jp", "city.kawasaki.jp"), ("r.kawasaki.jp", "q.r.kawasaki.jp"),
        ("localhost", "localhost"), ("pvt.k12.ma.us", "w.pvt.k12.ma.us"), ("公司.cn", "名.公司.cn"), ("xn--55qx5d.cn", "q.xn--55qx5d.cn"), ("", ""),
    ]


def test_a_whole_list(spark, tmp_path):
    path = tmp_path / "list.dat"
    made = [f"s{i}.t{i % 50}" for i in range(9000)]
    path.write_text("\n".join(["// a remark", "com", "co.uk  // more", "", "*.ck", "!www.ck", "рф", *made, "// ===BEGIN PRIVATE DOMAINS===", "blog.com", "// ===END PRIVATE DOMAINS===", "org"]), encoding="utf-8")
    rules = domains.read_rules(spark, f"file://{path}")
    hosts = ["x.blog.com", "a.co.uk", "x.s77.t27", "x.s77.t28", "d.рф", "d.xn--p1ai", "a.org"]
    assert [r[0] for r in taken_apart(spark, hosts, rules)] == ["com", "co.uk", "s77.t27", "", "рф", "xn--p1ai", "org"]
    assert taken_apart(spark, hosts[:1], domains.read_rules(spark, f"file://{path}", private=True))[0][:2] == ("blog.com", "x.blog.com")


def test_keys_have_ascii_names(spark):
    urls = ["http://www.bücher.de/x", "http://BBC.co.uk/", "nohost", f"http://{'ü' * 70}.de/", f"http://{'a' * 64}.com/", "https://u:p@Straße.example.com:80/"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").orderBy("i")
    u = F.col("url")
    keys = [r.k for r in frame.select(domains.location_key(u, U.host(u), F.lit("c1")).alias("k")).collect()]
    assert [k.split(" ")[0] for k in keys] == ["xn--bcher-kva", "BBC", "__UNKNOWN__", "__UNKNOWN__", "__UNKNOWN__", "example"] and keys[1] == "BBC http://BBC.co.uk/ c1"
    assert [r.k for r in frame.select(U.domain_key(u).alias("k")).collect()] == ["xn--bcher-kva.de", "BBC.co.uk", "__UNKNOWN__", "__UNKNOWN__", "__UNKNOWN__", "example.com"]
    assert [r.k.domain for r in frame.select(U.split_uri(u).alias("k")).collect()][0] == "xn--bcher-kva"
