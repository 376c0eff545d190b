"""The stored index (files read, loads), rows in the order of their files, aligned files, and text lookup by collations."""

import pytest
from pyspark.sql import functions as F

from paraloom.operators import lookup
from paraloom.operators.stored_index import StoredIndex, with_html
from paraloom.sources import ordered, ranges

PLACE = "struct<filename:string,offset:long,length:long,mime:string>"


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few lines, and several small files a task."""
    names = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "50"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def index_rows():
    rows = [(f"d{d}.com", f"http://h{h}.d{d}.com/p{p:03}", f"c{p % 2}", (f"f{d}", p, 10, "text/html")) for d in range(20) for h in range(3) for p in range(40)]
    return rows + [("d5.com", "http://xd5.com.d5.com/é", "c0", ("f", 1, 1, None)), (None, "http://none/", "c0", ("f", 2, 1, None))]


def test_queries_read_only_the_files_they_need(spark, tmp_path):
    rows = index_rows()
    index = StoredIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame(rows, f"domain string, url string, crawl string, location {PLACE}"), 0, file_rows=100)
    total = len(spark.read.parquet(f"{index.path}/runs").inputFiles())
    assert total >= len(rows) / 100
    found = index.prefix("h1.d7.com/p01", "c1")
    assert [r.url for r in found.collect()] == [f"http://h1.d7.com/p{p:03}" for p in range(11, 20, 2)]
    assert len(index.files("d7.com", "http://h1.d7.com/p01", "http://h1.d7.com/p01\U0010ffff")) <= 2 < total
    name = lambda files: {f.rsplit("/", 1)[1] for f in files}
    assert 0 < len(found.inputFiles()) <= 2 and name(found.inputFiles()) <= name(index.files("d7.com"))
    assert len(index.files("d7.com")) <= 3
    assert [r.url for r in index.prefix("http://h1.d7.com/p011", exact=True).collect()] == ["http://h1.d7.com/p011"]
    assert index.prefix("http://h1.d7.com/p011x", exact=True).count() == 0 == index.under("nothing.org").count()
    assert index.under("h2.d3.com").count() == 40 and index.under("d3.com", "c0").count() == 60 and index.under("d3.com", max_results=7).count() == 7
    assert index.prefix("http://xd5.com.d5.com/").count() == 1


def test_last_load_wins_and_a_load_can_be_written_again(spark, tmp_path):
    kind = "domain string, url string, crawl string, location string"
    index = StoredIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame([("a.com", f"http://a.com/{i}", "c", "z") for i in range(9)], kind), 0)
    index.add(spark.createDataFrame([("a.com", f"http://a.com/{i}", "c", "b") for i in range(0, 9, 2)], kind), 1)
    index.add(spark.createDataFrame([("a.com", "http://a.com/4", "c", "a"), ("a.com", "http://a.com/9", "c", "a")], kind), 10)
    assert "".join(r.location for r in index.prefix("http://a.com/").collect()) == "bzbzazbzba"
    index.add(spark.createDataFrame([("a.com", "http://a.com/9", "c", "n")], kind), 10)
    assert "".join(r.location for r in index.prefix("http://a.com/").collect()) == "bzbzbzbzbn"
    assert index.merged().count() == 10


def test_html_of_found_pages(spark, tmp_path):
    root = f"file://{tmp_path}/archives"
    pages = spark.createDataFrame([(f"http://a.com/{i}", f"WARC/1.0\r\n\r\nHTTP/1.1 200\r\n\r\n<p>{i}") for i in range(5)], "url string, record string")
    located = ranges.stored_archives(pages.coalesce(1), root).collect()
    rows = [("a.com", r.url, "c", r.location) for r in located] + [("a.com", "http://a.com/lost", "c", ("lost.gz", 0, 5, None))]
    index = StoredIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame(rows, f"domain string, url string, crawl string, location {PLACE}"), 0)
    found = with_html(index.prefix("http://a.com/"), root)
    assert {r.url: r.html for r in found.collect()} == {f"http://a.com/{i}": f"<p>{i}" for i in range(5)} | {"http://a.com/lost": ""}


def lines(tmp_path, name, *files):
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(files):
        (folder / f"part-{i:05}.txt").write_text("".join(f"{r}\n" for r in rows))
    return f"file://{folder}"


def test_the_line_that_stands_last_wins(spark, tmp_path, small_splits):
    first = [[f"k{i % 7}\tone {f} {i}" for i in range(60)] for f in range(12)]
    second = [[f"k{i % 3}\ttwo {f} {59 - i}" for i in range(60)] for f in range(3)]
    found = ordered.last_written(ordered.key_values(ordered.read_lines(spark, lines(tmp_path, "b", *first), lines(tmp_path, "a", *second))), ["key"])
    expected = {}
    for row in [r for load in (first, second) for f in load for r in f]:
        key, value = row.split("\t")
        expected[key] = value
    assert found.columns == ["key", "value"] and {r.key: r.value for r in found.collect()} == expected


def test_lines_without_one_tab(spark, tmp_path):
    path = lines(tmp_path, "kv", ["a\tb", "none", "x\ty\tz", "\tempty key", "empty value\t"])
    assert {tuple(r) for r in ordered.key_values(ordered.read_lines(spark, path), strict=False).select("key", "value").collect()} == {("a", "b"), ("", "empty key"), ("empty value", "")}
    with pytest.raises(Exception, match="not one tab"):
        ordered.key_values(ordered.read_lines(spark, path)).collect()


def test_files_side_by_side(spark, tmp_path, small_splits, monkeypatch):
    a = [[f"a {f} {i} " + "x" * (i % 50) for i in range(30 + 13 * f)] for f in range(6)]
    b = [[f"b {f} {i}" for i in range(250)] for f in range(2)]
    c = [[], [f"c {i}" for i in range(260)]]
    paths = {n: lines(tmp_path, n, *files) for n, files in (("a", a), ("b", b), ("c", c))}
    flat = [[r for f in files for r in f] for files in (a, b, c)]
    expected = [(i, *rows) for i, rows in enumerate(zip(*flat, strict=False))]
    for few in (ordered.FEW_SPLITS, 0):
        monkeypatch.setattr(ordered, "FEW_SPLITS", few)
        placed = {n: ordered.read_lines(spark, p) for n, p in paths.items()}
        assert placed["a"].rdd.getNumPartitions() > 3
        assert sorted(map(tuple, ordered.zipped(**placed).collect())) == expected
    numbered = ordered.row_numbers(ordered.read_lines(spark, paths["b"], paths["a"]))
    assert [r.value for r in numbered.orderBy("row").collect()] == flat[1] + flat[0]


def test_lookup_by_collations(spark):
    known = spark.createDataFrame([("Café au lait", 1), ("cafe au lait", 2), ("Straße", 3), ("naïve", 4), (None, 9), ("été", 5)], "text string, value int")
    asked = ["Café au lait", "CAFÉ AU LAIT", "CAFE AU LAIT", "Cafê au lait", "straße", "NAIVE", "nothing", None, "été", "NAIVE"]
    found, rest = lookup.looked_up(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, text string"), known)
    assert {r.i: r.value for r in found.collect()} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 3, 5: 4, 8: 5, 9: 4}
    assert {r.i for r in rest.collect()} == {6, 7}


def test_all_rows_of_a_key_in_its_last_load(spark, tmp_path):
    kind = "domain string, url string, crawl string, location string"
    index = StoredIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame([("a.com", "http://a.com/1", "c", x) for x in "pqq"] + [("a.com", "http://a.com/2", "c", x) for x in "rs"], kind), 0)
    index.add(spark.createDataFrame([("a.com", "http://a.com/2", "c", x) for x in "tu"], kind), 1)
    for found in (index.under("a.com", max_results=None), index.prefix("http://a.com/"), index.merged()):
        assert sorted(r.location for r in found.collect()) == list("pqqtu")
