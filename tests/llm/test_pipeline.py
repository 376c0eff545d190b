"""The quality model against a plain one, and the pipeline stage by stage against brute force."""

import os
import random
import zlib
from array import array
from collections import Counter
from math import log

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from paraloom.llm import quality
from paraloom.llm.common import table, written

from .test_llm import VOCABULARY, groups_by_brute_force, removed_by_brute_force, words

SF = "/root/testdata/sf0.001"


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over bytes with dictionaries; order 1 has one discount of a half, shared by all bytes."""

    def __init__(self, texts, order=5):
        self.order, self.counts = order, {order: Counter()}
        for text in texts:
            data = b"\n" * (order - 1) + text
            self.counts[order].update(data[i : i + order] for i in range(len(data) - order + 1))
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cuts, self.heads = {}, {}
        for k in range(2, order + 1):
            of = Counter(self.counts[k].values())
            n1, n2, n3, n4 = (of[i] for i in (1, 2, 3, 4))
            self.cuts[k] = [0.0, 0.5, 0.5, 0.5]
            if min(n1, n2, n3):
                y = n1 / (n1 + 2 * n2)
                self.cuts[k] = [0.0, *(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
            heads = self.heads[k] = {}
            for g, c in self.counts[k].items():
                total, kept = heads.get(g[:-1], (0, 0.0))
                heads[g[:-1]] = total + c, kept + self.cuts[k][min(c, 3)]

    def nll(self, text):
        data, total = b"\n" * (self.order - 1) + text, 0.0
        ones = self.counts[1]
        for i in range(len(data) - self.order + 1):
            gram = data[i : i + self.order]
            p = (max(ones[gram[-1:]] - 0.5, 0) + 0.5 * len(ones) / 256) / sum(ones.values())
            for k in range(2, self.order + 1):
                if (head := self.heads[k].get(gram[-k:-1])) is not None:
                    c = self.counts[k][gram[-k:]]
                    p = (max(c - self.cuts[k][min(c, 3)], 0.0) + head[1] * p) / head[0]
            total -= log(p)
        return total


def test_quality_scores_equal_a_plain_model(spark, tmp_path):
    r = random.Random(12)
    given = [(i, words(200 + i, r.randrange(5, 60), 30) + (" é🙂" if i % 5 == 0 else ""), "en") for i in range(60)] + [(70, None, "en"), (71, "", None), (72, "\n\n", "en"), (73, "qq zz", "en")]
    spark.createDataFrame(given, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(41, 0, 0), (42, 1, 1)], "doc_id long, quality int, toxic int")
    trained = {x["doc_id"] for x in quality.trusted_keys(labels, "doc_id").where("NOT held_out").collect()}
    assert 20 < len(trained) < 40
    model = PlainKneserNey([t.encode() for i, t, _ in given if i in trained])
    found = {x["doc_id"]: x["nll"] for x in quality.score_documents(docs, labels).collect()}
    for i, text, _ in given:
        assert found[i] == pytest.approx(model.nll((text or "").encode()), rel=1e-5, abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pipeline_stages_equal_brute_force(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "suffix dedup", "packing"]
    docs = table(spark, SF, "documents")
    columns, texts = docs.columns, lambda df: {r["doc_id"]: r["text"] or "" for r in df.collect()}
    seen = [texts(docs)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if i < 4:
            assert docs.columns == columns
            docs = written(docs, "stage")
            seen.append(texts(docs))
    given, good, exact, near, cut = seen
    judged = {r["doc_id"]: r["kept"] for r in quality.classify(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert good == {i: t for i, t in given.items() if judged[i]} and len(good) > 0.8 * len(given)
    last = {t: max(j for j, u in good.items() if u == t) for t in set(good.values())}
    assert exact == {i: t for t, i in last.items()}
    assert set(near) == {i for i, _, _, kept in groups_by_brute_force(list(exact.items())) if kept} and all(exact[i] == t for i, t in near.items())
    removed = {i: v[0] for i, v in removed_by_brute_force(list(near.items())).items()}
    assert cut == {i: t for i, (_, n, _, kept) in removed.items() if (t := kept.decode(errors="ignore")) or not n}
    t, expected = Tokenizer.from_file(VOCABULARY), []
    for i, text in cut.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        expected += [(i, s, len(ids[s : s + 2048]), zlib.crc32(array("I", ids[s : s + 2048]).tobytes())) for s in range(0, len(ids), 2048)]
    assert sorted(tuple(r) for r in docs.select("doc_id", "start", "length", "ids_crc32").collect()) == sorted(expected)
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()} == set(expected)
