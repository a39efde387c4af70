import os
import random
import zlib

import numpy as np
import pytest

from rowlens.llm import quality

SF = "/root/testdata/sf0.1"


def corpus(n=600):
    rng = random.Random(7)
    words = ["the", "of", "and", "house", "river", "tree", "stone", "light", "went", "saw"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 80))) + "."
        good = rng.random() < 0.7
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " | ".join(t.split()), lambda t: t.replace(" ", "### ")])(text)
        rows.append((i, text, "en"))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_held_out_labels_do_not_matter(spark, tables):
    docs, labels = tables
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    assert quality.score(docs, labels).orderBy("doc_id").collect() == quality.score(docs, turned).orderBy("doc_id").collect()


def test_only_the_text_counts(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    assert np.array_equal(model.linear, quality.train(docs.selectExpr("doc_id", "text", "'de' as lang", "'s' as source"), labels).linear)


def test_keep(spark, tables):
    docs, labels = tables
    wide = docs.selectExpr("*", "doc_id as score", "'x' as label")
    kept = quality.keep(wide, labels)
    assert kept.columns == wide.columns
    good = {r.doc_id for r in quality.score(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good


def test_edges(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x"), (2, "x"), (3, "the house " * 300_000)], "doc_id long, text string")
    got = quality.score(docs.select("doc_id", "text").unionByName(odd), labels).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    ones = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (3, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert zlib.crc32(b"2") % 4 != 2  # so it is learned from
    assert all(r.score > 0.99 for r in quality.score(odd, ones).collect())
    assert quality.score(odd.limit(0), labels).collect() == []


def test_scores_equal_a_sum_over_all_pairs(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    some = docs.limit(40).select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "é")], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text").unionByName(some.filter("doc_id > 9000")), labels).collect()}
    for r in some.collect():
        ids, x = quality.features(r.text or "")
        raw = model.bias + sum(float(model.linear[i]) * float(v) for i, v in zip(ids, x))
        for a in range(len(ids)):
            for b in range(a):
                raw += float(model.factors[ids[a]].astype(float) @ model.factors[ids[b]].astype(float)) * float(x[a]) * float(x[b])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-raw))) < 1e-4


def test_the_identity_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32))
    ids, x = np.array([1, 4, 7, 9]), rng.normal(size=4).astype(np.float32)
    slow = 0.3 + sum(m.linear[i] * v for i, v in zip(ids, x))
    slow += sum(m.factors[ids[a]] @ m.factors[ids[b]] * x[a] * x[b] for a in range(4) for b in range(a + 1, 4))
    assert abs(m.raw(ids, x, np.array([0]))[0][0] - slow) < 1e-4


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good = got.quality == 1
    assert (got.predicted == got.quality).mean() > 0.98
    assert (got.predicted[good] == 1).mean() > 0.98 and (got.predicted[~good] == 0).mean() > 0.95
