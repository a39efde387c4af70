import hashlib
import random
import re

import pytest

from rowlens.llm import exact_dedup

SCHEMA = "doc_id long, text string"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (d, t), n in zip(rows, norm):
        group = [(len(u or ""), e) for (e, u), m in zip(rows, norm) if m == n]
        most = max(x for x, _ in group)
        ids = [e for x, e in group if x == most and e is not None]
        out.append((d, min(ids) if ids else None, len(group), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **k):
    return exact_dedup.groups(spark.createDataFrame(rows, SCHEMA), **k).collect()


def rows():
    rng = random.Random(3)
    texts = ["a b", "ab", " a\tb ", "é x", "éx\r\n", "", None, "\x0b\x0c", "long one here", "hot"]
    out = [(i, rng.choice(texts + ["hot"] * 6)) for i in range(150)]
    return out + [(7, "hot"), (7, "hot"), (None, "only null"), (None, "hot"), (500, "z z"), (501, "zz")]


@pytest.mark.parametrize("counters", [2, 256])
def test_groups(spark, counters):
    data = rows()
    got = result(spark, data, counters=counters)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(data)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_dedup_keeps_columns_and_one_row(spark):
    data = [(d, t, i, "x") for i, (d, t) in enumerate(rows())]
    df = spark.createDataFrame(data, "doc_id long, text string, digest int, group_size string")
    kept = exact_dedup.dedup(df, counters=2)
    assert kept.columns == df.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    got = [norm(r.text) for r in kept.collect()]
    assert sorted(got) == sorted({norm(t) for _, t in rows()})


def test_empty_table(spark):
    assert result(spark, []) == []
    assert exact_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    t = "word " * 400_000
    got = result(spark, [(1, t), (2, t + "\n"), (3, "x")])
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(1, 2, False), (2, 2, True), (3, 3, True)}


def test_sketches_find_what_is_frequent():
    rng = random.Random(1)
    stream = [bytes([rng.choice([1, 1, 1, 2, 2, *range(3, 60)])]) for _ in range(5000)]
    counts = {}
    for d in stream:
        counts[d] = counts.get(d, 0) + 1
        counts = exact_dedup.shrink(counts, 10)
    assert len(counts) <= 10
    for d in (b"\x01", b"\x02"):
        true = stream.count(d)
        assert true - len(stream) / 11 <= counts.get(d, 0) <= true


def test_frequent_is_bounded_and_complete(spark):
    digests = spark.createDataFrame([(bytes([i % 7 if i % 2 else 100]),) for i in range(1000)] + [(i.to_bytes(4, "big"),) for i in range(500)], "digest binary").repartition(5)
    found = {bytes(r.digest) for r in exact_dedup.frequent(digests, 1500, 8).collect()}
    assert bytes([100]) in found and len(found) <= 8
