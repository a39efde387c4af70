import random
import re
from collections import Counter

import numpy as np
import pytest

from rowlens.llm import jaccard_join

SCHEMA = "doc_id long, text string"


def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    """doc_id, least doc_id of its component, number of links; by comparing all pairs."""
    sets, n = [grams(t) for _, t in rows], len(rows)
    top, links = list(range(n)), [0] * n

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    names = {}
    for i, (d, _) in enumerate(rows):
        names.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in names.items()}
    return sorted(((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


def rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]
    out = []
    for i in range(120):
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((i, " ".join(t)))
    return out + [(200, None), (201, ""), (202, "a b"), (203, "A  b!"), (204, "!!"), (5, out[5][1]), (5, "zz yy"), (None, "a b")]


@pytest.mark.parametrize("block", [1024, 8])
def test_groups(spark, block):
    data = rows()
    got = jaccard_join.groups(spark.createDataFrame(data, SCHEMA), block=block).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(data)


def test_dedup_keeps_one_of_each_group(spark):
    data = rows()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "doc_id long, text string, class int")
    kept = jaccard_join.dedup(df)
    assert kept.columns == df.columns
    groups = {(c, d if d != 5 else (d, "zz" in (t or ""))) for (d, t), c in zip(data, [0] * len(data))}
    assert groups
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    assert Counter(ids) == Counter([c for c in {c for _, c, _ in brute(data)}] + [5])  # 5 names two groups


def test_empty(spark):
    assert jaccard_join.groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bands_reach_the_recall():
    n = jaccard_join.bands(0.8, 0.9999, 6)
    assert 1 - (1 - 0.8**6) ** n >= 0.9999 > 1 - (1 - 0.8**6) ** (n - 1)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    a, b = jaccard_join._coefficients(512)
    same = (jaccard_join.sketch(x[:2500], a, b) == jaccard_join.sketch(x[500:], a, b)).mean()
    assert abs(same - 2000 / 3000) < 0.08


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000)).astype(np.uint64)) for _ in range(7)]
    got = jaccard_join._overlaps(sets)
    for i in range(7):
        for j in range(7):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
    assert np.array_equal(jaccard_join._overlaps(sets[:3], sets[3:]), got[:3, 3:])


@pytest.mark.parametrize(("block", "grams"), [(1024, 1 << 21), (6, 1 << 21), (1024, 300)])
def test_sizes_that_differ(spark, block, grams, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_GRAMS", grams)
    monkeypatch.setattr(jaccard_join, "TILE", 5)
    words = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(words[: 20 + 7 * i])) for i in range(40)] + [(100 + i, " ".join(words[i:])) for i in range(0, 200, 9)]
    got = jaccard_join.groups(spark.createDataFrame(data, SCHEMA), block=block).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(data)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    got = {r.node: r.least for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    assert got == {n: root(n) for n in top if n != root(n)}  # the least is not named
