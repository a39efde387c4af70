import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rowlens.llm import repeats
from rowlens.llm.rolling import Prefix, sliding_min

SCHEMA = "doc_id long, text string"


def brute(rows, depth):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + depth] for b in raw for i in range(len(b) - depth + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 2, int)
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i + 1 : i + depth + 1] = 1
        kept = np.frombuffer(b, np.uint8)[gone[1:-1] == 0].tobytes()
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **k):
    return sorted((tuple(r) for r in repeats.remove(spark.createDataFrame(rows, SCHEMA).repartition(3), **k).collect()), key=str)


def rows(seed):
    rng = random.Random(seed)
    words = ["ab", "cd", "eé", "f", "漢"]
    base = ["".join(rng.choice(words) for _ in range(rng.randint(0, 160))) for _ in range(15)]
    passage = "".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(60):
        t = rng.choice(base)
        if rng.random() < 0.7:
            j = rng.randint(0, len(t))
            t = t[:j] + rng.choice(["X", "", "YY", passage]) + t[j:] + rng.choice(base)[: rng.randint(0, 90)]
        out.append((i, t))
    return out + [(90, None), (91, ""), (92, "a" * 400), (92, "a" * 400), (93, "ab" * 200), (94, "q" * 59), (95, "z" * 61), (None, "x" * 70)]


@pytest.mark.parametrize(("seed", "large"), [(1, 256), (1, 2), (2, 3)])
def test_remove(spark, seed, large):
    data = rows(seed)
    assert result(spark, data, depth=60, head=24, large=large) == brute(data, 60)


def test_default_depth_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    rng = random.Random(6)
    part = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    fresh = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    data = [(1, fresh(900) + part + fresh(30)), (2, part[300:900] + fresh(700) + part[1500:1699]), (3, fresh(4000)), (4, part[1000:1200])]
    assert result(spark, data) == brute(data, 200)


def test_empty(spark):
    assert result(spark, []) == []
    with pytest.raises(ValueError):
        result(spark, [(1, "x")], depth=400, head=24)


def test_rolling_hashes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 500).astype(np.uint8)
    p, text = Prefix(data), data.tobytes()
    h = p.all(4)
    same = {}
    for i in range(len(h)):
        assert same.setdefault(text[i : i + 4], h[i]) == h[i]
    assert len(set(same.values())) == len(same)
    assert p.of(np.array([10]), np.array([14]))[0] == h[10]
    for w in (1, 2, 3, 8, 13, 137):
        assert np.array_equal(sliding_min(h, w), [h[i : i + w].min() for i in range(len(h) - w + 1)])
    assert len(sliding_min(h, 600)) == 0 and len(p.all(600)) == 0
