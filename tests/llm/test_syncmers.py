import hashlib
import random

import numpy as np

from rowlens.llm import syncmers
from rowlens.llm.rolling import Prefix

SCHEMA = "doc_id long, text string"


def whole(raw):
    return int(Prefix(np.frombuffer(raw, np.uint8)).of(np.array([0]), np.array([len(raw)]))[0])


def brute(raw):
    """Closed syncmers one by one, then the least of each bin."""
    k, s = syncmers.K, syncmers.S
    grams = [raw[i : i + k] for i in range(len(raw) - k + 1)]
    found = []
    for g in grams:
        inner = [whole(g[j : j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(whole(g))
    if raw and not found:
        found = [min(map(whole, grams))] if grams else [whole(raw)]
    out = [0] * syncmers.BINS
    for b in range(syncmers.BINS):
        own = [h % (1 << 40) for h in found if h >> 57 == b]
        if own:
            out[b] = min(own) % 65535 + 1
    return out


def test_fingerprints():
    rng = random.Random(2)
    texts = ["", "a", "é", "short text", "x" * 40, "abcd" * 30] + ["".join(rng.choice("abcde é") for _ in range(rng.randint(1, 300))) for _ in range(25)]
    raw = [t.encode() for t in texts]
    assert syncmers.fingerprints(raw).tolist() == [brute(r) for r in raw]


def test_chunks_do_not_matter(monkeypatch):
    raw = [(f"document {i} " * (i % 9)).encode() for i in range(60)]
    a = syncmers.fingerprints(raw)
    monkeypatch.setattr(syncmers, "CHUNK", 100)
    assert np.array_equal(a, syncmers.fingerprints(raw))


def test_likeness():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b = text(800), text(800)
    fa, fb, half, moved = syncmers.fingerprints([x.encode() for x in (a, b, a[: len(a) // 2] + b[: len(b) // 2], "zz " + a)])
    like = lambda x, y: float(syncmers.likeness(x[None], y[None])[0])
    assert like(fa, fa) == 1 and like(fa, fb) < 0.1 and 0.3 < like(fa, half) < 0.7 and like(fa, moved) > 0.95
    empty = syncmers.fingerprints([b""])[0]
    assert like(empty, empty) == 1 and like(empty, fa) == 0


def test_positions(spark):
    rng = random.Random(6)
    texts = ["", "é", "short"] + ["".join(rng.choice("abcde é") for _ in range(rng.randint(5, 200))) for _ in range(20)]
    got = {}
    for r in syncmers.anchors(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect():
        got.setdefault(r.doc_id, set()).add((r.at, r.hash % (1 << 64)))
    for i, t in enumerate(texts):
        raw, k, s = t.encode(), syncmers.K, syncmers.S
        want = set()
        for j in range(len(raw) - k + 1):
            inner = [whole(raw[j + m : j + m + s]) for m in range(k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                want.add((j, whole(raw[j : j + k])))
        if want or not raw:
            assert got.get(i, set()) == want
        else:
            assert len(got[i]) == 1


def test_stretches_are_found_by_position():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    a = " ".join(word() for _ in range(300)).encode()
    part, b = a[500:900], " ".join(word() for _ in range(3000)).encode()
    old, new = [a, a, a, b"", b"x"], [b[:9000] + part + b[9000:], a, b, b"", b"x"]
    own, other, same = syncmers._compared(old, new)
    assert 360 <= same[0] <= 400 and same[1] >= len(a) - 2 * syncmers.K and same[2] == 0 and same[3] == 0 and same[4] == 1
    assert np.array_equal(own, syncmers.fingerprints(old)) and np.array_equal(other, syncmers.fingerprints(new))


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in order]
    new = [syncmers.edited(t, u) for t, u in zip(texts, texts[1:] + texts[:1])]
    return [(d, len(t), hashlib.sha256(n.encode()).hexdigest()) for (d, _), t, n in zip(order, texts, new)]


def test_neighbours(spark):
    rng = random.Random(5)
    rows = [(3 * i, "".join(rng.choice("abé 漢") for _ in range(rng.randint(0, 90)))) for i in range(120)] + [(None, "first"), (1, None), (-7, "low")]
    got = syncmers.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(expected(rows), key=str)
    prints = {r.doc_id: r.fingerprint for r in got}
    for d, t in rows:
        assert prints[d] == syncmers.text_form(syncmers.fingerprints([(t or "").encode()])[0])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all(r.same_bytes <= len((t or "").encode()) for r, t in ((r, dict(rows)[r.doc_id]) for r in got))


def test_small_tables_and_repeated_rows(spark):
    make = lambda rows: syncmers.neighbours(spark.createDataFrame(rows, SCHEMA)).collect()
    assert make([]) == []
    (one,) = make([(1, "abcd")])
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    got = make([(1, "same text"), (1, "same text"), (2, "other")] * 3)
    assert len(got) == 9 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
