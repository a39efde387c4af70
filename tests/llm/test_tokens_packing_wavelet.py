import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rowlens.llm import packing, wavelet
from rowlens.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", " ", "a", " a", "a ", "\n", "a  b", "a\n b", "a \nb", "a\tb c", "a\n\nb", "<|endoftext|> x <|endoftext|>", "hello <|endoftext|> world", "a<|startoftext|>b <|endoftext|>", "<|endo ftext|>", "DON'T J̌ ΑΣ ≠", "a\x00 \x00", "it's 's é́ ́", "  x", "x\x1fy z", "日本語 テスト 12345",
    "w" * 300 + " x", "A.B, c!! don't x y", "　 x", "ǅ İ ſ ﬁ", "😀 👩‍👩‍👧 x", "the quick brown fox " * 400, "x\r\ny", "\x85 a\x85 b", "a  b",
]


def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(path, texts):
    t = tokenizer(path)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for x in texts]


@pytest.mark.parametrize(("path", "spaces"), [(BYTE, True), (WORD, False)])
def test_ids_equal_the_librarys(path, spaces, monkeypatch):
    rng = random.Random(4)
    alphabet = ["the", "Don't", "é", " ", " ", "\n", "  ", "\t", "12", "x.", " ", "'s", "ß", "\x1f", "漢", "-"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    expected = [x[:-1] for x in ids_of(path, texts)]
    encoder = Encoder(path, spaces)
    for most in (1_000_000, 50):
        monkeypatch.setattr("rowlens.llm.tokens.MOST_CHUNKS", most)
        monkeypatch.setattr("rowlens.llm.tokens.MOST_BYTES", 3000)
        got = list(encoder.encode(pa.array(texts)))
        assert all(np.array_equal(a, b) for a, b in zip(got, expected, strict=True))


def test_plans_use_each_length_as_counted():
    rng = random.Random(9)
    for _ in range(300):
        capacity = rng.choice([10, 24, 64])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        found, used = packing.plan(counts, capacity), Counter()
        for pattern, n in found:
            assert n > 0 and sum(pattern) <= capacity
            for s in pattern:
                used[s] += n
        assert dict(used) == counts
        assert sum(n for _, n in found) >= math.ceil(sum(s * n for s, n in counts.items()) / capacity)
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def least(items, capacity):
    """The fewest sequences, by trying all."""
    best = len(items)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= rest[0] and rooms[i] not in rooms[:i]:
                go(rest[1:], rooms[:i] + [rooms[i] - rest[0]] + rooms[i + 1 :])
        go(rest[1:], rooms + [capacity - rest[0]])

    go(sorted(items, reverse=True), [])
    return best


def test_the_reduction_costs_no_sequence():
    rng = random.Random(12)
    for _ in range(150):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        fixed, left = packing.reduce_counts(Counter(items), 20)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (least(rest, 20) if rest else 0) == least(items, 20)


def test_best_fit_by_counts_is_best_fit_by_item():
    def single(items, capacity):
        rooms = []
        for s in sorted(items, reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
            else:
                rooms.append(capacity - s)
        return sorted(rooms)

    rng = random.Random(13)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        found = packing.best_fit(Counter(items), 30)
        assert sorted(r for p, n in found for r in [30 - sum(p)] * n) == single(items, 30)


def test_pack(spark):
    texts = TEXTS + ["the quick brown fox jumps " * k for k in range(1, 500, 7)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (5, "same"), (5, "same")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BYTE, capacity=256).toPandas()
    ids = dict(zip(range(len(texts)), ids_of(BYTE, texts)))
    for d, g in got[got.doc_id.isin(set(ids) - {5})].groupby("doc_id"):
        g = g.sort_values("piece")
        own = ids[int(d)]
        assert list(g.piece) == list(range(len(g))) and g.length.sum() == len(own)
        assert list(g.start) == list(np.cumsum(g.length) - g.length)
        assert all(n == 256 for n in g.length[1:]) and (len(g) == 1 or len(own) > 256)
        assert [zlib.crc32(own[a : a + n].tobytes()) for a, n in zip(g.start, g.length)] == list(g.ids_crc32)
    assert len(got) == sum(max(1, math.ceil(len(x) / 256)) for x in ids_of(BYTE, [t for _, t in rows]))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 256
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0


def test_a_lookup_inflates_few_blocks():
    x = np.random.default_rng(3).integers(0, 1000, 300_000)
    blob = wavelet.encode(x, np.array([1]), np.array([len(x)]))
    w = wavelet.WaveletMatrix(blob)
    assert w.access(123_456) == x[123_456] and len(w._known) <= w.bits
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(blob[:-1])


@pytest.mark.parametrize(("n", "symbols"), [(0, 5), (1, 1), (700, 3), (1500, 300), (3000, 70_000)])
def test_wavelet_matrix(n, symbols):
    x = np.random.default_rng(n).integers(0, symbols, n)
    w = wavelet.WaveletMatrix(wavelet.encode(x, np.array([7, 8]), np.array([n, 0])))
    assert np.array_equal(w.decode(), x)
    assert list(w.doc_ids) == [7, 8] and list(w.lengths) == [n, 0]
    for i in range(0, n, 41):
        s = int(x[i])
        assert w.access(i) == s and w.rank(s, i) == (x[:i] == s).sum() and w.count(s) == (x == s).sum()
        assert w.occurrences(s) == list(np.flatnonzero(x == s))
    assert w.count(1 << 20) == 0
    at = np.unique(np.concatenate([np.random.default_rng(1).integers(0, n + 1, 40), [0, n]]))
    for s in (0, 1, symbols - 1, 1 << 20):
        assert w.ranks_at(s, at).tolist() == [int((x[:i] == s).sum()) for i in at]
    with pytest.raises(IndexError):
        w.access(n)
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"nope" + bytes(40))


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_round_trip(spark, tmp_path, most):
    rows = [(900 - 3 * i, t) for i, t in enumerate(TEXTS)] + [(None, "first"), (12, "same"), (12, "same"), (-5, "negative")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wavelet.write(df, str(tmp_path / "w"), WORD, False, most=most)
    got = wavelet.read(spark, str(tmp_path / "w")).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = ids_of(WORD, [t for _, t in order])
    assert [r.doc_id for r in got] == [d for d, _ in order]
    assert [(r.n_tokens, r.ids_crc32) for r in got if r.doc_id != 12] == [(len(x), zlib.crc32(x.tobytes())) for x, (d, _) in zip(ids, order) if d != 12]
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)]))[:-1]
    assert sum(r.n_end for r in got) == sum(int((x == 2).sum()) for x in ids)
    one = Counter(i for x in ids for i in x.tolist() if i != 2).most_common(1)[0][0]
    want = Counter((d, i) for x, (d, _) in zip(ids, order) for i in np.flatnonzero(x == one).tolist())
    assert Counter((r.doc_id, r.place) for r in wavelet.occurrences(spark, str(tmp_path / "w"), [one]).collect()) == want
    assert {r.symbol: r.n for r in wavelet.count(spark, str(tmp_path / "w"), [one, 2]).collect()} == {one: sum(want.values()), 2: sum(r.n_end for r in got)}


def test_round_trip_of_nothing(spark):
    assert wavelet.round_trip(spark.createDataFrame([], "doc_id long, text string"), WORD, False).count() == 0
