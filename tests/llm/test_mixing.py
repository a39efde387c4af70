import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from rowlens.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def period(weights):
    """Earliest deadline first over one period, in plain Python."""
    names, total = sorted(weights), sum(weights.values())
    served, out = Counter(), []
    for t in range(total):
        ready = [(math.ceil(Fraction((served[s] + 1) * total, weights[s])), s) for s in names if served[s] < weights[s] and served[s] * total // weights[s] <= t]
        s = min(ready)[1]
        served[s] += 1
        out.append(s)
    return out


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 6, "b": 3, "c": 3, "d": 2, **{f"s{i}": 1 for i in range(16)}}, {"a": 50, "b": 49, "c": 1}, {"x": 7, "y": 5, "z": 3}])
def test_schedule(spark, weights):
    got = mixing.schedule(spark.createDataFrame([(s, w) for s, w in weights.items()], "source string, weight long")).orderBy("place").collect()
    assert [r.source for r in got] == period(weights)
    total, served = sum(weights.values()), Counter()
    for r in got:
        assert (r.nth, r.weight, r.period) == (served[r.source], weights[r.source], total)
        served[r.source] += 1
        for s, w in weights.items():
            assert abs(served[s] - Fraction(w * (r.place + 1), total)) < 1


def rows(seed=2):
    rng = random.Random(seed)
    out = [(i, "x" * rng.choice([0, 5, 40, 300]), rng.choice(["hot", "hot", "hot", "b", "c", None])) for i in range(400)]
    return out + [(500, None, "b"), (None, "nulls", "c"), (3, "again", "hot"), (3, "again", "hot"), (600, "y" * 5000, "long")]


def brute(data, weights, block):
    key = lambda d: hashlib.md5(f"0:{'null' if d is None else d}".encode()).hexdigest()
    out = []
    order = period({s: weights.get(s, 1) for s in {r[2] or "" for r in data}})
    place = {s: [i for i, x in enumerate(order) if x == s] for s in set(order)}
    for s in place:
        at = 0
        for d, t, _ in sorted((r for r in data if (r[2] or "") == s), key=lambda r: (key(r[0]), len(r[1] or ""))):
            b = at // block
            out.append((d, s, len(t or ""), at, b, b // len(place[s]) * len(order) + place[s][b % len(place[s])]))
            at += len(t or "")
    return out


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 20)
    data, weights = rows(), {"hot": 3, "b": 2}
    got = mixing.mix(spark.createDataFrame(data, SCHEMA), weights, block_chars=100).collect()
    mine = sorted(((r.doc_id, r.source, r.amount, r.start, r.block, r.slot) for r in got), key=str)
    assert mine == sorted(brute(data, weights, 100), key=str)


def test_no_source_is_off_its_weight_by_a_block(spark):
    data, weights, block = rows(5), {"hot": 3, "b": 2}, 50
    got = mixing.mix(spark.createDataFrame(data, SCHEMA), weights, block_chars=block).collect()
    names = sorted({r.source for r in got})
    total = sum(weights.get(s, 1) for s in names)
    last = {s: max(r.block for r in got if r.source == s) for s in names}
    for slot in range(max(r.slot for r in got) + 1):
        for s in names:
            blocks = len({r.block for r in got if r.source == s and r.slot <= slot})
            skipped = last[s] + 1 - len({r.block for r in got if r.source == s})
            due = Fraction(weights.get(s, 1) * (slot + 1), total)
            if due < last[s]:
                assert -1 - skipped < blocks - due < 1


def test_keep_returns_the_columns_in_order(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows())], "doc_id long, text string, source string, slot int")
    kept = mixing.mix(df, {"hot": 3}, block_chars=100, keep=True)
    assert kept.columns == df.columns
    assert sorted(kept.collect(), key=str) == sorted(df.collect(), key=str)
    at = {(r.doc_id, r.amount): (r.slot, r.start) for r in mixing.mix(df, {"hot": 3}, block_chars=100).collect()}
    found = [at[r.doc_id, len(r.text or "")] for r in kept.collect() if r.doc_id != 3]
    assert found == sorted(found)


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows(), SCHEMA), {"a": 0})


def test_the_plan_is_native(spark):
    plan = mixing.mix(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
