"""Sorting against a plain model of the comparator."""

import functools
import math
import random

import pytest

from rowlens.functions.text import looks_numeric
from rowlens.model import RID, Direction, SortKey
from rowlens.operators.view import TableView
from rowlens.sources.readers import Source
from rowlens.model import ColumnInfo, Format, TableSchema


def compare(a: str, b: str) -> int:
    """Exact integers, else numbers, else code points; empty cells first, numbers before text."""
    kind = lambda s: 0 if s == "" else 1 if looks_numeric(s) else 2
    if kind(a) != kind(b):
        return kind(a) - kind(b)
    if kind(a) == 1:
        try:
            x, y = int(a), int(b)
        except ValueError:
            x, y = float(a), float(b)
            if math.isnan(x) or math.isnan(y):
                return math.isnan(x) - math.isnan(y)
        return (x > y) - (x < y)
    x, y = a.encode(), b.encode()
    return (x > y) - (x < y)


def view(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), f"{RID} long, c0 string").repartition(4)
    return TableView(Source("", Format.DELIMITED, df, TableSchema((ColumnInfo(0, "a"),))))


R = random.Random(5)
CASES = {
    "ints": [str(R.randint(-50, 50)) for _ in range(300)],
    "padded": [R.choice(["", " ", "\t"]) + str(R.randint(0, 20)) + R.choice(["", " "]) for _ in range(300)],
    "large": [str(R.choice([1, -1]) * (2**53 + R.randint(0, 5))) for _ in range(300)] + ["9" * 30, "1" * 30],
    "floats": [R.choice(["1.5", "-2", ".5", "1e1", "10", "inf", "-inf", "-0.0", "0", "+3", "1.", "2.25"]) for _ in range(300)],
    "nan": [R.choice(["nan", "NaN", "1", "inf", "-5", "+nan"]) for _ in range(100)],
    "text": ["".join(R.choice("abé漢Z z😀") for _ in range(R.randint(1, 5))) for _ in range(300)],
    "empties and numbers": [R.choice(["", "3", "20", "-1"]) for _ in range(200)],
    "mixed": [R.choice(["", "3", "20", "1a", "9", "10", "x", " ", "1e400", "-"]) for _ in range(300)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("down", [False, True])
def test_order(spark, name, down):
    values = CASES[name]
    sign = -1 if down else 1
    expected = sorted(range(len(values)), key=functools.cmp_to_key(lambda i, j: sign * compare(values[i], values[j]) or i - j))
    v = view(spark, values).sorted(SortKey(0, Direction.DESCENDING if down else Direction.ASCENDING))
    assert [r[0] for r in v.ordered().collect()] == expected
    at = v.numbered()
    assert [r[0] for r in at.orderBy("view_pos").select(RID).collect()] == expected
    assert sorted(r[0] for r in at.select("view_pos").collect()) == list(range(len(values)))


@pytest.mark.parametrize("kind", ["int", "double", "timestamp", "date", "boolean"])
def test_typed_columns_sort_as_their_text(spark, kind):
    from pyspark.sql import functions as F

    base = spark.range(200).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(41)))
    made = {"int": F.col("h") - 20, "double": (F.col("h") - 20) / 8, "timestamp": F.timestamp_seconds(F.col("h") * 100_000), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("h").cast("int")), "boolean": F.col("h") % 2 == 0}[kind]
    df = base.select(F.col("id").alias(RID), F.when(F.col("h") != 7, made).cast(kind).alias("c0"))
    typed = TableView(Source("", Format.PARQUET, df, TableSchema((ColumnInfo(0, "a"),))))
    text = TableView(Source("", Format.PARQUET, df.select(RID, typed.source.cell(0).alias("c0")), TableSchema((ColumnInfo(0, "a"),))))
    for d in Direction:
        a, b = ([r[0] for r in v.sorted(SortKey(0, d)).ordered().collect()] for v in (typed, text))
        assert a == b
