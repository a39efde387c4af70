"""Delimited records whatever the size of the file, and the index that is kept: against a reading in one piece."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from rowlens.model import RID, Dialect, FilterSpec, RowRange
from rowlens.operators.view import open_view
from rowlens.sources import records
from rowlens.sources.records import Rule

PLAIN, BARE = Dialect(), Dialect(",", '"', False)


@pytest.fixture(params=[False, True], ids=["one split", "many splits"])
def spark_(spark, request, tmp_path):
    """The session, with files cut every few bytes or not at all, and an index folder of its own."""
    conf = {"spark.rowlens.index.dir": f"file://{tmp_path}/index"}
    if request.param:
        conf |= {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def reference(raw: str, sep=",", quote='"'):
    """Records as lists of raw fields, character by character."""
    out, fields, field, state = [], [], "", "start"
    for c in raw:
        if state in ("start", "plain", "closed") and c in "\r\n":
            if state != "start" or fields:
                out.append([*fields, field])
            fields, field, state = [], "", "start"
        elif state in ("start", "plain", "closed") and c == sep:
            fields, field, state = [*fields, field], "", "start"
        elif state == "start" and c == quote:
            field, state = field + c, "quoted"
        elif state == "quoted":
            field += c
            if c == quote:
                state = "quote"
        elif state == "quote":
            if c == quote:
                field, state = field + c, "quoted"
            else:
                state = "closed"
                if c in "\r\n":
                    out.append([*fields, field])
                    fields, field, state = [], "", "start"
                elif c == sep:
                    fields, field, state = [*fields, field], "", "start"
                else:
                    field += c
        else:
            field, state = field + c, "plain" if state == "start" else state
    if fields or state != "start":  # the line end that ends the file belongs to no record, even to an open one
        out.append([*fields, field.removesuffix("\n").rstrip("\r") if state == "quoted" else field])
    return out


def write(tmp_path, raw, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(raw if isinstance(raw, bytes) else raw.encode())
    return str(path)


def texts(spark, path, width, header=False):
    found = records.read_records(spark, path, "UTF-8", Rule(",", '"', width), header)
    rows = sorted((r[RID], r["value"]) for r in found.data.collect())
    assert [n for n, _ in rows] == list(range(len(rows)))
    return [t for _, t in rows], found


CASES = [
    "a,b\n1,2\n",
    "a,b\n,\n3,4\n",
    "a\n \n1\n\n2",
    "a,b\r\n1,2\r\n\r\n3,4",
    'a,b\n"x\ry",2\n1,2\n',
    "a,b\n1,2\r3,4\r\r5,6\n",
    "a,b\n1\n1,2,3\n4,5\n",
    'a,b\n"x\n\ny",1\n5" pipe,2\n"say ""hi""\n",3\n',
    'a,b\n1,"open\nto the end,\n2,3\n',
    '"a\nb",c\n' * 30,
    'x,"\n"\n' * 40 + "y,z\n",
    "\n\n",
]


@pytest.mark.parametrize("raw", CASES)
def test_records(spark_, tmp_path, raw):
    path = write(tmp_path, raw)
    want = [",".join(r) for r in reference(raw)]
    assert texts(spark_, path, 2)[0] == want
    assert texts(spark_, path, 2, header=True)[0] == want[1:]


def test_random_records(spark_, tmp_path):
    rng = random.Random(3)
    for i in range(6):
        raw = "".join(rng.choice(["a", "b", ",", ",", '"', '"', "\n", "\n", "\r", "\r\n", '""', " ", "é"]) for _ in range(300))
        path = write(tmp_path, raw, f"{i}.csv")
        assert texts(spark_, path, 2)[0] == [",".join(r) for r in reference(raw)], raw


def test_ragged_blank_and_windows(spark_, tmp_path):
    rows = [f"{i},x" if i % 7 else f"{i}" if i % 2 else f"{i},x,y" for i in range(200)] + [",", " , "]
    v = open_view(spark_, write(tmp_path, "n,t\n" + "\n".join(rows) + "\n"), dialect=PLAIN)
    assert v.data_quality().ragged_rows == sum(r.count(",") != 1 for r in rows)
    assert v.count() == v.rows().count() == len(rows)
    assert v.fetch(RowRange(195, 20)).rows[-2:] == [["", ""], [" ", " "]]
    assert [r[0] for r in v.fetch(RowRange(50, 30)).rows] == [str(i) for i in range(50, 80)]
    assert v.filtered("x").count() == sum("x" in r for r in rows)
    assert v.source.data.filter(v.source.ragged()).count() == v.data_quality().ragged_rows


def test_many_files(spark_, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(3):
        write(tmp_path / "d", f"n,t\n{i}0,a\n{i}1,b\n", f"{i}.csv")
    v = open_view(spark_, str(tmp_path / "d"), dialect=PLAIN)
    assert [r[0] for r in v.fetch(RowRange(0, 9)).rows] == ["00", "01", "10", "11", "20", "21"]


def test_the_index_is_kept_and_outlived_by_changes(spark_, tmp_path, monkeypatch):
    made = []
    count = records._count
    monkeypatch.setattr(records, "_count", lambda *a: made.append(a[1:]) or count(*a))
    path = write(tmp_path, "a,b\n" + "".join(f"{i},x\n" for i in range(100)))
    for _ in range(3):
        assert open_view(spark_, path, dialect=PLAIN).count() == 100
    assert len(made) == 1 and records.index_bytes(spark_) > 0
    open_view(spark_, path, dialect=Dialect(";"))
    assert len(made) == 2
    time.sleep(0.01)
    with open(path, "a") as f:
        f.write("100,y\n")
    os.utime(path)
    v = open_view(spark_, path, dialect=PLAIN)
    assert len(made) == 3 and v.count() == 101 and v.fetch(RowRange(99, 5)).rows == [["99", "x"], ["100", "y"]]
    records.clear_index(spark_)
    assert records.index_bytes(spark_) == 0 and open_view(spark_, path, dialect=PLAIN).count() == 101


def test_a_window_reads_its_bytes_only(spark_, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "ANCHOR", 16)
    v = open_view(spark_, write(tmp_path, "﻿a,b\n" + "".join(f"{i},é{i}\r\n" for i in range(500))), dialect=PLAIN)
    assert v.source.records.window(400, 420) is not None
    monkeypatch.setattr(v.source.data, "filter", None, raising=False)  # the source itself isn't read
    for at in (0, 1, 15, 16, 17, 250, 490, 499, 500, 600):
        assert v.fetch(RowRange(at, 20)).rows == [[str(i), f"é{i}"] for i in range(at, min(500, at + 20))]


def test_json_lines(spark_, tmp_path):
    path = write(tmp_path, "﻿" + "".join(f'{{"n":{i}}}\n' + ("\n" if i % 3 else " \t\r\n") for i in range(60)), "t.ndjson")
    v = open_view(spark_, path)
    assert [r[0] for r in v.fetch(RowRange(0, 100)).rows] == [str(i) for i in range(60)]
    assert v.count() == 60 and v.fetch(RowRange(58, 9)).rows == [["58"], ["59"]]
    assert sorted(r[0] for r in v.source.data.select(F.col(RID)).collect()) == list(range(60))
    assert v.filtered("^5$", regex=True).fetch(RowRange(0, 3)).rows == [["5"]] and v.find(FilterSpec("59"), [0], 0) == 59
