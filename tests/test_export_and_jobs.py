import json
import time

import pytest
from pyspark.sql import functions as F

from rowlens.model import Cancelled, Dialect, Direction, FilterSpec, RowRange, SortKey, ViewSpec
from rowlens.operators.export import ExportKind, Scope, export
from rowlens.operators.view import TableView, open_view
from rowlens.sources.readers import from_bytes
from rowlens.streaming.jobs import CancellationToken, Job, Slot

RAW = 'name,age,name,\n"Bob, ""B""",30,x,\n"li\nne",9,,q\nann,100,y, z \n'


@pytest.fixture
def view(spark):
    return TableView(from_bytes(spark, RAW.encode(), Dialect()))


def cells(v):
    return v.fetch(RowRange(0, 100)).rows


@pytest.mark.parametrize("kind", [ExportKind.CSV, ExportKind.TSV])
def test_csv_round_trip(spark, tmp_path, view, kind):
    path = str(tmp_path / f"out.{kind.value}")
    export(view, path, kind, single_file=True)
    back = open_view(spark, path, dialect=Dialect("," if kind is ExportKind.CSV else "\t"))
    assert cells(back) == cells(view) and back.source.schema.names() == ["name", "age", "name", ""]


def test_csv_bytes(spark, tmp_path, view):
    export(view, str(tmp_path / "o.csv"), ExportKind.CSV, single_file=True)
    assert (tmp_path / "o.csv").read_text() == RAW
    bare = TableView(from_bytes(spark, b"1\n\"\"\n2\n", Dialect(",", '"', False)))
    export(bare, str(tmp_path / "b.csv"), ExportKind.CSV, single_file=True)
    assert (tmp_path / "b.csv").read_text() == '1\n""\n2\n'


def test_export_of_a_view_in_all_formats(spark, tmp_path, view):
    v = view.with_spec(ViewSpec(FilterSpec("n"), SortKey(1, Direction.DESCENDING)))
    export(v, str(tmp_path / "o.csv"), ExportKind.CSV, columns=[1, 0], single_file=True)
    assert (tmp_path / "o.csv").read_text() == 'age,name\n100,ann\n9,"li\nne"\n'
    export(v, str(tmp_path / "o.ndjson"), ExportKind.NDJSON, columns=[3, 1, 0, 2], single_file=True)
    rows = (tmp_path / "o.ndjson").read_text().splitlines()
    assert [json.loads(r) for r in rows] == [{"col0": " z ", "age": "100", "name": "y"}, {"col0": "q", "age": "9", "name": ""}]
    assert list(json.loads(rows[0])) == ["col0", "age", "name"]
    export(v, str(tmp_path / "o.parquet"), ExportKind.PARQUET, columns=[0, 2, 1])
    back = spark.read.parquet(str(tmp_path / "o.parquet"))
    assert back.dtypes == [("name", "string"), ("name_2", "string"), ("age", "string")] and back.count() == 2
    export(v, str(tmp_path / "s.csv"), ExportKind.CSV, Scope.SOURCE, single_file=True)
    assert (tmp_path / "s.csv").read_text() == RAW


def test_folders_are_in_order(spark, tmp_path):
    v = TableView(from_bytes(spark, ("n\n" + "".join(f"{i}\n" for i in range(500))).encode())).sorted(SortKey(0, Direction.DESCENDING))
    export(v, str(tmp_path / "f.csv"), ExportKind.CSV)
    parts = sorted(p for p in (tmp_path / "f.csv").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts).split() == ["n", *map(str, range(499, -1, -1))]


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    df = from_bytes(spark, b"a\n1\n")
    broken = TableView(type(df)(df.path, df.format, df.data.withColumn("c0", F.raise_error(F.lit("no")).cast("string")), df.schema, df.dialect))
    with pytest.raises(Exception, match="no"):
        export(broken, str(tmp_path / "x.csv"), ExportKind.CSV)
    assert not [p for p in tmp_path.iterdir() if not p.name.endswith(".crc")]


def test_exports_replace_only_exports(spark, tmp_path, view):
    own, other = str(tmp_path / "e.csv"), tmp_path / "data"
    for kind in (ExportKind.CSV, ExportKind.NDJSON):
        export(view, own, kind)
    assert len(open_view(spark, own).fetch(RowRange(0, 9)).rows) == 3
    (other / "deep").mkdir(parents=True)
    (other / "deep" / "kept.txt").write_text("x")
    with pytest.raises(FileExistsError):
        export(view, str(other), ExportKind.CSV)
    source = tmp_path / "s.csv"
    source.write_text("a,b\n1,2\n")
    v = open_view(spark, str(source))
    for target in (source, tmp_path):
        with pytest.raises(FileExistsError):
            export(v, str(target), ExportKind.CSV, single_file=True)
    assert (other / "deep" / "kept.txt").read_text() == "x" and source.read_text() == "a,b\n1,2\n"
    export(v, str(tmp_path / "new.csv"), ExportKind.CSV, single_file=True)
    export(v.filtered("zzz"), str(tmp_path / "new.csv"), ExportKind.CSV, single_file=True)
    assert (tmp_path / "new.csv").read_text() == "a,b\n"
    assert not [p for p in tmp_path.iterdir() if p.name.endswith((".old", ".joined"))]


def test_tokens_are_shared():
    token = CancellationToken()
    other = token
    token.check()
    token.cancel()
    assert other.cancelled
    with pytest.raises(Cancelled):
        other.check()


def test_jobs(spark):
    job = Job(spark, lambda token: spark.range(10).count())
    assert job.result(60) == 10 and not job.building
    bad = Job(spark, lambda token: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bad.result(60)


def test_a_new_job_supersedes_the_old_one(spark):
    slot = Slot(spark)

    def slow(token):
        while not token.cancelled:
            time.sleep(0.02)
        return 1

    first = slot.submit(slow)
    assert slot.status().building
    second = slot.submit(lambda token: 2)
    with pytest.raises(Cancelled):
        first.result(60)
    assert second.result(60) == 2 and not slot.status().building
    slot.clear()
    assert not slot.status().building


def test_cancelling_stops_spark(spark):
    job = Job(spark, lambda token: spark.range(0, 1 << 40, 1, 4).filter("id % 7 = 9").count())
    time.sleep(1.5)
    assert job.building and job.progress().tasks >= 0
    job.cancel()
    with pytest.raises(Cancelled):
        job.result(60)
