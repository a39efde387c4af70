import pytest
from pyspark.sql import functions as F

from rowlens.model import RID, Dialect, Direction, FilterSpec, Inferred, InvalidPattern, RowRange, SortKey, SourceError, ViewSpec
from rowlens.operators.layout import RowSpan
from rowlens.operators.view import TableView, open_view
from rowlens.sources import readers

BARE = Dialect(",", '"', False)


def opened(spark, tmp_path, raw, dialect=None, name="t.csv", **options):
    path = tmp_path / name
    path.write_bytes(raw if isinstance(raw, bytes) else raw.encode())
    return open_view(spark, str(path), dialect=dialect, **options)


def cells(view, start=0, n=100, columns=None):
    return view.fetch(RowRange(start, n), columns).rows


def test_exact_cells_and_projection(spark, tmp_path):
    v = opened(spark, tmp_path, "1,2\nx,y\n", BARE)
    assert cells(v) == [["1", "2"], ["x", "y"]]
    assert v.source.schema.names() == ["col0", "col1"]
    assert cells(v, columns=[1, 0, 1, 9]) == [["2", "1", "2", ""], ["y", "x", "y", ""]]


def test_quoted_newlines_quotes_and_spaces(spark, tmp_path):
    v = opened(spark, tmp_path, 'a,b\n"x\ny", z \n"say ""hi""",\n#c,"1,2"\n')
    assert cells(v) == [["x\ny", " z "], ['say "hi"', ""], ["#c", "1,2"]]


def test_header_types_and_count(spark, tmp_path):
    v = opened(spark, tmp_path, "river,km,w,ok,e,m\nElbe,1094,1.5,true,,1\nOder, 840 ,2,FALSE,,x\n")
    assert [c.inferred for c in v.source.schema.columns] == [Inferred.TEXT, Inferred.INTEGER, Inferred.FLOAT, Inferred.BOOLEAN, Inferred.TEXT, Inferred.TEXT]
    assert v.count() == 2 and v.row_count().exact


def test_duplicate_and_empty_names(spark, tmp_path):
    v = opened(spark, tmp_path, "a,a,\n1,2,3\n", Dialect())
    assert v.source.schema.names() == ["a", "a", ""] and cells(v) == [["1", "2", "3"]]


def test_ragged_records(spark, tmp_path):
    v = opened(spark, tmp_path, 'a,b\n1\n\n2,3,"ex ""tra"",q",last\n4,5\n')
    assert cells(v) == [["1", ""], ["2", "3"], ["4", "5"]]
    assert v.data_quality().ragged_rows == 2
    assert cells(v.filtered('"tra",Q')) == [["2", "3"]]
    assert cells(v.filtered("last")) == [["2", "3"]]
    assert cells(v.filtered("q,last")) == []
    assert cells(v.filtered("^last$", regex=True, invert=True)) == [["1", ""], ["4", "5"]]


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be"])
def test_utf16(spark, tmp_path, encoding):
    v = opened(spark, tmp_path, "﻿1,é\n2,b\n".encode(encoding), BARE)
    assert cells(v) == [["1", "é"], ["2", "b"]]


def test_byte_order_mark(spark, tmp_path):
    v = opened(spark, tmp_path, "﻿id,x\n1,2\n")
    assert v.source.schema.names()[0].lstrip("﻿") == "id" and cells(v) == [["1", "2"]]
    v = opened(spark, tmp_path, "﻿1,2\n", BARE, name="b.csv")
    assert cells(v) == [["1", "2"]]


def test_exact_bytes(spark, tmp_path):
    raw = b"a,b\n\x93hi\x94,\xe9\n"
    v = opened(spark, tmp_path, raw, Dialect(), encoding="latin-1")
    got = v.source.data.select(F.encode("c0", "ISO-8859-1"), F.encode("c1", "ISO-8859-1")).first()
    assert [bytes(x) for x in got] == [b"\x93hi\x94", b"\xe9"]


def test_empty_file(spark, tmp_path):
    v = opened(spark, tmp_path, b"")
    assert (len(v.source.schema), v.count(), cells(v)) == (0, 0, [])


def test_missing_file(spark, tmp_path):
    with pytest.raises(SourceError):
        open_view(spark, str(tmp_path / "none.parquet"))


def test_in_memory(spark):
    v = TableView(readers.from_bytes(spark, b"h,k\nb,2\na\nc,1,9\n"))
    assert cells(v) == [["b", "2"], ["a", ""], ["c", "1"]]
    assert v.data_quality().ragged_rows == 2
    assert cells(v.filtered("9")) == [["c", "1"]]


def test_windows(spark, tmp_path):
    v = opened(spark, tmp_path, "n\n" + "".join(f"{i}\n" for i in range(3000)))
    assert cells(v, 1500, 3) == [["1500"], ["1501"], ["1502"]]
    assert cells(v, 2999, 10) == [["2999"]]
    assert v.fetch_rows([2, 0, 2, 9999]).rows == [["2"], ["0"], ["2"], [""]]
    down = v.sorted(SortKey(0, Direction.DESCENDING))
    assert cells(down, 0, 2) == [["2999"], ["2998"]] and cells(down, 2999, 5) == [["0"]]
    assert [len(b) for b in v.batches(1024)] == [1024, 1024, 952]


def test_deep_windows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rowlens.operators.view.SHALLOW", 10)
    v = opened(spark, tmp_path, "n,k\n" + "".join(f"{i},{i % 7}\n" for i in range(500))).sorted(SortKey(1))
    expected = sorted(range(500), key=lambda i: (i % 7, i))
    assert [int(r[0]) for r in cells(v, 200, 50)] == expected[200:250]


def test_parallel_reading_keeps_ordinals(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        v = opened(spark, tmp_path, "n,t\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(3000)))
        assert v.source.data.rdd.getNumPartitions() > 3
        assert v.source.data.filter(F.col(RID) != F.col("c0").cast("long")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_filters(spark, tmp_path):
    v = opened(spark, tmp_path, "name\nApple\nbanana\nCHERRY\n")
    assert cells(v.filtered("AN")) == [["banana"]]
    assert cells(v.filtered("AN", case_sensitive=True)) == []
    assert cells(v.filtered("an", invert=True)) == [["Apple"], ["CHERRY"]]
    assert cells(v.filtered("^[ab]", regex=True)) == [["Apple"], ["banana"]]
    assert cells(v.filtered(".", regex=False)) == []
    assert cells(v.filtered("e").cleared()) == [["Apple"], ["banana"], ["CHERRY"]]
    with pytest.raises(InvalidPattern):
        v.filtered("(", regex=True)
    assert v.filtered("a").cleared().spec == ViewSpec()


def test_a_literal_does_not_match_across_fields(spark, tmp_path):
    v = opened(spark, tmp_path, "a,b\nxy,zw\n")
    assert cells(v.filtered("yz")) == [] and cells(v.filtered("y\x1ez")) == [] and cells(v.filtered("ZW")) == [["xy", "zw"]]


def test_filter_then_sort(spark, tmp_path):
    v = opened(spark, tmp_path, "n,t\n10,a\n9,b\n2,a\n33,a\n")
    v = v.with_spec(ViewSpec(FilterSpec("a"), SortKey(0, Direction.DESCENDING)))
    assert cells(v) == [["33", "a"], ["10", "a"], ["2", "a"]]
    assert v.fetch_source(RowRange(0, 2)).rows == [["10", "a"], ["9", "b"]]


def test_find(spark, tmp_path):
    v = opened(spark, tmp_path, "name,val\nalpha,1\nbeta,2\nalpha,3\ngamma,4\nalpha,5\n")
    find = lambda first, forward: v.find(FilterSpec("ALPHA"), [0, 1], first, forward)
    assert [find(i, True) for i in (0, 1, 3, 5)] == [0, 2, 4, None]
    assert [find(i, False) for i in (4, 3, 1)] == [4, 2, 0]
    assert v.find(FilterSpec("zzz"), [0, 1], 0) is None and v.find(FilterSpec("zzz"), [0, 1], 4, False) is None
    assert v.find(FilterSpec("2"), [0], 0) is None  # a column that isn't shown
    assert v.find(FilterSpec("alpha"), [0], 9, False) is None
    down = v.sorted(SortKey(1, Direction.DESCENDING))
    assert [down.find(FilterSpec("beta"), [0], 0), down.find(FilterSpec("gamma"), [0], 4, False)] == [3, 1]


def test_highlights(spark, tmp_path):
    v = opened(spark, tmp_path, "a,b\nx1,y\nz,1\n")
    assert [tuple(r) for r in v.highlights(FilterSpec("1", invert=True)).orderBy(RID).collect()] == [(0, True, False), (1, False, True)]


def test_copy(spark, tmp_path):
    v = opened(spark, tmp_path, 'a,b\n"x,1",y\nz,w\n')
    assert v.copy_text(RowRange(0, 5)) == "x,1\ty\nz\tw"
    assert v.copy_text(RowRange(1, 1), [1]) == "w"
    assert (v.copy_cell(0, 0), v.copy_cell(9, 0), v.copy_row(1)) == ("x,1", "", "z\tw")
    assert v.copy_selection(RowSpan(1, 0), [1]) == "y\nw"


def test_sql_view(spark, tmp_path):
    opened(spark, tmp_path, "a,b,b\n1,2,3\n").create_view("rowlens_t")
    assert spark.table("rowlens_t").columns == ["a", "c1", "c2"]


def test_reopening_keeps_the_view(spark, tmp_path):
    v = opened(spark, tmp_path, "a;b\n2;x\n1;x\n3;y\n", Dialect(","))
    assert len(v.source.schema) == 1
    v = v.filtered("x").reopened(Dialect(";"))
    assert cells(v) == [["2", "x"], ["1", "x"]]
    v = v.sorted(SortKey(1)).reopened(Dialect(","))
    assert v.spec == ViewSpec(FilterSpec("x")) and len(v.source.schema) == 1
