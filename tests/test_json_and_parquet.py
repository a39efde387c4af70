import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F

from rowlens.model import RID, Direction, Format, Inferred, RowRange, SortKey, SourceError
from rowlens.operators.view import TableView, column_stats, open_view
from rowlens.sources.arrays import element_groups
from rowlens.sources.readers import read_json_array, read_parquet
from rowlens.sources.records import numbered_anew


def opened(spark, tmp_path, text, name="t.json"):
    (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return open_view(spark, str(tmp_path / name))


def cells(v, n=100):
    return v.fetch(RowRange(0, n)).rows


def test_lines(spark, tmp_path):
    v = opened(spark, tmp_path, '{"name":"bob","age":30}\r\n \n{"age":41,"city":"x","name":null}\n')
    assert v.source.format is Format.JSON_LINES
    assert v.source.schema.names() == ["name", "age", "city"]
    assert [c.inferred for c in v.source.schema.columns] == [Inferred.TEXT, Inferred.INTEGER, Inferred.TEXT]
    assert cells(v) == [["bob", "30", ""], ["", "41", "x"]]


def test_nested_and_special_values(spark, tmp_path):
    v = opened(spark, tmp_path, '{"a":null,"b":[1, "x", null],"c":{"z":1, "a":[]},"d":true,"e":1.0,"f":"12","a\\"q":"é\\n"}\n')
    assert cells(v) == [["", '[1,"x",null]', '{"z":1,"a":[]}', "true", "1.0", "12", "é\n"]]
    assert [c.inferred for c in v.source.schema.columns][3:6] == [Inferred.BOOLEAN, Inferred.FLOAT, Inferred.TEXT]


def test_malformed_lines_keep_their_ordinal(spark, tmp_path):
    v = opened(spark, tmp_path, '{"a":1}\n{"a":2} junk\nnot json\n{"a":3}{"a":4}\n[1]\n{"a":5,"a":6}\n')
    assert cells(v) == [["1"], [""], [""], [""], [""], ["6"]]


def test_names_that_differ_in_case_or_have_dots(spark, tmp_path):
    v = opened(spark, tmp_path, '{"a":1,"A":2,"b.c":3,"":4}\n{"A":5,"a":6,"A":7}\n')
    assert cells(v) == [["1", "2", "3", "4"], ["6", "7", "", ""]]
    v = opened(spark, tmp_path, '{"b.c":3,"":4,"d`e":5}\n', name="b.json")
    assert cells(v) == [["3", "4", "5"]]


def test_keys_after_the_sample_are_no_columns(spark, tmp_path):
    v = opened(spark, tmp_path, "".join(f'{{"i":{i}}}\n' for i in range(200)) + '{"i":200,"late":1}\n')
    assert v.source.schema.names() == ["i"] and v.count() == 201
    assert v.fetch(RowRange(199, 5)).rows == [["199"], ["200"]]


def test_many_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        v = opened(spark, tmp_path, "".join(f'{{"i":{i},"p":"{"x" * (i % 40)}"}}\n' for i in range(3000)))
        assert v.source.data.filter(F.col(RID) != F.col("c0").cast("long")).count() == 0
        assert v.fetch(RowRange(2500, 1)).rows[0][0] == "2500"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_arrays(spark, tmp_path):
    v = opened(spark, tmp_path, ' [ {"s":"a],{b","n":2},\n {"s":"q\\"]","n":10} , {"n":1}]\n')
    assert v.source.format is Format.JSON_ARRAY
    assert cells(v) == [["a],{b", "2"], ['q"]', "10"], ["", "1"]]
    assert cells(v.sorted(SortKey(1))) == [["", "1"], ["a],{b", "2"], ['q"]', "10"]]
    assert cells(v.filtered("A]")) == [["a],{b", "2"]]


def test_array_of_scalars(spark, tmp_path):
    v = opened(spark, tmp_path, '[1, "two", [3], null]')
    assert v.source.schema.names() == ["value"]
    assert cells(v) == [["1"], ["two"], ["[3]"], [""]]


VALUES = [
    {"s": 'a],{b"\\', "n": [1, {"x": "}"}, []]}, 1, "two, [3]", None, [], [[4, "]"], {}], {"s": "\\", "n": 2}, {"u": "}\n,\t"}, -1.5, {"s": "", "n": {"s": "{[\""}}, {}, "\\\\"
]


@pytest.mark.parametrize(("end", "most"), [("}", "50"), (",", "50"), ("}", "1m"), (",", "1m"), ("]", "200"), ("\n", "200"), ('"', "200")])
def test_arrays_are_cut_anywhere(spark, tmp_path, end, most):
    values = VALUES * 3
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    try:
        for i, indent in enumerate((None, 1)):
            (tmp_path / f"{i}.json").write_text(" " + json.dumps(values, indent=indent) + ' junk ] [ {"a":1}')
        groups = element_groups(spark, str(tmp_path), end)
        assert not groups.filter(F.col("rows").isNull()).count()
        found = [json.loads(f"[{r['value']}]" if r["value"] and r["value"][0] in "[{" else json.dumps([r["value"]]))[0] for r in numbered_anew(groups).orderBy("_n").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    plain = [v if isinstance(v, (dict, list)) or v is None else v if isinstance(v, str) else json.dumps(v) for v in values]
    assert found == plain * 2


def test_elements_are_kept_until_the_file_changes(spark, tmp_path):
    v = opened(spark, tmp_path, '[{"a":1},{"a":2},{"a":3}]')
    assert v.count() == 3 and v.fetch(RowRange(1, 5)).rows == [["2"], ["3"]] and v.data_quality().ragged_rows == 0
    again = open_view(spark, str(tmp_path / "t.json"))
    assert again.source.records.data.inputFiles() == v.source.records.data.inputFiles()
    assert "PushedFilters: [IsNotNull" in again.window(RowRange(1, 1))._jdf.queryExecution().toString()
    assert cells(opened(spark, tmp_path, '[{"a":12}]')) == [["12"]]


@pytest.mark.parametrize("text", ['[{"a":1}', '[{"a":1}, {"a":', '{"a":1}]', '[{"a":1}}, {"a":2}]', '["a', "[1, 2", "x"])
def test_what_is_no_array(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(SourceError):
        read_json_array(spark, str(tmp_path / "t.json"))


def test_blank_files_and_stray_commas(spark, tmp_path):
    for text, rows in (("", []), (" \n", []), ("[ ]", []), ("[1,2,]", [["1"], ["2"]]), ('[{"a":1},]', [["1"]]), ("\ufeff[1]", [["1"]])):
        (tmp_path / "t.json").write_text(text)
        assert cells(TableView(read_json_array(spark, str(tmp_path / "t.json")))) == rows


def test_empty_and_malformed_arrays(spark, tmp_path):
    assert cells(opened(spark, tmp_path, "[]")) == []
    with pytest.raises(SourceError):
        opened(spark, tmp_path, "[1}]", name="b.json")


TYPED = "b boolean, i int, l long, f float, d double, m decimal(10,2), t date, s timestamp, x binary, a array<int>, p map<string,int>, r struct<q:int,w:string>, z string"


def typed(spark, tmp_path):
    row = (True, 1, 2, 1.5, -0.25, decimal.Decimal("3.10"), datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3, 4, 5), b"\x01\xff", [1, None], {"k": 1}, (1, None), "é")
    spark.createDataFrame([row, (None,) * 13], TYPED).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    return str(tmp_path / "t.parquet")


def test_parquet_types_and_nulls(spark, tmp_path):
    v = open_view(spark, typed(spark, tmp_path))
    assert cells(v) == [["true", "1", "2", "1.5", "-0.25", "3.10", "2020-01-02", "2020-01-02 03:04:05", "01ff", "[1,null]", '{"k":1}', '{"q":1,"w":null}', "é"], [""] * 13]
    kinds = [c.inferred for c in v.source.schema.columns]
    assert kinds[:6] == [Inferred.BOOLEAN, Inferred.INTEGER, Inferred.INTEGER, Inferred.FLOAT, Inferred.FLOAT, Inferred.FLOAT] and set(kinds[6:]) == {Inferred.TEXT}
    assert cells(v.filtered("01F")) == cells(v)[:1]
    for c in range(13):  # nulls are empty cells, which come first
        assert v.sorted(SortKey(c)).fetch(RowRange(0, 1), [c]).rows == [[""]]
        assert v.sorted(SortKey(c, Direction.DESCENDING)).fetch(RowRange(1, 1), [c]).rows == [[""]]
    iso = TableView(read_parquet(spark, typed(spark, tmp_path / "u"), "iso"))
    assert iso.fetch(RowRange(0, 1), [7]).rows == [["2020-01-02T03:04:05"]]


def test_parquet_rows_of_several_files(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    for i in range(4):
        spark.range(i * 100, i * 100 + 100, 1, 1).write.mode("append").parquet(path)
    v = open_view(spark, path)
    ids = [r[0] for r in v.source.data.orderBy(RID).select(RID).collect()]
    assert ids == list(range(400))
    assert {int(x[0]) for x in v.fetch(RowRange(0, 400)).rows} == set(range(400))


def test_row_ranges_reach_the_scan(spark, tmp_path):
    spark.range(0, 1000, 1, 1).write.parquet(str(tmp_path / "r.parquet"))
    plan = open_view(spark, str(tmp_path / "r.parquet")).window(RowRange(100, 10))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull" in plan or "GreaterThanOrEqual" in plan


def test_column_stats(spark, tmp_path):
    spark.createDataFrame([("10",), ("9",), ("x",), (None,)], "a string").coalesce(1).write.parquet(str(tmp_path / "s.parquet"))
    assert [tuple(r) for r in column_stats(open_view(spark, str(tmp_path / "s.parquet"))).collect()] == [(0, "", "x", 4, 1)]


def test_windows_of_many_files_read_one(spark, tmp_path):
    for i in range(4):
        spark.range(100 * i, 100 * i + 100).coalesce(1).write.mode("append").parquet(str(tmp_path / f"d/p{i}"))
    files = str(tmp_path / "d/*")
    v = open_view(spark, files, fmt=Format.PARQUET)
    ids = [int(r[0]) for r in v.fetch(RowRange(0, 400)).rows]
    assert sorted(ids) == list(range(400))
    for start, n in ((0, 5), (120, 20), (95, 10), (390, 50), (400, 3)):
        assert [int(r[0]) for r in v.fetch(RowRange(start, n)).rows] == ids[start : start + n]
    assert len(v.source.between(120, 140).inputFiles()) == 1
