import re

import pytest

from rowlens.functions.patterns import literal, translate
from rowlens.functions.text import (
    column_name,
    decode_field,
    delimiter_display,
    delimiter_label,
    export_names,
    fmt_count,
    format_label,
    human_bytes,
    looks_numeric,
    parse_delimiter,
    raw_name,
    stable_hash,
)
from rowlens.model import ColumnInfo, Dialect, Format, InvalidPattern, RowRange, TableSchema


def test_stable_hash():
    for path in ("", "rivers.tsv", "/maps/Flüsse 2.ndjson"):
        h = 14695981039346656037
        for byte in path.encode():
            h = ((h ^ byte) * 1099511628211) & (2**64 - 1)
        assert stable_hash(path) == h


def test_counts_and_sizes():
    assert [fmt_count(n) for n in (0, 999, 1000, 1234567)] == ["0", "999", "1,000", "1,234,567"]
    assert [human_bytes(n) for n in (0, 1023, 1024, 1536, 5 << 20, 3 << 30, 1 << 52)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB", "4096.0 TB"]


def test_delimiter_entry_and_display():
    assert [parse_delimiter(x) for x in (",", ":", "0x01", "\\x09", "", "ab", "é", "0xZZ")] == [",", ":", "\x01", "\t", None, None, None, None]
    for d in ",\t|\x01\x1f":
        assert parse_delimiter(delimiter_display(d)) == d
    assert [delimiter_label(d) for d in ",\t;|:\x01"] == ["comma", "tab", "semicolon", "pipe", ":", "0x01"]


def test_format_labels():
    assert format_label(Format.PARQUET) == "Parquet"
    assert format_label(Format.JSON_LINES) == "NDJSON"
    assert format_label(Format.JSON_ARRAY) == "JSON array"
    assert [format_label(Format.DELIMITED, Dialect(d)) for d in ",\t;"] == ["CSV", "TSV", "text, by semicolon"]


def test_names():
    schema = TableSchema((ColumnInfo(0, "﻿id"), ColumnInfo(1, ""), ColumnInfo(2, "x")))
    assert [raw_name(schema, i) for i in (0, 1, 2, 7)] == ["id", "", "x", ""]
    assert [column_name(schema, i) for i in (0, 7)] == ["id", "col7"]
    assert export_names(schema, [2, 1]) == ["x", "col1"]


def test_decoding():
    assert decode_field(b"\xef\xbb\xbfname") == "name"
    assert decode_field(b"\x93hi\x94", "cp1252") == "“hi”"
    assert decode_field(b"a\xffb") == "a�b"


def test_looks_numeric():
    assert all(map(looks_numeric, ["1", " 1.5 ", "-.5", "1.", "+1e9", "inf", "NaN", "-Infinity"]))
    assert not any(map(looks_numeric, ["", " ", "1a", "1_0", "0x1", "1f", ".", "e5"]))


def test_bounds():
    with pytest.raises(ValueError):
        RowRange(-1, 1)
    with pytest.raises(ValueError):
        Dialect("::")


@pytest.mark.parametrize("bad", ["(", "a)", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", r"\1", r"\k<a>", "a++", "a*+", "(?>a)", "[a", "*a", r"\Z", "a{3,1}", "\\", r"\q", "(?P<a>x)(?P<a>y)", "[[:nope:]]", "a{,3}"])
def test_patterns_that_are_refused(bad):
    with pytest.raises(InvalidPattern):
        translate(bad)


@pytest.mark.parametrize(
    ("pattern", "hits", "misses"),
    [
        (r"^\d{3}$", ["123", "٣٤٥"], ["12", "123\n", "1234"]),
        (r"(?m)^b$", ["a\nb\nc"], ["ab"]),
        (r"a.c", ["abc", "a\rc", "A C"], ["a\nc"]),
        (r"(?P<x_y>a)b", ["ab"], ["b"]),
        (r"É", ["é", "É"], ["e"]),
        (r"[[:digit:]]+\z", ["a1"], ["٣"]),
        (r"\x41\u{42}", ["ab", "AB"], ["41"]),
        (r"[a-z&&[^b]]$", ["a"], ["b"]),
        (r"\bword\b", ["a word."], ["swords"]),
        (r"\p{Greek}", ["α"], ["a"]),
        (r"a|b?c", ["c", "xa"], ["d"]),
        (r"\.\*", [".*"], ["ab"]),
    ],
)
def test_patterns_in_java(spark, pattern, hits, misses):
    P = spark.sparkContext._jvm.java.util.regex.Pattern
    java = P.compile(translate(pattern))
    assert [java.matcher(s).find() for s in hits] == [True] * len(hits)
    assert [java.matcher(s).find() for s in misses] == [False] * len(misses)


def test_literals_in_java(spark):
    P = spark.sparkContext._jvm.java.util.regex.Pattern
    for q in ("a.b", r"\E(", "[x", r"\Qx\E", "É"):
        assert P.compile(literal(q)).matcher("--" + q.lower() + "--").find()
        assert P.compile(literal(q, True)).matcher(q).find()
    assert not P.compile(literal("a.b")).matcher("axb").find()


def test_case_sensitivity(spark):
    P = spark.sparkContext._jvm.java.util.regex.Pattern
    assert not P.compile(translate("World", True)).matcher("world").find()
    assert P.compile(translate("World")).matcher("wORLD").find()
    assert re.match(r"\(\?dU\)", translate("x", True))
